"""Files read by ranges, and folders listed level by level, in tasks.

Paths may name any file system that Arrow knows (``file:``, ``hdfs:``, ``s3:``, ..); a path without
a scheme is one that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.imaging import system_of
from darkroom.operators.ingest import prepare_roots
from darkroom.schema import SLICE_BYTES
from darkroom.sources.scratch import materialize, owned, release

#: Bytes of a block of a full hash, and of the content that a task of full hashes reads about.
BLOCK_BYTES, TASK_BYTES = 1 << 20, 1 << 30
#: Files of a task that reads fingerprints, and folders of one that lists.
TASK_FILES, TASK_FOLDERS = 5_000, 64


class RangedFile:
    """A file that is read by ranges and counts the bytes that it gave."""

    def __init__(self, path: str):
        system, at = system_of(path)
        self.file, self.bytes_read = system.open_input_file(at), 0

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def at(self, offset: int, length: int) -> bytes:
        found = self.file.read_at(length, offset)
        self.bytes_read += len(found)
        return found

    def size(self) -> int:
        return self.file.size()


def slices_of(size: int, slice_bytes: int = SLICE_BYTES) -> list[int]:
    """Where the slices of a fingerprint begin: the first, and of files of more than two, middle and last ones."""
    return [0] if size <= 2 * slice_bytes else [0, size // 2 - slice_bytes // 2, size - slice_bytes]


def fingerprint(file: RangedFile, slice_bytes: int = SLICE_BYTES) -> str:
    """As :func:`darkroom.functions.hashing.quick_fingerprint`, of at most three slices."""
    size, sha = file.size(), hashlib.sha256()
    for offset in slices_of(size, slice_bytes):
        sha.update(file.at(offset, slice_bytes))
    sha.update(str(size).encode())
    return sha.hexdigest()


def full_hash(file: RangedFile) -> str:
    """sha256 of the whole content, read in blocks."""
    sha, at = hashlib.sha256(), 0
    while block := file.at(at, BLOCK_BYTES):
        sha.update(block)
        at += len(block)
    return sha.hexdigest()


def _hashed(files: DataFrame, name: str, function) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column("path").to_pylist():
                try:
                    with RangedFile(path) as file:
                        found = function(file)
                        rows.append((path, found, file.bytes_read, None))
                except OSError as error:  # one unreadable file does not stop the rest
                    rows.append((path, None, 0, str(error) or type(error).__name__))
            columns = list(zip(*rows)) if rows else [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["path", name, "bytes_read", "error"])

    return files.select("path").mapInArrow(run, f"path string, {name} string, bytes_read long, error string")


def quick_fingerprints(files: DataFrame) -> DataFrame:
    """(path, quick_fingerprint, bytes_read, error) of ``files`` (path): at most 192 KB of a file are read.

    A file that cannot be read has an error and no hash.
    """
    count = files.count()
    return _hashed(files.repartition(max(1, -(-count // TASK_FILES)), "path"), "quick_fingerprint", fingerprint)


def full_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes_read, error) of ``files`` (path, size), read in blocks of 1 MB whatever their size.

    Files are dealt to tasks by their bytes: those of a task follow each other in an order by hash
    of the path, about 1 GB of them, a larger file alone.
    """
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _hashed(files.repartition(max(1, -(-int(total) // TASK_BYTES)), "path"), "sha256", full_hash)


LISTED = "path string, size long, modified_ms long, volume_id string, file_id string, is_folder boolean"


def _entries(folder: str) -> Iterator[tuple]:
    """What a folder holds: files and folders, no links; local ones with the file system's own identity."""
    if "://" in folder:
        system, at = fs.FileSystem.from_uri(folder)
        scheme = folder[: len(folder) - len(at)] if folder.endswith(at) else folder.split("://")[0] + "://"
        for info in system.get_file_info(fs.FileSelector(at, recursive=False)):
            if info.type == fs.FileType.Directory:
                yield scheme + info.path, None, None, None, None, True
            elif info.type == fs.FileType.File:
                yield scheme + info.path, info.size, (info.mtime_ns or 0) // 1_000_000, None, None, False
        return
    with os.scandir(folder) as found:
        for entry in found:
            about = entry.stat(follow_symlinks=False)
            if stat.S_ISDIR(about.st_mode):
                yield entry.path, None, None, None, None, True
            elif stat.S_ISREG(about.st_mode):
                yield entry.path, about.st_size, about.st_mtime_ns // 1_000_000, str(about.st_dev), str(about.st_ino), False


def _level(folders: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LISTED.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[f.split()[1]] for f in LISTED.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        for given in batches:
            for folder in given.column("path").to_pylist():
                try:
                    for entry in _entries(folder):
                        rows.append(entry)
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                except OSError as error:
                    raise RuntimeError(f"unable to enumerate files under {folder}: {error}") from error
        if rows:
            yield batch(rows)

    return folders.select("path").mapInArrow(run, LISTED)


@owned
def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All files below the roots: path, size, modified_ms, volume_id and file_id (of local files); contents are not read.

    Folders are listed in tasks, a level of all trees at a time, so that no list of paths reaches
    the driver.  Links are not followed.  A folder that cannot be read ends the listing with an
    error: a scan that saw a part of a tree would mark the rest as missing.
    """
    level = spark.createDataFrame([(r if "://" in r and not r.startswith("file:") else system_of(r)[1],) for r in prepare_roots(roots)], "path string")
    files, count = None, level.count()
    while count:
        found = materialize(_level(level.repartition(max(1, -(-count // TASK_FOLDERS)), "path")))
        own = found.filter("NOT is_folder")
        files = own if files is None else files.unionByName(own)
        level = found.filter("is_folder")
        count = level.count()
    if files is None:
        files = spark.createDataFrame([], LISTED)
    # A file below two nested roots counts once.
    return files.drop("is_folder").dropDuplicates(["path"])


@owned
def hashed(files: DataFrame) -> DataFrame:
    """``files`` (path, size, ..) with quick_fingerprint, sha256 and error; each written once, as contents are read only once."""
    quick = materialize(quick_fingerprints(files).select("path", "quick_fingerprint", F.col("error").alias("quick_error")))
    readable = files.join(quick.filter("quick_error IS NULL").select("path"), "path", "left_semi")
    full = materialize(full_hashes(readable).select("path", "sha256", F.col("error").alias("full_error")))
    out = materialize(files.join(quick, "path", "left").join(full, "path", "left").withColumn("error", F.coalesce("quick_error", "full_error")).drop("quick_error", "full_error"))
    release(quick, full)
    return out
