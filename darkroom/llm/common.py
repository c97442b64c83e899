"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from darkroom.sources.scratch import materialize as cut_lineage
from darkroom.sources.scratch import broadcast, owned, release, shared_folder

__all__ = ["broadcast", "cut_lineage", "owned", "release", "shared_folder"]

#: ASCII blanks; a word is a run of other characters.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where an installed vocabulary file lies; ``DARKROOM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("DARKROOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text) and the text's bytes.

    doc_id and text_id together name a document, so that rows that share an id but not a text are
    kept apart.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_id"),
        F.col("text").cast("binary").alias("text"),
    )


def attach(docs: DataFrame, marks: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` with ``column`` of ``marks`` (doc_id, text_id, column) as ``name``, null where there is none."""
    doc, text = free_names(docs, "key_doc", "key_text")
    named = marks.select(F.col("doc_id").alias(doc), F.col("text_id").alias(text), F.col(column).alias(name))
    return docs.join(named, _same_document(docs, doc, text), "left").drop(doc, text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``gone`` (doc_id, text_id)."""
    doc, text = free_names(docs, "key_doc", "key_text")
    named = gone.select(F.col("doc_id").alias(doc), F.col("text_id").alias(text))
    return docs.join(named, _same_document(docs, doc, text), "left_anti")


def _same_document(docs: DataFrame, doc: str, text: str):
    return (F.xxhash64(docs["text"]) == F.col(text)) & docs["doc_id"].cast("long").eqNullSafe(F.col(doc))


def by_bytes(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``limit`` UTF-8 bytes; a longer text stands alone."""
    run: list[str] = []
    held = 0
    for text in texts:
        size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if run and held + size > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += size
    if run:
        yield run


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch that hold about ``limit`` bytes of ``column`` each."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def map_arrow(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch) if batch.num_rows else None
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def map_texts(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """:func:`map_arrow` for a function of the rows of about 2 MB of ``text``, which bounds what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


class Membership:
    """A bitmap of fixed size that says of a 64-bit hash whether it may be in a set."""

    def __init__(self, pieces: dict[int, bytes], bits: int):
        self.bits = bits
        self.map = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for number, piece in pieces.items():
            at = (number - 1) * len(piece)
            self.map[at : at + len(piece)] = np.frombuffer(piece, dtype=np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some signed 64-bit hashes may be in the set."""
        at = hashes & ((1 << self.bits) - 1)
        return (self.map[at >> 3] >> (at & 7)) & 1 == 1


#: Largest bitmap: 2 ** MOST_BITS bits are 32 MB.
MOST_BITS = 28


def membership(values: DataFrame, column: str, bits_a_row: int = 16) -> Membership:
    """Bitmap of a column of 64-bit hashes, built on the executors.

    It has about ``bits_a_row`` bits a row, and at most 2 ** MOST_BITS, which bounds what reaches the driver and
    is broadcast, however many values there are.  It only spares later steps work: it never rejects
    a value of the set, and a full one rejects none.  ``values`` is read twice.
    """
    bits = min(MOST_BITS, max(16, (bits_a_row * values.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's buckets start at 1
    rows = (
        values.groupBy(F.bitmap_bucket_number(place).alias("number"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("piece"))
        .collect()
    )
    found = {r["number"]: bytes(r["piece"]) for r in rows}
    return Membership(found, bits)


def texts_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The texts of a batch, null as empty, in runs of about 2 MB."""
    for part in slices(batch, "text"):
        buffers = (t.as_buffer() for t in part.column("text"))
        yield [raw.to_pybytes() if raw is not None else b"" for raw in buffers]
