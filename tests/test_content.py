"""Files by ranges, folders by level, and a scan of both."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from darkroom.functions import hashing
from darkroom.operators import ingest
from darkroom.schema import schema
from darkroom.sources import content, files

SLICE = 64 * 1024


def tree(folder, sizes):
    rows = {}
    for i, size in enumerate(sizes):
        at = folder / f"d{i % 3}" / "deep" / f"f{i}.mp4" if i % 2 else folder / f"f{i}.JPG"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(bytes((i + k * k) % 251 for k in range(min(size, 5000))) * (size // 5000) + b"x" * (size % 5000))
        rows[str(at)] = at.read_bytes()
    return rows


def test_fingerprints_read_slices_only(spark, tmp_path):
    sizes = [0, 1, SLICE, 2 * SLICE - 1, 2 * SLICE, 2 * SLICE + 1, 3 * SLICE, 900_001]
    want = tree(tmp_path, sizes)
    listed = content.listing(spark, [str(tmp_path)])
    assert {r.path: r.size for r in listed.collect()} == {p: len(d) for p, d in want.items()}
    quick = {r.path: r for r in content.quick_fingerprints(listed).collect()}
    native = spark.createDataFrame([(p, d) for p, d in want.items()], "path string, content binary")
    native = {r.path: r.q for r in native.select("path", hashing.quick_fingerprint(F.col("content")).alias("q")).collect()}
    full = {r.path: r for r in content.full_hashes(listed).collect()}
    for path, data in want.items():
        assert quick[path].quick_fingerprint == native[path] and quick[path].error is None
        assert quick[path].bytes_read == sum(len(data[o : o + SLICE]) for o in content.slices_of(len(data))) <= 3 * SLICE
        assert full[path].sha256 == hashlib.sha256(data).hexdigest() and full[path].bytes_read == len(data)


def test_sparse_video_over_two_gigabytes(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "long.mov", "wb") as file:
        file.truncate(size)
        file.seek(size // 2)
        file.write(b"middle")
    quick = content.quick_fingerprints(content.listing(spark, [str(tmp_path)])).first()
    assert quick.bytes_read == 3 * SLICE
    rows = files.manifest(spark, [str(tmp_path)]).collect()
    sha = hashlib.sha256()
    with open(tmp_path / "long.mov", "rb") as file:
        while block := file.read(1 << 24):
            sha.update(block)
    assert [(r.size, r.sha256, r.file_class, r.error) for r in rows] == [(size, sha.hexdigest(), "video", None)]


def test_unreadable_files_are_rows(spark, tmp_path):
    tree(tmp_path, [10, 20])
    gone = spark.createDataFrame([(str(tmp_path / "gone.jpg"), 5)], "path string, size long")
    found = content.hashed(content.listing(spark, [str(tmp_path)]).select("path", "size").unionAll(gone)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.error is None and r.sha256 is not None for r in found} == {"f0.JPG": True, "f1.mp4": True, "gone.jpg": False}


def test_listing_aborts_and_skips_links(spark, tmp_path):
    want = tree(tmp_path / "a", [10, 20, 30])
    os.symlink(tmp_path / "a" / "f0.JPG", tmp_path / "a" / "link.jpg")
    os.symlink(tmp_path / "nowhere", tmp_path / "a" / "dangling")
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    roots = [str(tmp_path / "a"), f"file://{tmp_path}/a/d1", "  "]
    rows = content.listing(spark, roots).collect()
    assert sorted(r.path for r in rows) == sorted(want)
    about = os.stat(rows[0].path)
    assert (rows[0].volume_id, rows[0].file_id) == (str(about.st_dev), str(about.st_ino))
    assert rows[0].modified_ms == about.st_mtime_ns // 1_000_000
    assert content.listing(spark, [" "]).count() == 0
    with pytest.raises(Exception, match="unable to enumerate files under"):
        content.listing(spark, [str(tmp_path / "a"), str(tmp_path / "missing")]).count()


def test_scan_of_a_folder_sees_moves_and_failures(spark, tmp_path):
    """Identity comes from the listing, so a rename on one volume is a move."""
    tree(tmp_path, [10, 20, 30])
    none = {t: spark.createDataFrame([], schema(t)) for t in ("file_instances", "content_assets")}
    now = F.lit("2024-01-01").cast("timestamp")
    first = ingest.scan(files.manifest(spark, [str(tmp_path)]), none["file_instances"], none["content_assets"], [str(tmp_path)], 1, now)
    instances, assets = first["file_instances"].persist(), first["content_assets"].persist()
    assert instances.count() == 3 and assets.count() == 3
    os.rename(tmp_path / "f0.JPG", tmp_path / "new.jpg")
    (tmp_path / "bad.png").write_bytes(b"1")
    known = instances.join(assets.select(F.col("id").alias("content_asset_id"), "analysis_version"), "content_asset_id")
    seen = files.manifest(spark, [str(tmp_path)], instances=known)
    broken = F.col("path").endswith("bad.png")
    seen = seen.withColumns({"sha256": F.when(~broken, F.col("sha256")), "error": F.when(broken, F.lit("no")).otherwise(F.col("error"))})
    out = ingest.scan(seen, instances, assets, [str(tmp_path)], 2, now)
    assert [(r.change_type, r.new_path) for r in out["path_history"].collect()] == [("same_volume_move", str(tmp_path / "new.jpg"))]
    assert [(r.path, r.error) for r in out["failed_files"].collect()] == [(str(tmp_path / "bad.png"), "no")]
    assert out["content_assets"].count() == 3 and out["file_instances"].filter("exists_flag").count() == 3
