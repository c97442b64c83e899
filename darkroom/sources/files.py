"""Files as a manifest: path, size, time, identity, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.ingest import classified, prepare_roots
from darkroom.schema import ANALYSIS_VERSION, DECODABLE
from darkroom.sources.content import full_hashes, hashed, listing
from darkroom.sources.scratch import materialize, owned

__all__ = ["changed", "listing", "manifest", "pictures"]


def changed(listed: DataFrame, instances: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """The rows of a listing whose path, size and time are not those of a live, currently analysed instance.

    ``instances`` has path_key, file_size, modified_ms, exists_flag and analysis_version.
    """
    known = instances.filter(F.col("exists_flag") & (F.col("analysis_version") == version))
    known = known.select("path_key", F.col("file_size").alias("size"), "modified_ms")
    return classified(listed).join(known, ["path_key", "size", "modified_ms"], "left_anti")


@owned
def manifest(spark: SparkSession, roots: list[str], identities: DataFrame | None = None, instances: DataFrame | None = None) -> DataFrame:
    """The listing with quick_fingerprint, sha256, error, extension and class; ``identities`` (path, volume_id, file_id) overrule its own.

    With ``instances`` (see :func:`changed`) only files that changed are read; the others have no
    hashes.  Files are read by tasks, in ranges, whatever their size (see :mod:`darkroom.sources.content`);
    one that cannot be read has an error and no hash.
    """
    listed = materialize(listing(spark, roots))
    read = listed if instances is None else changed(listed, instances)
    rows = listed.join(hashed(read.select("path", "size")).drop("size"), "path", "left")
    if identities is not None:
        rows = rows.drop("volume_id", "file_id").join(identities, "path", "left")
    return classified(rows)


def pictures(spark: SparkSession, roots: list[str], hashes: DataFrame | None = None) -> DataFrame:
    """(path, sha256, image) of the pictures below the roots, decoded on the JVM by Spark's image source.

    ``hashes`` (path, sha256), as of :func:`manifest`, are read from the files where not given; a file that
    is no picture has an image of no size.
    """
    clean = prepare_roots(roots)
    read = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
    names = "*.{" + ",".join(v for e in DECODABLE for v in (e, e.upper())) + "}"
    found = read.option("pathGlobFilter", names).load(clean)
    found = found.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image")
    if hashes is None:
        listed = listing(spark, clean)
        hashes = full_hashes(listed.join(found.select("path"), "path", "left_semi"))
    return found.join(hashes.select("path", "sha256"), "path", "left").select("path", "sha256", "image")
