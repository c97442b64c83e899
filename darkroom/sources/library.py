"""A media library seen in the tables of a data directory.

Documents stand for files: the asset is the distinct text, the extension the language, the folder
the source; labels stand for ratings, and a 64-bin token histogram for the pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import hashing, paths
from darkroom.functions.vectors import total
from darkroom.operators.learning import with_bucket
from darkroom.sources.scratch import materialize

BINS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, sha256, current_path, path_key, extension, file_class, file_size, quality, width, height."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")))
    return docs.select(
        F.col("doc_id").alias("instance_id"),
        hashing.sha256_hex(F.col("text")).alias("sha256"),
        path.alias("current_path"),
        paths.path_key(path).alias("path_key"),
        F.col("lang").alias("extension"),
        "source",
        F.octet_length("text").cast("long").alias("file_size"),
        F.col("n_chars").alias("width"),
        (F.col("doc_id") % 97 + 1).alias("height"),
        (F.col("n_chars") % 101).cast("double").alias("quality"),
    )


def active_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with their asset id, the least instance id of the content."""
    found = instances(spark, sf_dir)
    assets = found.groupBy("sha256").agg(F.min("instance_id").alias("asset_id"))
    return found.join(assets, "sha256")


def listed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records with what the listing asks of files: some are gone, some are no images, some have no preview."""
    return active_records(spark, sf_dir).withColumns(
        {
            "exists_flag": F.col("instance_id") % 13 != 0,
            "file_class": F.when(F.col("instance_id") % 11 == 0, "video").otherwise("image"),
            "preview_supported": F.col("instance_id") % 5 != 0,
            "last_seen_at": F.col("instance_id") % 1000,
        }
    )


def models(spark: SparkSession) -> DataFrame:
    """A registry of three models, of which the second and the third are marked active."""
    return spark.range(1, 4).withColumn("active", F.col("id") > 1)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of models 2 and 3 for most assets; each asset's score is made from its id."""
    assets = active_records(spark, sf_dir).select("asset_id").distinct().filter("asset_id % 7 != 0")
    model = F.explode(F.array(F.lit(2), F.lit(3)).cast("array<bigint>"))
    score = (F.col("asset_id") * F.col("model_id") % 100).cast("double") / 100
    scored = assets.withColumn("model_id", model).withColumn("ai_score", score)
    return with_bucket(scored.withColumn("ai_confidence", 2 * F.abs(F.col("ai_score") - 0.5)))


def rating_of(labels: DataFrame) -> DataFrame:
    """instance_id, rating 1 to 5 and the time it was given."""
    return labels.select(
        F.col("doc_id").alias("instance_id"),
        (1 + 3 * F.col("quality") + F.col("toxic")).cast("int").alias("rating"),
        F.col("doc_id").alias("event_id"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_of(read(spark, sf_dir, "labels"))


def _shares(texts: pa.Array) -> np.ndarray:
    """Of each text, the share of its most frequent bin that each of its token bins has."""
    spaced = pc.replace_substring_regex(texts.fill_null(""), "[\t\n\r]", " ")
    split = pc.split_pattern(spaced, " ")
    tokens = pc.list_flatten(split).dictionary_encode()
    bins = hashing.md5_bytes(tokens.dictionary).astype(np.int64) % BINS
    bins[pc.equal(tokens.dictionary, "").to_numpy(zero_copy_only=False)] = -1
    at = bins[tokens.indices.to_numpy()]
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    counts = np.bincount((rows * BINS + at)[at >= 0], minlength=len(texts) * BINS).reshape(-1, BINS)
    return counts / np.maximum(counts.max(axis=1, initial=0), 1)[:, None]


def histograms(texts: DataFrame) -> DataFrame:
    """``texts`` with ``buffer`` instead of its last column, a text: the share of the most frequent bin that each of 64 token bins has.

    Bins are by md5.  A text is counted where it lies, and each different token of a batch is hashed once.
    """
    *kept, text = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = pa.array(_shares(batch.column(text)).ravel())
            buffers = pa.ListArray.from_arrays(pa.array(np.arange(0, len(shares) + 1, BINS, dtype=np.int32)), shares)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), buffers], [*kept, "buffer"])

    return texts.mapInArrow(run, ", ".join([*(f"{name} {kind}" for name, kind in texts.dtypes[:-1]), "buffer array<double>"]))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, buffer, phash, dhash, quality of each distinct text; written once, as joins read it often."""
    docs = read(spark, sf_dir, "documents")
    quality = (F.col("n_chars") % 101).cast("double").alias("quality")
    # texts are read once and not shuffled
    counted = materialize(histograms(docs.select(F.col("doc_id").alias("asset_id"), quality, F.sha2("text", 256).alias("sha256"), "text")))
    first = materialize(counted.groupBy("sha256").agg(F.min("asset_id").alias("asset_id")).select("asset_id"))
    found = counted.drop("sha256").join(first, "asset_id", "left_semi")
    found = found.withColumn("phash", hashing.phash_of(F.col("buffer")))
    return materialize(found.withColumn("dhash", hashing.dhash_of(F.col("buffer"))))


def scores(spark: SparkSession, sf_dir: str, sets: int = 4) -> DataFrame:
    """set_id, asset_id, score: embeddings dealt to sets, scored by their sum."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(
        (F.col("vec_id") % sets).alias("set_id"),
        F.col("vec_id").alias("asset_id"),
        F.round(total(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("score"),
    )
