"""Rounding as the SQL has it, signs of zeros and ties included."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from darkroom.functions.vectors import rounded
from darkroom.plans import queries as plans


def test_vectors_keep_the_sign_of_small_components(spark, tmp_path):
    # -0.000004 and -0.0 round to -0.0, which F.round turns into 0.0
    vectors = [(1, [-4e-6, 1.0, 0.0, -0.0]), (2, [3.0, -4.0, 1e-7, -1e-7]), (3, [-1.0, 1.0, 0.5, 4e-6])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: [repr(x) for x in r.unit] for r in plans.queries()["l2_normalized_vectors"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == {k: [repr(x) for x in v] for k, v in db.sql(plans.oracle_sql()["l2_normalized_vectors"]).fetchall()}
    assert got[1][0] == got[1][3] == "-0.0" and got[1][2] == "0.0"


def test_rounded_equals_sql_at_ties(spark):
    values = [0.5, -0.5, 1.5, 2.5, 1.005, -1.005, 2.675, 0.015625, -0.015625, 0.000015, 0.49999999999999994, -0.004, 0.0, -0.0, float("nan")]
    got = [repr(r.y) for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(rounded(F.col("x"), 2).alias("y")).collect()]
    assert got == [repr(duckdb.execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0]) for v in values]
