"""Similar pairs by arrays in tasks: bands of hot keys, tiles of buffers, twins that are not expanded, token bins."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from darkroom.functions import hashing, vectors
from darkroom.operators import matching
from darkroom.sources import library


def test_hot_keys_are_dealt_to_parts_without_losing_a_pair(spark, monkeypatch):
    monkeypatch.setattr(matching, "HELD_HASHES", 40)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        p, d = 0, 0
        for bit in rng.choice(63, size=int(rng.integers(0, 7)), replace=False):
            p ^= 1 << int(bit)
        for bit in rng.choice(63, size=int(rng.integers(0, 9)), replace=False):
            d ^= 1 << int(bit)
        rows.append((i, p, d))
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] ^ b[1]).bit_count() <= 8 and (a[2] ^ b[2]).bit_count() <= 12)
    frame = spark.createDataFrame(rows, "asset_id long, phash long, dhash long")
    assert sorted((r.a, r.b) for r in matching.hamming_join(frame).collect()) == want and len(want) > 5000


def test_confirmed_pairs_equal_the_native_similarity(spark):
    rng = np.random.default_rng(4)
    base = rng.random((6, 64))
    buffers = [(i, (base[i % 6] + rng.normal(0, 0.03, 64)).clip(0, 1).tolist()) for i in range(60)] + [(60, [0.5] * 63), (61, None), (62, [])]
    pairs = spark.createDataFrame(list(itertools.combinations(range(64), 2)), "a long, b long")  # 63 has no buffer
    frame = spark.createDataFrame(buffers, "asset_id long, buffer array<double>")
    got = {(r.a, r.b): r.similarity for r in matching.confirmed_pairs(pairs, frame).collect()}
    one, two = frame.filter("asset_id < 60").toDF("a", "x"), frame.filter("asset_id < 60").toDF("b", "y")
    native = pairs.join(one, "a").join(two, "b").select("a", "b", vectors.ssim(F.col("x"), F.col("y")).alias("s"))
    assert got == {(r.a, r.b): r.s for r in native.filter("s >= 0.97").collect()} and len(got) > 50


def test_twins_are_counted_without_their_pairs(spark):
    nodes = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (3, 3), (5, 3), (6, 3)], "asset_id long, twin long")
    pairs = spark.createDataFrame([(1, 2, 0.98), (1, 3, 0.97)], "a long, b long, similarity double")
    every = {(r.a, r.b): r.similarity for r in matching.expanded(pairs, nodes).collect()}
    assert every == {(1, 2): 0.98, (2, 4): 0.98, **{p: 0.97 for p in [(1, 3), (1, 5), (1, 6), (3, 4), (4, 5), (4, 6)]}, **{p: 1.0 for p in [(1, 4), (3, 5), (3, 6), (5, 6)]}}
    counted = {r.similarity: r.n for r in matching.counted(pairs, nodes).groupBy("similarity").agg(F.sum("n").alias("n")).collect()}
    assert counted == {0.98: 2, 0.97: 6, 1.0: 4}


def test_tokens_are_hashed_as_md5_has_them(spark):
    texts = ["", "é" * 27, "x" * 55, "y" * 56, "z" * 300, *map(str, range(100))]
    assert hashing.md5_bytes(pa.array(texts)[1:]).tolist() == [hashlib.md5(t.encode()).digest()[0] for t in texts[1:]]
    frame = spark.createDataFrame([(1, " a\tb\n a\r"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.buffer for r in library.histograms(frame).collect()}
    a, b = (hashlib.md5(t).digest()[0] % 64 for t in (b"a", b"b"))
    assert (got[1][a], got[1][b], sum(got[1])) == (1.0, 0.5, 1.5) and got[2] == got[3] == [0.0] * 64
