"""Hard negatives against a plain loop, and the bounds that spare exact scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """Rows are (vec_id, label, vector); each counts, in Python's own integers."""
    good = [
        (i, l, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, l, v in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, q in good:
        if a % 100:
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(q, p)), i, l) for i, l, p in good if i != a and len(p) == len(q)), key=lambda s: s[:2]
        )
        for score, i, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and low * -score <= -100 * s[0] <= high * -score]
            out += [(a, i, n + 1, s[1], -score, -s[0]) for n, s in enumerate(window[:negatives])]
    return sorted(out)


def clusters(rng, n, size=12, labels=4, start=0):
    """Vectors around a few centres, with ties by coarse rounding."""
    centres = rng.normal(size=(6, size))
    rows = []
    for i in range(n):
        v = np.round(centres[i % 6] + 0.4 * rng.normal(size=size), 1)
        rows.append((start + i, int(rng.integers(labels)), [float(x) for x in v]))
    return rows


def run(spark, rows, **options):
    found = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = clusters(rng, 900) + [(2000 + i, 1, rows_) for i, rows_ in enumerate([[0.5] * 12] * 40)]
    rows += [(3000 + i, 2, [0.5] * 12) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block_rows=3, sample_rows=300) == brute(rows)
    assert run(spark, rows, positives=2, negatives=3, low=50, high=120) == brute(rows, 2, 3, 50, 120)


def test_small_strips_and_buffers(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = clusters(rng, 700, labels=2)
    table = hn.Rows.__init__.__globals__
    monkeypatch.setitem(table, "STRIP", 16)
    books = hn.fit_books([hn.np.floor(256 * np.array(v)) for _, _, v in rows])
    whole = np.floor(256 * np.array([v for _, _, v in rows], dtype=np.float32).astype(np.float64))
    codes, reach = hn.encode(whole, books[12])
    ids, labels = np.arange(700), np.array([r[1] for r in rows])
    held = hn.Rows.__new__(hn.Rows)
    order = np.argsort(labels, kind="stable")
    held.id, held.label, held.reach = ids[order], labels[order], reach[order].astype(np.float32)
    held.exact, held.code = whole[order].astype(np.int32), codes[order]
    some = ids % 100 == 0
    anchors = hn.Anchors(ids[some], labels[some], whole[some].astype(np.int32), books[12])
    best = hn.Best(int(some.sum()), 5)
    hn.add_positives(held, anchors, best)
    for j, a in enumerate(anchors.id):
        scores = sorted((-int(whole[i] @ whole[a]), i) for i in ids if i != a and labels[i] == labels[a])[:5]
        assert [(-s, i) for s, i in scores] == list(zip(best.score[j].tolist(), best.id[j].tolist()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0, 0.5]), (1, 1, [1.0, 0.0, 0.5]), (2, 2, [0.9, 0.0, 0.5]), (3, 2, [0.9, 0.0, 0.5]), (4, None, [1.0, 0.0, 0.5]),
        (5, 2, None), (6, 2, [1.0, None, 0.5]), (7, 2, [nan, 0.0, 1.0]), (8, 2, [inf, 0.0, 1.0]), (9, 2, [1.0, 0.0]), (100, 1, [1.0, 0.0]),
        (101, 1, [1.0, 0.5]), (102, 2, [1.0, 0.0]), (None, 2, [1.0, 0.0, 0.5]), (200, 3, []), (201, 3, []), (202, 4, []),
        (300, 5, [0.0, 0.0, 0.0]), (301, 5, [-1.0, -1.0, 0.0]), (302, 6, [-1.0, 0.0, 0.0]), (400, 9, [1.0, 0.0, 0.5]),
    ]
    assert run(spark, rows) == brute(rows)
    rows += [rows[2], rows[0], rows[1], (0, 2, [0.95, 0.0, 0.5])]  # repeated rows count each
    assert run(spark, rows) == brute(rows)
    huge = rows + [(500, 1, [1e30, 0.0, 0.0])]  # scores would not fit
    assert run(spark, huge) == brute(rows)
    assert run(spark, []) == []


def test_clashing_names_and_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(100 * i if i < 3 else i, i % 2, rng.normal(size=20_001).round(2).tolist()) for i in range(24)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("anchor", "size", "exact", "code", "reach", "place", "rank", "key", "score", "id", "Label_"):
        frame = frame.withColumn(name, F.lit("x"))
    found = hn.hard_negatives(frame, F.col("vec_id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_bounds_hold(size):
    rng = np.random.default_rng(size)
    rows = np.floor(rng.normal(size=(600, size)) * 10.0 ** rng.integers(0, 8, size=(600, 1)))
    books = hn.fit_books(list(rows))
    codes, reach = hn.encode(rows, books[size])
    anchors = hn.Anchors(np.arange(50), np.zeros(50, int), rows[:50].astype(np.int32), books[size])
    least, most = hn._bounds(anchors.tables(np.arange(50)), anchors.norms(np.arange(50)), codes, reach.astype(np.float32) * np.float32(1 + 1e-6))
    exact = np.array([[int(sum(int(x) * int(y) for x, y in zip(r, a))) for a in rows[:50]] for r in rows], dtype=np.float64)
    assert (least <= hn._above(exact)).all() and (most >= hn._below(exact)).all()


def test_bounds_spare_most_scores(monkeypatch):
    rng = np.random.default_rng(4)
    whole = np.floor(256 * rng.normal(size=(4000, 32)) / math.sqrt(32))
    books = hn.fit_books(list(whole))
    codes, reach = hn.encode(whole, books[32])
    held = hn.Rows.__new__(hn.Rows)
    held.id, held.label, held.reach = np.arange(4000), np.zeros(4000, int), reach.astype(np.float32)
    held.exact, held.code = whole.astype(np.int32), codes
    anchors = hn.Anchors(np.arange(20), np.zeros(20, int), whole[:20].astype(np.int32), books[32])
    scored = []
    monkeypatch.setattr(hn, "_exact", lambda r, a, i, j, exact=hn._exact: scored.append(len(i)) or exact(r, a, i, j))
    hn.add_positives(held, anchors, hn.Best(20, 5))
    assert sum(scored) < 0.05 * 20 * 4000
