"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.sources.scratch import materialize, owned, release

#: Edges that a task holds at once when it joins those it has.
HELD_EDGES = 1 << 21


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of some edges but the least of each component, and that least vertex."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[left], root[right]
        apart = x != y
        if not apart.any():
            break
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(root, high, low)
        while True:  # until every vertex names a root
            further = root[root]
            if (further == root).all():
                break
            root = further
    some = root != np.arange(len(names))
    return names[some], names[root[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, w): edges (u, w) with the same components, as stars within what a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        n = 0
        for batch in _and_end(batches):
            if batch is not None:
                for side, column in zip(held, ("u", "w")):
                    side.append(batch.column(column).to_numpy(zero_copy_only=False))
                n += batch.num_rows
            if n and (batch is None or n >= HELD_EDGES):
                u, w = stars(*(np.concatenate(side) for side in held))
                held, n = [[], []], 0
                for low in range(0, len(u), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(u[part]), pa.array(w[part])], ["u", "w"])

    return edges.mapInArrow(run, "u long, w long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@owned
def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex each vertex of ``edges`` (a, b) reaches.

    Tasks first join what they hold into stars, of at most ``HELD_EDGES`` edges at once.  If no more
    than that are left of all of them, one task joins these.  Else large-star and small-star rounds
    alternate until no edge changes; each is a partial aggregation and a join, so a vertex of high
    degree is spread over tasks.  The rounds are known to end; there is no limit to them.  A vertex
    that only an edge to itself names is its own component; edges with a null end join nothing.
    """
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    joined = known.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
    now = materialize(_contracted(joined.select(F.col("u").cast("long"), F.col("w").cast("long"))))
    if now.count() <= HELD_EDGES:
        last, now = now, materialize(_contracted(now.coalesce(1)))
        release(last)
    else:
        now = _settled(now)
    roots = now.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct()
    labels = now.select(F.col("u").alias("v"), F.col("w").alias("component")).unionAll(roots)
    alone = known.filter("a = b").select(F.col("a").alias("v")).distinct().join(labels, "v", "left_anti")
    found = materialize(labels.unionAll(alone.select("v", F.col("v").alias("component"))))
    release(now)
    return found


def _settled(now: DataFrame) -> DataFrame:
    """Stars (u, w) of whole components, from a written table of edges u > w."""
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        both = now.unionAll(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        # what an aggregation gives is written before it is joined, so that the join can be split
        least = materialize(both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w"))
        large = materialize(large.filter("u > w").distinct())
        release(least)
        least = materialize(large.groupBy("u").agg(F.min("w").alias("m")))
        small = large.join(least, "u").filter("w > m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        last = now
        now = materialize(small.unionAll(least.select("u", F.col("m").alias("w"))).distinct())
        release(large, least, last)
