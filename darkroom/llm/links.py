"""Links between sets that share keys, and connected components, without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import Membership, cut_lineage, map_arrow, membership, owned, release
from darkroom.llm.shingles import intersection_size
from darkroom.operators.graph import components

#: Leaders of a key in the round after the first; each later round has so many times more.
LEADERS = 16
#: Words of 64 bits of the parity sketch that travels with a vertex.
SKETCH_WORDS = 8
SKETCH = tuple(f"s{i}" for i in range(SKETCH_WORDS))


def most_apart(small: int, large: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes.

    100 * i >= percent * u with i = (s - d) / 2 and u = (s + d) / 2, s the sum of the sizes.
    """
    return (small + large) * (100 - percent) // (100 + percent)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS words whose Hamming distance is at most the symmetric difference of two sets."""
    bits = SKETCH_WORDS * 64
    at = ((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    parity = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def _possible(a: str, b: str, known: Sequence[str], percent: int) -> Column:
    """That sizes and sketches, where vertices have them, do not rule a link out."""
    if not known:
        return F.lit(True)
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCH), F.lit(0))
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n_a + n_b))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key): the keys of ``rows`` (key, v) that two or more different v have."""
    spans = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return cut_lineage(spans.filter("lo < hi").select("key"))


#: Which of some pairs of values, given as two columns of equal length, are linked.
Alike = Callable[[pa.Array, pa.Array], np.ndarray]


def jaccard(percent: int) -> Alike:
    """Sorted 64-bit hashes with 100 * intersection >= percent * union."""

    def alike(one: pa.Array, other: pa.Array) -> np.ndarray:
        good = np.zeros(len(one), dtype=bool)
        for row, pair in enumerate(zip(one, other)):
            left, right = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in pair)
            both = intersection_size(left, right)
            good[row] = 100 * both >= percent * (len(left) + len(right) - both)
        return good

    return alike


@owned
def link(
    members: DataFrame,
    known_values: Callable[[Membership], DataFrame],
    alike: Alike,
    percent: int = 0,
    about: DataFrame | None = None,
) -> DataFrame:
    """(v, component) of the vertices whose values ``alike`` links, directly or by others.

    Candidates share a key: ``members`` is a table of :func:`cut_lineage` of distinct (key, v).
    ``about`` has what rules pairs of a lower Jaccard similarity than ``percent`` out before their
    values are read: v, n (set size), s0 to s7 (see :func:`parity_sketch`) and maybe sketch (see
    :func:`long_sketch`), a row for each vertex.  ``known_values`` gives (v, value) for at least the
    vertices that a bitmap holds; of rows with the same v any may be taken.

    In the first round each key's members meet one leader, by one order for all keys, and each
    vertex is compared with the leader it meets most often.  A pair within one component can add
    nothing, so each later round compares, under the keys whose members still lie in different
    components, ``LEADERS`` leaders, then ``LEADERS`` ** 2 and so on, with the members of other
    components.  Who has led has met all members and is done, and a key is closed when all others
    lie in one component.  So every pair that shares a key is compared or joined otherwise, and only
    a group of sets that do not link with each other is ever compared pair by pair.
    """
    known = [] if about is None else ["n", *SKETCH]

    def linked(pairs: DataFrame) -> DataFrame:
        return _tested(pairs, known_values, alike, percent, about if about is not None and "sketch" in about.columns else None)

    own = F.xxhash64("v", F.lit("leader"))
    spans = members.groupBy("key").agg(F.min(F.struct(own.alias("h"), "v")).alias("first"), F.max(own).alias("last"))
    # what an aggregation gives is written before it is joined, so that a join on a hot key can be split
    spans = cut_lineage(spans.filter(F.col("first.h") != F.col("last")).select("key", F.col("first.v").alias("a")))
    met = members.join(spans, "key").filter("v != a").groupBy("a", F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    edges = linked(met.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")))
    release(spans)
    labels = components(edges)
    release(edges)
    live, led = members, 0
    while True:
        leaders = LEADERS if not led else led * LEADERS
        named = live.drop("c").join(labels.withColumnRenamed("component", "c"), "v", "left")
        named = named.withColumn("c", F.coalesce("c", "v"))
        if led:
            named = named.filter(F.col("place") * F.col("m") >= led)
        spans = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("of"))
        spans = cut_lineage(spans.filter("lo < hi").select("key", "of"))
        named = named.join(spans, "key")
        if not led:
            place = F.pmod(F.xxhash64("v", "key"), F.lit(1 << 31)) / float(1 << 31)
            named = named.withColumns({"m": F.col("of"), "place": place})
            if about is not None:
                named = named.join(about.select("v", *known), "v")
        last, live = live, cut_lineage(named.drop("of"))
        release(spans, last if led else None)
        if live.isEmpty():
            break
        other = live.filter(F.col("place") * F.col("m") < leaders)
        other = other.select("key", *(F.col(x).alias(f"o_{x}") for x in ("v", "c", "place", *known)))
        after = F.struct("o_place", "o_v") < F.struct(F.col("place").alias("o_place"), F.col("v").alias("o_v"))  # two leaders meet once
        pairs = live.join(other, "key").filter((F.col("c") != F.col("o_c")) & after & _possible("", "o_", known, percent))
        more = linked(pairs.select(F.least("v", "o_v").alias("a"), F.greatest("v", "o_v").alias("b")))
        if not more.isEmpty():
            named = components(more.unionAll(labels.select(F.col("v").alias("a"), F.col("component").alias("b"))))
            release(labels)
            labels = named
        release(more)
        led = leaders
    release(live)
    return labels


def _tested(
    pairs: DataFrame, known_values: Callable[[Membership], DataFrame], alike: Alike, percent: int, sketches: DataFrame | None
) -> DataFrame:
    """The pairs (a, b) that are linked; values are read of those only that sketches leave."""
    pairs = cut_lineage(pairs.distinct())
    if sketches is not None:
        last, pairs = pairs, cut_lineage(_sketched(pairs, sketches, percent))
        release(last)
    ends = cut_lineage(pairs.select(F.col("a").alias("v")).unionAll(pairs.select("b")))
    values = known_values(membership(ends, "v"))
    values = cut_lineage(values.groupBy("v").agg(F.first("value").alias("value")))
    found = verified(pairs, values, alike)
    release(pairs, ends, values)
    return found


def long_sketch(hashes: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits, at least twice as many as hashes and 512."""
    bits = max(512, 1 << (2 * len(hashes) - 1).bit_length())
    at = ((hashes >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(one: np.ndarray, other: np.ndarray) -> int:
    """Hamming distance of two long sketches, as words, the longer one folded to the length of the other."""
    if len(one) < len(other):
        one, other = other, one
    return int(np.bitwise_count(np.bitwise_xor.reduce(one.reshape(-1, len(other)), axis=0) ^ other).sum())


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and long sketches do not rule out."""
    joined = pairs
    for side in ("b", "a"):
        of_side = sketches.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        joined = joined.join(of_side, side)

    def holds(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        words = ((np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in batch.column(c)) for c in ("sketch_a", "sketch_b"))
        apart = np.fromiter((sketches_apart(x, y) for x, y in zip(*words)), dtype=np.int64, count=batch.num_rows)
        return batch.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * sizes))

    some = joined.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return map_arrow(some.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), holds, "a long, b long")


def verified(pairs: DataFrame, values: DataFrame, alike: Alike) -> DataFrame:
    """The pairs (a, b) whose values are alike."""
    joined = pairs
    for side in ("b", "a"):  # of the leader, a, there may be many
        joined = joined.join(values.select(F.col("v").alias(side), F.col("value").alias(f"value_{side}")), side)

    def holds(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = alike(batch.column("value_a"), batch.column("value_b"))
        return batch.select(["a", "b"]).filter(pa.array(good))

    return cut_lineage(map_arrow(joined.select("a", "b", "value_a", "value_b"), holds, "a long, b long"))
