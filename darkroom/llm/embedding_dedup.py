"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import Membership, broadcast, cut_lineage, map_arrow, membership, owned, release
from darkroom.llm.links import link, shared_keys
from darkroom.llm.shingles import mix, signed

#: Most vectors of a block; vectors of a larger component are dealt to pairs of blocks.
BLOCK = 4096
#: Rows of a matrix product.
STRIP = 512
#: Shorter vectors are padded to this length, as rotations by signs need some length to differ.
LEAST_SIZE = 64
#: Vectors that are hashed at once, so that they stay in the processor's cache.
HASHED = 1024


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two, scaled to a rotation.

    Each step transforms up to eight neighbours at once and then moves them to the far end, so that
    after the last step all are back in place.
    """
    n, size = rows.shape
    left = size
    while left > 1:
        radix = min(8, left)
        small = np.ones((1, 1))
        while len(small) < radix:
            small = np.block([[small, small], [small, -small]])
        rows = rows.reshape(-1, radix) @ (small / math.sqrt(radix)).astype(rows.dtype)
        rows = rows.reshape(n, size // radix, radix).transpose(0, 2, 1).reshape(n, size)
        left //= radix
    return rows


class CrossPolytope:
    """``tables`` hash tables of ``parts`` cross-polytope hashes each.

    A hash turns the vector by three rounds of random signs and a Hadamard transform and names the
    axis, with its sign, that is nearest.  ``probes`` buckets per table are returned: that of the
    nearest axes, then those in which one part has its second axis, by least loss.  Hashes only
    choose candidates and are taken in single precision.
    """

    def __init__(self, dimension: int, tables: int, parts: int, probes: int, seed: int = 11):
        self.size = max(LEAST_SIZE, 1 << (dimension - 1).bit_length())
        self.tables, self.parts, self.probes = tables, parts, probes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], dtype=np.float32), size=(tables, parts, 3, self.size))

    def _axes(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest axis of each row, the second, and how much nearer the first is."""
        every, found, value = np.arange(len(turned)), [], []
        far = np.abs(turned)
        for _ in range(2):
            at = far.argmax(axis=1)
            found.append((2 * at + (turned[every, at] < 0)).astype(np.uint64))
            value.append(far[every, at])
            far[every, at] = -1
        return found[0], found[1], value[0] - value[1]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, tables * probes) bucket keys."""
        if len(vectors) > HASHED:
            return np.concatenate([self.keys(vectors[i : i + HASHED]) for i in range(0, len(vectors), HASHED)])
        n = len(vectors)
        padded = np.zeros((n, self.size), dtype=np.float32)
        padded[:, : vectors.shape[1]] = vectors
        out = np.zeros((n, self.tables, self.probes), dtype=np.uint64)
        for table in range(self.tables):
            axes = np.zeros((self.parts, 2, n), dtype=np.uint64)
            loss = np.zeros((self.parts, n))
            for part in range(self.parts):
                turned = padded
                for signs in self.signs[table, part]:
                    turned = hadamard(turned * signs)
                axes[part, 0], axes[part, 1], loss[part] = self._axes(turned)
            cheapest = np.argsort(loss, axis=0, kind="stable")
            for probe in range(self.probes):
                key = np.full(n, table + 1, dtype=np.uint64)
                for part in range(self.parts):
                    # Probe p swaps the p-th cheapest part; probe 0 swaps none.
                    swap = (cheapest[probe - 1] == part) if 0 < probe <= self.parts else np.zeros(n, dtype=bool)
                    key = mix(key * np.uint64(2 * self.size + 1) + np.where(swap, axes[part, 1], axes[part, 0]))
                out[:, table, probe] = key
        return signed(out.reshape(n, -1))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for value in column:
        unit = None
        if value.is_valid and len(value) and not value.values.null_count:
            raw = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(raw).max()
            if np.isfinite(raw).all() and top > 0:
                raw = raw / top
                unit = raw / np.sqrt(raw @ raw)
        out.append(unit)
    return out


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, cid, unit): a content hash and the unit vector's bytes, null for unlinkable vectors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = _vectors(batch.column("embedding"))
        raw = [None if u is None else u.tobytes() for u in units]
        ids = [None if r is None else xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "cid", "unit"]
        )

    return map_arrow(vectors, run, "vec_id long, cid long, unit binary")


def _stacked(column: pa.Array) -> np.ndarray:
    """The vectors of a column of equal lengths, one below the other."""
    if not len(column):
        return np.zeros((0, 1))
    raw = b"".join(u.as_buffer() for u in column)
    return np.frombuffer(raw, dtype=np.float64).reshape(len(column), -1)


def _keys(classes: DataFrame, tables: int, parts: int, probes: int) -> DataFrame:
    """(v, keys): the buckets of each class.  Vectors of different lengths share none."""
    hashers: dict[int, CrossPolytope] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units, v = batch.column("unit"), batch.column("v")
        sizes = np.array([len(u.as_buffer()) // 8 for u in units])
        owners, found = [], []
        for dimension in np.unique(sizes).tolist():
            rows = pa.array(np.flatnonzero(sizes == dimension))
            if dimension not in hashers:
                hashers[dimension] = CrossPolytope(dimension, tables, parts, probes)
            keys = hashers[dimension].keys(_stacked(units.take(rows))) ^ np.int64(dimension * 0x9E3779B97F4A7)
            owners.append(v.take(rows))
            found.append(keys)
        keys = np.concatenate(found)
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(owners), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["v", "keys"]
        )

    return map_arrow(classes.select("v", "unit"), run, "v long, keys array<long>")


def cosine(threshold: float):
    """Pairs of unit vectors whose product is at least ``threshold``."""

    def alike(one: pa.Array, other: pa.Array) -> np.ndarray:
        good = np.zeros(len(one), dtype=bool)
        sizes = np.array([len(u.as_buffer()) for u in one])
        for size in np.unique(sizes[sizes == [len(u.as_buffer()) for u in other]]):
            rows = np.flatnonzero(sizes == size)
            at = pa.array(rows)
            good[rows] = np.einsum("ij,ij->i", _stacked(one.take(at)), _stacked(other.take(at))) >= threshold
        return good

    return alike


def _counts(tasks: DataFrame, threshold: float) -> DataFrame:
    """(v, links): per vector of a task its links with the others of the task.

    Rows come sorted by task (component, i, j), which holds the vectors of blocks i and j of a
    component: all pairs within one block if i = j, else those across the two.  A pair so counts in
    one task only, whichever of its blocks have rows.
    """

    def group(i: int, j: int, v: np.ndarray, copies: np.ndarray, part: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links = np.zeros(len(v), dtype=np.int64)
        others = unit[right].T
        for low in range(0, len(left), STRIP):
            rows = left[low : low + STRIP]
            near = unit[rows] @ others >= threshold
            if i == j:
                near[np.arange(len(rows)), np.arange(low, low + len(rows))] = False
            else:
                links[right] += copies[rows] @ near
            links[rows] += near @ copies[right]
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(links)], ["v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task: tuple | None = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if high == low:
                    continue
                if task is not None and task != tuple(ids[low]):
                    yield done(task, held)
                    held = []
                task = tuple(ids[low])
                held.append(batch.slice(low, high - low))
        if task is not None:
            yield done(task, held)

    def done(task: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        v, copies, part = (table.column(c).to_numpy() for c in ("v", "copies", "part"))
        return group(int(task[1]), int(task[2]), v, copies, part, _stacked(table.column("unit").combine_chunks()))

    return tasks.select("component", "i", "j", "part", "v", "copies", "unit").mapInArrow(run, "v long, links long")


def _wanted(classes: DataFrame, held: Membership) -> DataFrame:
    shared = broadcast(classes.sparkSession, held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value(batch.column("v").to_numpy())))

    return map_arrow(classes.select("v", F.col("unit").alias("value")), run, "v long, value binary")


@owned
def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, tables: int = 12, probes: int = 4, per_bucket: int = 1
) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding) with a cosine of at least ``threshold``.

    Equal directions are one class.  Classes are hashed (see :class:`CrossPolytope`) with as many
    parts as leave at most ``per_bucket`` random vectors in a bucket.  Only ids are shuffled by
    bucket; candidates are verified in double precision and components found without all pairs of
    a bucket (see :func:`darkroom.llm.links.link`).  Then the members of each component are compared
    with each other by block products, which counts every link of a vector once; a component of
    more than 4096 classes is dealt to tasks of two blocks, and counts leave a task, never its
    pairs.  Links are exact within a component; recall is that of the hashing.

    Returns vec_id, n_links, component_id (least vec_id reachable) and kept (vec_id =
    component_id), a row per input row.  Vectors that are null, empty, zero or hold null or
    non-finite components have no links; vectors of different lengths do not link; repeated rows
    link with each other; extra columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(_units(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")))
    classes = (
        rows.filter(F.col("cid").isNotNull())
        .groupBy(F.col("cid").alias("v"))
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    )
    classes = cut_lineage(classes)
    size = classes.agg(F.count(F.lit(1)), F.max(F.length("unit"))).first()
    width = max(LEAST_SIZE, 1 << ((size[1] or 8) // 8 - 1).bit_length())
    parts = max(1, math.ceil(math.log(max(2.0, size[0] / per_bucket)) / math.log(2 * width)))
    hashed = cut_lineage(_keys(classes, tables, parts, probes))
    placed = hashed.select("v", F.explode(F.array_distinct("keys")).alias("key"))
    shared = shared_keys(placed)
    members = cut_lineage(placed.join(shared, "key", "left_semi"))
    release(hashed, shared)
    labels = link(members, lambda held: _wanted(classes, held), cosine(threshold))
    release(members)
    sizes = cut_lineage(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        labels.join(sizes, "component")
        .withColumn("part", F.pmod(F.xxhash64("v", F.lit("block")), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "v")
    )
    tasks = dealt.join(classes.select("v", "copies", "unit"), "v")
    tasks = tasks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = cut_lineage(_counts(tasks, threshold).groupBy("v").agg(F.sum("links").alias("links")))
    named = classes.select("v", "rep", "copies").join(labels, "v", "left").join(links, "v", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "v")))
    least = cut_lineage(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("of")).filter("of > 1").drop("of"))
    of_class = named.join(least, "component", "left").select(
        F.col("v").alias("cid"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    out = rows.select("vec_id", "cid").join(of_class, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    out = cut_lineage(
        out.select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        )
    )
    release(rows, classes, labels, sizes, links, named, least)
    return out
