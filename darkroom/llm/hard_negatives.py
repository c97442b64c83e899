"""Hard negatives of anchor vectors by product quantisation with residual bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import cut_lineage, map_arrow, owned, release
from darkroom.operators.order import placed
from darkroom.sources.scratch import write, written

#: Components of a subvector, and centroids of a subspace (a code is a byte).
WIDTH, CENTROIDS = 2, 256
#: Bytes of exact vectors in a block of anchors and in the rows that a task holds.
BLOCK_BYTES = 16 << 20
#: Rows that a task holds at most, and rows whose scores are looked up at once.
HELD, STRIP = 32_768, 1024
#: Bytes of the lookup tables of the anchors that are scored together.
TABLE_BYTES = 16 << 20
NONE = np.iinfo(np.int64).min


def fit_books(sample: list[np.ndarray], rounds: int = 6, seed: int = 3) -> dict[int, np.ndarray]:
    """Centroids (subspace, centroid, component) by k-means for each length with enough sampled vectors."""
    books = {}
    for size in sorted({len(v) for v in sample}):
        rows = np.array([v for v in sample if len(v) == size], dtype=np.float32)
        if size and len(rows) >= CENTROIDS:
            parts = _parts(rows)
            books[size] = np.stack([_centroids(parts[:, m], rounds, seed + m) for m in range(parts.shape[1])])
    return books


def _parts(rows: np.ndarray) -> np.ndarray:
    """(row, subspace, component), the last subvector filled up with zeros."""
    spare = -rows.shape[1] % WIDTH
    return np.pad(rows, ((0, 0), (0, spare))).reshape(len(rows), -1, WIDTH)


def _centroids(points: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    found = points[np.random.default_rng(seed).choice(len(points), CENTROIDS, replace=False)]
    for _ in range(rounds):
        near = _nearest(points, found)
        count = np.bincount(near, minlength=CENTROIDS)
        for c in range(points.shape[1]):
            total = np.bincount(near, weights=points[:, c], minlength=CENTROIDS)
            found[:, c] = np.where(count > 0, total / np.maximum(count, 1), found[:, c])
    return found.astype(np.float32)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * (points @ centroids.T)).argmin(axis=1)


def encode(rows: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of integer vectors, and how far a looked-up score of an anchor of length 1 may be from the true one.

    That reach is the norm of the residual, which Cauchy and Schwarz bound the difference by, plus
    what rounding adds to a sum of single precision numbers.
    """
    if book is None:
        return np.zeros((len(rows), 0), dtype=np.uint8), np.sqrt((rows**2).sum(axis=1)) * (1 + 1e-6)
    parts = _parts(rows)
    codes = np.stack([_nearest(parts[:, m].astype(np.float32), book[m]) for m in range(len(book))], axis=1)
    near = book[np.arange(len(book)), codes].astype(np.float64)
    residual = np.sqrt(((parts - near) ** 2).sum(axis=(1, 2)))
    rounding = (len(book) + 8) * 2.0**-22 * (np.sqrt((near**2).sum(axis=(1, 2))) + residual)
    return codes.astype(np.uint8), (residual + rounding) * (1 + 1e-5)


def _integers(column: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, floor(scale * vector)) by vector length; only vectors that are whole, finite and shorter than 2^31."""
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid())
    values = column.values.to_numpy(zero_copy_only=False)  # a null is not a number
    starts = column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes[valid]).tolist():
        at = np.flatnonzero(valid & (sizes == size))
        raw = values[starts[at][:, None] + np.arange(size)].astype(np.float64)
        good = np.isfinite(raw).all(axis=1) & (np.abs(raw).max(axis=1, initial=0) < 2.0**31)
        whole = np.floor(scale * raw[good])
        short = (whole**2).sum(axis=1) < 2.0**62 * (1 - 1e-9)
        yield at[good][short], whole[short]


def _sampled(vectors: DataFrame, rows: int, of: int, scale: int) -> list[np.ndarray]:
    """About ``rows`` vectors, which only choose the centroids: no result depends on them."""
    some = vectors.select("embedding")
    if of > rows:
        some = some.sample(fraction=min(1.0, rows / of), seed=5).limit(2 * rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [v.astype(np.float32).tobytes() for _, whole in _integers(batch.column(0), scale) for v in whole]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["v"])

    return [np.frombuffer(r["v"], dtype=np.float32) for r in map_arrow(some, run, "v binary").collect()]


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ROWS = "vec_id long, label long, anchor boolean, size int, exact binary, code binary, reach double, twin_a long, twin_b long"


def _encoded(vectors: DataFrame, books: dict[int, np.ndarray], scale: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, sizes, exact, code, reach, twins = [], [], [], [], [], []
        label = batch.column("label").to_numpy()
        for at, whole in _integers(batch.column("embedding"), scale):
            size = whole.shape[1]
            codes, far = encode(whole, shared.value.get(size))
            raw = [v.tobytes() for v in whole.astype(np.int32)]
            places.append(at)
            sizes += [size] * len(at)
            exact += raw
            code += [c.tobytes() for c in codes]
            reach.append(far)
            twins += [xxhash.xxh3_128_digest(r, seed=int(label[p]) & (2**64 - 1)) for p, r in zip(at.tolist(), raw)]
        at = np.concatenate([np.zeros(0, np.int64), *places])
        own = batch.select(["vec_id", "label", "anchor"]).take(pa.array(at))
        twin = np.frombuffer(b"".join(twins), dtype=np.int64).reshape(-1, 2)
        added = [pa.array(sizes, pa.int32()), pa.array(exact, pa.binary()), pa.array(code, pa.binary()), pa.array(np.concatenate([np.zeros(0), *reach])),
                 pa.array(twin[:, 0].copy()), pa.array(twin[:, 1].copy())]
        return pa.RecordBatch.from_arrays([*own.columns, *added], [f.split()[0] for f in ROWS.split(", ")])

    out = cut_lineage(map_arrow(vectors.select("vec_id", "label", "anchor", "embedding"), run, ROWS))
    shared.destroy()
    return out


@dataclass
class Best:
    """The first ``k`` of what each key has met, by falling score, then id."""

    keys: int
    k: int

    def __post_init__(self) -> None:
        self.score = np.full((self.keys, self.k), NONE)
        self.id = np.zeros((self.keys, self.k), dtype=np.int64)

    def least(self, keys: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What a score has to reach: that of the k-th, or the least number while there are fewer."""
        return self.score[keys, -1]

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(key)
        was = self.score[some].ravel() != NONE
        key = np.concatenate([key, np.repeat(some, self.k)[was]])
        score = np.concatenate([score, self.score[some].ravel()[was]])
        ids = np.concatenate([ids, self.id[some].ravel()[was]])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        first = rank < self.k
        self.score[some], self.id[some] = NONE, 0
        self.score[key[first], rank[first]] = score[first]
        self.id[key[first], rank[first]] = ids[first]


class Rows:
    """Rows of one vector length that a task holds, sorted by label."""

    def __init__(self, table: pa.Table, size: int, keep: int):
        ids, label, a, b = (table.column(c).to_numpy() for c in ("vec_id", "label", "twin_a", "twin_b"))
        # Of rows with equal label and vector, those come first that have lesser ids: after `keep`
        # others of which one id may be the anchor's own, a row is in no result.
        order = np.lexsort((ids, b, a))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        new = first.copy()
        new[1:] |= ids[order][1:] != ids[order][:-1]
        every = np.arange(len(order))
        copy = every - np.maximum.accumulate(np.where(new, every, 0))
        other = np.cumsum(new) - np.cumsum(new)[np.maximum.accumulate(np.where(first, every, 0))]
        wanted = np.sort(order[(copy < keep) & (other <= keep)])
        wanted = wanted[np.argsort(label[wanted], kind="stable")]
        table = table.take(pa.array(wanted))
        self.id, self.label, self.reach = ids[wanted], label[wanted], table.column("reach").to_numpy().astype(np.float32) * np.float32(1 + 1e-6)
        self.exact = np.frombuffer(b"".join(table.column("exact").to_pylist()), dtype=np.int32).reshape(len(wanted), size)
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint8).reshape(len(wanted), -1) if len(wanted) else np.zeros((0, 0), np.uint8)


@dataclass
class Anchors:
    """A block of anchors of one length; ``low`` and ``high`` are the windows of their positives."""

    id: np.ndarray
    label: np.ndarray
    exact: np.ndarray
    book: np.ndarray | None
    positive_id: np.ndarray | None = None
    positive_score: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def together(self) -> int:
        """How many anchors' lookup tables are held at once."""
        return max(1, min(512, TABLE_BYTES // (4 * CENTROIDS * max(1, 0 if self.book is None else len(self.book)))))

    def tables(self, some: np.ndarray) -> np.ndarray:
        """(subspace, centroid, anchor) products."""
        if self.book is None:
            return np.zeros((0, CENTROIDS, len(some)), dtype=np.float32)
        parts = _parts(self.exact[some].astype(np.float32))
        return np.matmul(self.book, parts.transpose(1, 2, 0))

    def norms(self, some: np.ndarray) -> np.ndarray:
        return (np.sqrt((self.exact[some].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)).astype(np.float32)


def _bounds(tables: np.ndarray, norms: np.ndarray, code: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the score of each row with each anchor can be."""
    score = np.zeros((len(code), len(norms)), dtype=np.float32)
    for m in range(code.shape[1]):
        score += tables[m].take(code[:, m], axis=0)
    error = reach[:, None] * norms
    return score - error, score + error


def _exact(rows: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows i and anchors j; sums wrap, and results fit as norms are below 2^31."""
    out = np.empty(len(i), dtype=np.int64)
    step = max(1, (4 << 20) // max(1, rows.shape[1]))
    for low in range(0, len(i), step):
        at = slice(low, low + step)
        out[at] = np.einsum("ij,ij->i", rows[i[at]].astype(np.int64), anchors[j[at]].astype(np.int64))
    return out


def _below(values: np.ndarray) -> np.ndarray:
    """Single precision numbers that are no greater."""
    return (values - np.abs(values) * 1e-6).astype(np.float32)


def _above(values: np.ndarray) -> np.ndarray:
    return (values + np.abs(values) * 1e-6).astype(np.float32)


def add_positives(rows: Rows, anchors: Anchors, best: Best) -> None:
    """Rows of an anchor's label, other than itself, that may be among its best."""
    for label in np.intersect1d(rows.label, anchors.label).tolist():
        begin, end = np.searchsorted(rows.label, [label, label + 1]) if label < np.iinfo(np.int64).max else (np.searchsorted(rows.label, label), len(rows.label))
        own = np.flatnonzero(anchors.label == label)
        for low in range(0, len(own), anchors.together()):
            some = own[low : low + anchors.together()]
            tables, norms = anchors.tables(some), anchors.norms(some)
            for start in range(begin, end, STRIP):
                at = slice(start, min(end, start + STRIP))
                least, most = _bounds(tables, norms, rows.code[at], rows.reach[at])
                for i in np.flatnonzero(np.isin(rows.id[at], anchors.id[some])):
                    itself = anchors.id[some] == rows.id[at][i]
                    least[i, itself] = most[i, itself] = -np.inf
                bar = np.where(best.least(some) == NONE, -np.inf, best.least(some).astype(np.float64))
                if np.isinf(bar).any() and len(least) > best.k:
                    bar = np.maximum(bar, np.partition(least, len(least) - best.k, axis=0)[len(least) - best.k])
                i, j = np.nonzero((most >= _below(np.nan_to_num(bar, neginf=-1e38))) & np.isfinite(most))
                if len(i):
                    score = _exact(rows.exact[at], anchors.exact[some], i, j)
                    best.add(some[j], score, rows.id[at][i])


def add_negatives(rows: Rows, anchors: Anchors, best: Best) -> None:
    """Rows of other labels that may be among the first of a window.  A key is anchor * positives + positive."""
    wide = anchors.low.shape[1]
    every = np.flatnonzero((anchors.low <= anchors.high).any(axis=1))
    for low in range(0, len(every), anchors.together()):
        some = every[low : low + anchors.together()]
        tables, norms = anchors.tables(some), anchors.norms(some)
        open_ = anchors.low[some] <= anchors.high[some]
        most_wanted = _above(np.where(open_, anchors.high[some].astype(np.float64), -1e38).max(axis=1))
        keys = some[:, None] * wide + np.arange(wide)
        by_label: dict[int, list[int]] = {}
        for j, value in enumerate(anchors.label[some].tolist()):
            by_label.setdefault(value, []).append(j)
        for start in range(0, len(rows.id), STRIP):
            at = slice(start, start + STRIP)
            least, most = _bounds(tables, norms, rows.code[at], rows.reach[at])
            floor = np.maximum(anchors.low[some], best.least(keys))
            bar = _below(np.where(open_, floor.astype(np.float64), 1e38).min(axis=1))
            may = (most >= bar) & (least <= most_wanted)
            labels, firsts = np.unique(rows.label[at], return_index=True)
            for value, begin, end in zip(labels.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(least)]):
                if value in by_label:
                    may[begin:end, by_label[value]] = False
            i, j = np.nonzero(may)
            if not len(i):
                continue
            score, ids = _exact(rows.exact[at], anchors.exact[some], i, j), rows.id[at][i]
            for p in range(wide):
                good = open_[j, p] & (score >= floor[j, p]) & (score <= anchors.high[some][j, p]) & (ids != anchors.id[some][j])
                if good.any():
                    best.add(keys[j[good], p], score[good], ids[good])


def _scan(rows: DataFrame, anchors: dict[int, Anchors], add, keys: str, wide: int, k: int) -> DataFrame:
    """(size, key, id, score): the first ``k`` of each key (``wide`` an anchor) among the rows of a task.

    The block of anchors is broadcast, which its size in bytes bounds; rows are read where they lie.
    """
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(len(a.id) * wide, k) for size, a in shared.value.items()}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table.column("size").to_numpy()
            for size in np.intersect1d(sizes, list(best)).tolist():
                add(Rows(table.take(pa.array(np.flatnonzero(sizes == size))), size, k), shared.value[size], best[size])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= HELD or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                    flush()
        if held:
            flush()
        for size, found in best.items():
            key, place = np.nonzero(found.score != NONE)
            if len(key):
                columns = [np.full(len(key), size, dtype=np.int32), key.astype(np.int64), found.id[key, place], found.score[key, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "key", "id", "score"])

    found = rows.select(*(f.split()[0] for f in ROWS.split(", "))).drop("anchor").mapInArrow(run, "size int, key long, id long, score long")
    first = Window.partitionBy("size", "key").orderBy(F.col("score").desc(), "id")
    out = cut_lineage(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))
    shared.destroy()
    return out


@owned
def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    sample_rows: int = 8192,
    block_rows: int = 8192,
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding) where ``anchor`` holds.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor;
    higher scores come first, ties by lesser vec_id.  An anchor's positives are its first
    ``positives`` rows of the same label and another vec_id; for each, the negatives are the first
    ``negatives`` rows of another label and vec_id with low * positive_score <= 100 * score <=
    high * positive_score.  Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score and negative_score; a positive without negatives gives no row.

    Vectors are product-quantised: subvectors of two components, 256 centroids each, fitted on about
    ``sample_rows`` rows, with the norm of what the code leaves out.  Anchors are dealt to blocks of at
    most ``block_rows`` rows and 16 MB.  For each block every task looks scores up by code; where
    score plus or minus residual norm times anchor norm cannot meet a window or what already fills
    it, a row is passed over, and all others are scored exactly.  Two passes a block, the first for
    positives; only the first few rows of a window leave a task.  The sample and the blocks decide
    about speed, never about results.

    Rows with a null label, vec_id or vector, a null or non-finite component, or a scaled vector 2^31
    long or more, take no part; vectors of different lengths do not meet.  Repeated rows count each,
    an anchor's repeats as anchors of their own.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    books = fit_books(_sampled(vectors, sample_rows, vectors.count(), scale))
    rows = _encoded(vectors, books, scale)
    ranked = cut_lineage(placed(rows.filter("anchor").select("size", "vec_id", "label", "exact"), [], [F.col("size"), F.col("vec_id"), F.col("label"), F.col("exact")], "place"))
    count, longest = ranked.agg(F.count(F.lit(1)), F.max("size")).first()
    block = max(1, min(block_rows, BLOCK_BYTES // (4 * max(1, longest or 0))))
    folder = write(spark.createDataFrame([], SCHEMA))
    for start in range(0, count, block):
        anchors = _block(ranked.filter(F.col("place").between(start, start + block - 1)), books)
        found = _scan(rows, anchors, add_positives, "anchor", 1, positives)
        _windows(anchors, found.collect(), positives, low, high)  # at most `positives` rows an anchor of the block
        release(found)
        found = _scan(rows, anchors, add_negatives, "window", positives, negatives)
        _append(found, anchors, positives, folder)
        release(found)
    release(rows, ranked)
    return written(spark, SCHEMA, folder)


def _block(rows: DataFrame, books: dict[int, np.ndarray]) -> dict[int, Anchors]:
    """The anchors of a block by length; ``block`` rows and 16 MB at most reach the driver."""
    by_size: dict[int, list] = {}
    for r in rows.orderBy("place").collect():
        by_size.setdefault(r["size"], []).append(r)
    return {
        size: Anchors(
            np.array([r["vec_id"] for r in some], dtype=np.int64), np.array([r["label"] for r in some], dtype=np.int64),
            np.frombuffer(b"".join(r["exact"] for r in some), dtype=np.int32).reshape(len(some), size), books.get(size),
        )
        for size, some in by_size.items()
    }


def _windows(anchors: dict[int, Anchors], found: list, positives: int, low: int, high: int) -> None:
    for a in anchors.values():
        a.positive_id = np.zeros((len(a.id), positives), dtype=np.int64)
        a.positive_score = np.zeros_like(a.positive_id)
        a.low, a.high = np.ones_like(a.positive_id), np.zeros_like(a.positive_id)
    for r in found:
        a, at = anchors[r["size"]], (r["key"], r["rank"] - 1)
        a.positive_id[at], a.positive_score[at] = r["id"], r["score"]
        # Whole numbers n with low * score <= 100 * n <= high * score, in Python's unbounded integers.
        least, most = -(-low * r["score"] // 100), high * r["score"] // 100
        if least <= most:
            a.low[at], a.high[at] = max(least, NONE + 1), min(most, np.iinfo(np.int64).max)


def _append(found: DataFrame, anchors: dict[int, Anchors], positives: int, folder: str) -> None:
    """Write the rows of a block with the ids behind its keys, which are as bounded as the block."""
    shared = found.sparkSession.sparkContext.broadcast(
        {size: (a.id, a.positive_id.ravel(), a.positive_score.ravel()) for size, a in anchors.items()}
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, size = batch.column("key").to_numpy(), batch.column("size").to_numpy()
        out = np.zeros((3, len(key)), dtype=np.int64)
        for one in np.unique(size).tolist():
            at = size == one
            ids, positive, score = shared.value[one]
            out[:, at] = ids[key[at] // positives], positive[key[at]], score[key[at]]
        columns = [pa.array(out[0]), pa.array(out[1]), batch.column("rank"), batch.column("id"), pa.array(out[2]), batch.column("score")]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    write(map_arrow(found, run, SCHEMA), folder)
    shared.destroy()


#: DuckDB SQL for the query over ``embeddings``.  Sums of whole numbers are exact in double precision here.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""
