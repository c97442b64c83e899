"""Jaccard self-join of documents on word n-grams by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import (
    Membership,
    broadcast,
    cut_lineage,
    keyed,
    map_arrow,
    map_texts,
    membership,
    owned,
    release,
    slices,
    texts_of,
    without,
)
from darkroom.llm.links import SKETCH, jaccard, link, long_sketch, most_apart, parity_sketch
from darkroom.llm.shingles import mix, shingle_set, signed, word_hashes

#: Ways to cut keys, by cost: parts of a group, and the ratio of the upper to the lower size of a band.
PLANS = ((3, 1.5), (4, 1.5), (4, 1.2), (5, 1.2), (6, 1.2))
#: What :func:`key_plan` asks of the exponent of two unrelated sets' chance to agree in a key.
LEAST_EXPONENT = 11.0
#: Bits of a part of the parity sketch.
PART_BITS = 64
#: Bits of a key that are counted; the others only tell keys apart later.
COUNTED_BITS = 48
_PLACES = np.random.default_rng(20240613).integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_plan(percent: int) -> tuple[int, float]:
    """The cheapest of PLANS under which unrelated sets hardly agree in a key by empty parts alone.

    Linked sets of n shingles differ in d = 2 n (100 - percent) / (100 + percent).  With q parts in
    each of d / 2 groups a part holds 2 n / (q d) shingles, less by the ratio of the band at its
    lower end, and all parts but one of a group are empty in two sets with probability
    exp(-2 (q - 1) times that).
    """
    for parts, ratio in PLANS:
        if 2 * (parts - 1) * (100 + percent) / (100 - percent) / parts / ratio >= LEAST_EXPONENT:
            break
    return parts, ratio


@cache
def band_edges(ratio: float, most: int) -> np.ndarray:
    """Lower sizes of the bands, up to a band that lies above ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return np.array(edges)


def parity_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a set: band, group, parts and XOR sketch of these parts, hashed to 64 bits.

    Each shingle flips one bit of one sketch, so differing bits number at most the symmetric
    difference d of two sets.  With more than d / 2 groups, one group differs in at most one bit;
    of its parts all but one then agree whole, and a key is made of each choice of all but one.
    Such keys agree by chance far less often than single segments would (see :func:`key_plan`).  A
    set has the keys of its own band and of the bands below in which a linked set may lie; the
    number of groups allows for all pairs whose smaller set lies in the band.
    """
    each, ratio = key_plan(percent)
    size = len(shingles)
    edges = band_edges(ratio, 1 << max(20, size.bit_length()))
    first, last = np.searchsorted(edges, [-(-size * percent // 100), size], side="right") - 1
    out = []
    bit, place = np.uint64(1) << (shingles & np.uint64(PART_BITS - 1)), shingles >> np.uint64(16)
    for band in range(first, last + 1):
        largest = int(edges[band + 1]) - 1
        groups = most_apart(largest, largest * 100 // percent, percent) // 2 + 1
        part = (place % np.uint64(each * groups)).astype(np.int64)
        sketch = np.zeros(each * groups, dtype=np.uint64)
        np.bitwise_xor.at(sketch, part, bit)
        # a sum of mixed parts, each with its place, less the one that is left out
        mixed = mix(sketch.reshape(-1, each) + np.arange(1, each + 1, dtype=np.uint64)) * _PLACES[:each]
        where = mix(np.arange(groups, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40)))
        left_out = mixed.sum(axis=1, dtype=np.uint64)[:, None] - mixed + np.arange(each, dtype=np.uint64)
        out.append(mix(where[:, None] + left_out).ravel())
    return np.concatenate(out)


def _each(batch: pa.RecordBatch, length: int) -> Iterator[np.ndarray]:
    for texts in texts_of(batch):
        for text in texts:
            yield shingle_set(word_hashes(text), length)


def set_rows(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_id, row, n (set size), set_id (hash of the set, null if empty), s0 to s7 and sketch.

    The sketch is null where the partition has given the set's before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sizes, ids, longs = [], [], []
            sketches = np.zeros((batch.num_rows, len(SKETCH)), dtype=np.int64)
            for row, shingles in enumerate(_each(batch, length)):
                sizes.append(len(shingles))
                ids.append(set_id(shingles) if len(shingles) else None)
                fresh = len(shingles) > 0 and ids[-1] not in seen
                longs.append(long_sketch(shingles) if fresh else None)
                if len(shingles):
                    sketches[row] = parity_sketch(shingles)
                    if len(seen) < 1_000_000:
                        seen.add(ids[-1])
            names = ["doc_id", "text_id", "row"]
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(sketches.T)), pa.array(longs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "n", "set_id", *SKETCH, "sketch"])

    words = ", ".join(f"{s} long" for s in SKETCH)
    return docs.mapInArrow(run, f"doc_id long, text_id long, row long, n long, set_id long, {words}, sketch binary")


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _members(docs: DataFrame, rows: DataFrame, length: int, percent: int) -> DataFrame:
    """Distinct (key, v) under the keys that two or more sets have.

    Of rows with equal sets one gives the keys (a bitmap may let a few more through, which only adds
    keys).  First keys are counted by partial aggregation, COUNTED_BITS of each and a count; those
    that occur twice thin out, by a bitmap, the keys that are made again and shuffled with their
    sets.  Keys are nowhere kept, as they would outweigh the texts.
    """
    spark = docs.sparkSession
    first = cut_lineage(rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row").alias("row")).select("row"))
    one = broadcast(spark, membership(first, "row"))
    release(first)
    counted = np.uint64((1 << COUNTED_BITS) - 1)

    def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        some = one.value(batch.column("row").to_numpy())
        return (s for s in _each(batch.filter(pa.array(some)), length) if len(s))

    def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros(0, dtype=np.uint64), *(parity_keys(s, percent) & counted for s in sets_of(batch))]
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found)))], ["key"])

    columns = docs.select("row", "text")
    shared = map_texts(columns, plain, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    shared = cut_lineage(shared.filter("times > 1").select("key"))
    held = broadcast(spark, membership(shared, "key", 64))

    def thin(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for shingles in sets_of(batch):
            found = parity_keys(shingles, percent)
            found = found[held.value(signed(found & counted))]
            keys.append(found)
            owners.append(np.full(len(found), set_id(shingles)))
        whole = np.concatenate(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(whole)), pa.array(signed(whole & counted)), pa.array(np.concatenate(owners))], ["key", "part", "v"]
        )

    thinned = map_texts(columns, thin, "key long, part long, v long")
    members = thinned.join(shared.withColumnRenamed("key", "part"), "part", "left_semi").select("key", "v").distinct()
    members = cut_lineage(members)
    release(shared)
    return members


def _sets(docs: DataFrame, rows: DataFrame, length: int, wanted: Membership) -> DataFrame:
    """(v, value): the shingles of the sets that ``wanted`` may hold, a row or more each.

    Only texts whose set is wanted, again by a bitmap, are split into words once more.
    """
    spark = docs.sparkSession
    held = broadcast(spark, wanted)

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = held.value(batch.column("set_id").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([batch.column("text_id").filter(pa.array(keep))], ["text_id"])

    of_texts = cut_lineage(map_arrow(rows.filter("set_id IS NOT NULL").select("text_id", "set_id"), known, "text_id long"))
    texts = broadcast(spark, membership(of_texts, "text_id"))
    release(of_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            some = texts.value(batch.column("text_id").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(some))
            ids, values = [], []
            for shingles in _each(batch, length):
                if len(shingles):
                    owner = set_id(shingles)
                    if owner not in seen and held.value(np.array([owner]))[0]:
                        ids.append(owner)
                        values.append(shingles.tobytes())
                        if len(seen) < 1_000_000:
                            seen.add(owner)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["v", "value"])

    return docs.select("text_id", "text").mapInArrow(run, "v long, value binary")


@owned
def jaccard_components(docs: DataFrame, length: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of at least ``percent``.

    Documents with equal sets are one vertex.  Candidates share a parity key (see
    :func:`parity_keys`), which misses no link; whole-document parity sketches drop most of the
    others, and the sets of what remains are compared (see :func:`darkroom.llm.links.link`).  Sets are compared by 64-bit hashes.

    ``docs`` has doc_id and text.  Returns doc_id, n_shingles and component_id, the smallest doc_id
    reachable by links, one row per input row.  Documents without words or with null text have 0
    shingles and are their own component; repeated rows are copies of each other; extra columns are
    ignored; an empty table gives no rows.
    """
    return _components(docs, length, percent).select("doc_id", "n_shingles", "component_id")


@owned
def one_of_each(docs: DataFrame, length: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id (then text hash).

    Documents without words are no copies of each other and all stay.  Rows that repeat a doc_id
    with an equal text are one document.  All columns stay, whatever their names; an empty table
    gives no rows.
    """
    rows = cut_lineage(_components(docs, length, percent).filter("n_shingles > 0"))
    name = F.struct("doc_id", "text_id")
    first = rows.groupBy("component").agg(F.min(name).alias("first"), F.max(name).alias("last"))
    more = cut_lineage(first.filter("NOT first <=> last").select("component", "first"))
    gone = rows.join(more, "component").filter(~name.eqNullSafe(F.col("first"))).select("doc_id", "text_id").distinct()
    return without(docs, gone)


def _components(docs: DataFrame, length: int, percent: int) -> DataFrame:
    """(doc_id, text_id, n_shingles, component, component_id) of every document."""
    docs = keyed(docs).withColumn("row", F.xxhash64("doc_id", "text_id"))
    rows = cut_lineage(set_rows(docs, length))
    members = _members(docs, rows, length, percent)
    about = rows.filter("sketch IS NOT NULL").groupBy(F.col("set_id").alias("v"))
    about = cut_lineage(about.agg(*(F.first(c).alias(c) for c in ("n", *SKETCH, "sketch"))))
    labels = link(members, lambda wanted: _sets(docs, rows, length, wanted), jaccard(percent), percent, about)
    release(members, about)
    named = rows.select("doc_id", "text_id", F.col("n").alias("n_shingles"), "set_id")
    named = named.join(labels.withColumnRenamed("v", "set_id"), "set_id", "left")
    named = named.withColumn("component", F.coalesce("component", "set_id")).drop("set_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("of"))
    least = cut_lineage(least.filter("component IS NOT NULL AND of > 1").drop("of"))
    return named.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


#: The same by brute force: all pairs that share a shingle, and everything reachable by links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), g AS (
  SELECT doc_id, unnest(s) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""
