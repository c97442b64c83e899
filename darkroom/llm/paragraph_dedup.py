"""Remove passages that occur again, by paragraph MinHash banding and winnowed runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import (
    WORD,
    Membership,
    attach,
    broadcast,
    cut_lineage,
    free_names,
    keyed,
    map_arrow,
    map_texts,
    membership,
    owned,
    release,
    texts_of,
)
from darkroom.llm.links import SKETCH, jaccard, link, parity_sketch, shared_keys
from darkroom.llm.shingles import WORDS, mix, runs, signed

SHINGLE = 5
#: Bands and rows: two paragraphs of similarity 0.8 share a band with probability 0.986.
BANDS, ROWS = 6, 3
_rng = np.random.default_rng(20240501)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
NONE = np.zeros(0, dtype=np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2 ** 64; of long series only what is asked for is kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= 1 << 19:
            _POWERS[base] = held
    return held[:n]


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest, by ``best``) of each ``width`` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = best(values[:-step], values[step:])
        span += step
    return values


class Texts:
    """The words of some texts in one row, and where their lines and texts end."""

    def __init__(self, texts: list[bytes]):
        words: list[bytes] = []
        counts: list[int] = []
        lines: list[int] = []
        for text in texts:
            parted = [line.split() for line in text.lower().split(b"\n")]
            lines.append(len(parted))
            counts += map(len, parted)
            for line in parted:
                words += line
        self.n = len(words)
        self.hashes = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=self.n)
        self.line_words = np.array(counts, dtype=np.int64)
        self.line_end = np.cumsum(self.line_words)
        self.lines = np.array(lines, dtype=np.int64)
        self.last_line = np.cumsum(self.lines) - 1
        self.text_end = self.line_end[self.last_line]
        self.text_start = np.r_[0, self.text_end[:-1]]

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        """Which text holds each word."""
        return np.searchsorted(self.text_end, starts, side="right")


class Units:
    """Paragraphs and blocks of some texts.

    A paragraph is a line of at least ``min_words`` words, or a run of shorter lines, as of wrapped
    text, of so many words together that a blank line, a longer line or the text's end closes.  A
    block is a run of ``block_words`` words that winnowing selects, whatever the lines and the
    punctuation, so that two texts that share ``2 * block_words`` words in a row share a block.
    Words part at ASCII blanks; A-Z count as lower case.
    """

    def __init__(self, texts: list[bytes], min_words: int, block_words: int):
        self.texts = held = Texts(texts)
        n = held.n
        short = (held.line_words > 0) & (held.line_words < min_words)
        follows = np.r_[False, short[:-1]]
        follows[held.last_line[:-1] + 1] = False  # a text's first line opens a paragraph
        opens = np.flatnonzero((held.line_words > 0) & ~(short & follows))
        start = held.line_end[opens] - held.line_words[opens]
        end = np.r_[start[1:], n] if len(opens) else start
        enough = end - start >= min_words
        self.start, self.end = start[enough], end[enough]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(held.hashes * _powers(_BASE, n), out=self.sums[1:])
        self.block_words = block_words
        self.blocks = self._blocks()

    def _ids(self, starts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """64-bit hashes of runs of words; ``kind`` keeps those of paragraphs and blocks apart."""
        value = (self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, self.texts.n + 1)[starts]
        return mix(value + (2 * (ends - starts) + kind).astype(np.uint64) * np.uint64(_INVERSE))

    def _blocks(self) -> np.ndarray:
        """First words of the blocks: the least hash of every ``block_words + 1`` runs in a row of one text."""
        size, window = self.block_words, self.block_words + 1
        n = self.texts.n - size + 1
        if n < window:
            return NONE
        every = np.arange(n)
        self.block_hashes = hashes = self._ids(every, every + size, 1)
        low = sliding(hashes, window, np.minimum)
        whole = every[: len(low)] + window - 1 + size <= self.texts.text_end[self.texts.text_of(every[: len(low)])]
        edge = np.zeros(window - 1, dtype=np.uint64)
        high = sliding(np.concatenate([edge, np.where(whole, low, np.uint64(0)), edge]), window, np.maximum)
        return np.flatnonzero(hashes == high)

    def block_ids(self) -> np.ndarray:
        return signed(self.block_hashes[self.blocks]) if len(self.blocks) else NONE

    def paragraph_ids(self) -> np.ndarray:
        return signed(self._ids(self.start, self.end, 0)) if len(self.start) else NONE

    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) shingle of each paragraph; a shorter one has one shingle."""
        return self.start, np.maximum(self.end - SHINGLE + 1, self.start + 1)

    def _shingles(self) -> np.ndarray:
        return np.append(runs(self.texts.hashes, SHINGLE), np.zeros(SHINGLE, dtype=np.uint64))

    def band_keys(self) -> np.ndarray:
        """A row of band keys for each paragraph."""
        keys = np.zeros((len(self.start), BANDS), dtype=np.uint64)
        if not len(keys):
            return keys
        start, end = self._spans()
        cuts = np.stack([start, end], axis=1).ravel()
        shingles = self._shingles()
        for band in range(BANDS):
            key = np.full(len(keys), band, dtype=np.uint64)
            for row in range(band * ROWS, (band + 1) * ROWS):
                mixed = (shingles ^ _ADD[row]) * _TIMES[row]
                key = mix(key + np.minimum.reduceat(mixed, cuts)[::2])
            keys[:, band] = key
        return keys

    def paragraph_sets(self, which: np.ndarray) -> list[np.ndarray]:
        shingles = self._shingles()
        start, end = self._spans()
        return [np.unique(shingles[a:b]) for a, b in zip(start[which], end[which])]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values))


UNITS = (
    "doc_id long, text_id long, n_words long, line_ends array<long>, p_id array<long>, p_start array<long>, "
    "p_end array<long>, p_keys array<long>, b_id array<long>, b_start array<long>"
)


def _units(docs: DataFrame, min_words: int, block_words: int) -> DataFrame:
    """Paragraphs (hash, first word, word after the last, band keys) and blocks (hash, first word) of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for texts in texts_of(batch):
            units = Units(texts, min_words, block_words)
            held, n = units.texts, len(texts)
            p_text, b_text = held.text_of(units.start), held.text_of(units.blocks)
            paragraphs, blocks = np.bincount(p_text, minlength=n), np.bincount(b_text, minlength=n)
            ends = held.line_end - np.repeat(held.text_start, held.lines)
            columns = [
                pa.array(held.text_end - held.text_start),
                _lists(ends, held.lines),
                _lists(units.paragraph_ids(), paragraphs),
                _lists(units.start - held.text_start[p_text], paragraphs),
                _lists(units.end - held.text_start[p_text], paragraphs),
                _lists(signed(units.band_keys().ravel()), paragraphs * BANDS),
                _lists(units.block_ids(), blocks),
                _lists(units.blocks - held.text_start[b_text], blocks),
            ]
            parts.append(pa.RecordBatch.from_arrays(columns, ["n_words", "line_ends", "p_id", "p_start", "p_end", "p_keys", "b_id", "b_start"]))
        found = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        names = ["doc_id", "text_id"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found.columns], [*names, *found.schema.names])

    return map_texts(docs, run, UNITS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), rows


def _places(units: DataFrame) -> DataFrame:
    """(key, v): band keys with their paragraph, paragraphs and blocks with their place in a text.

    Places do not tell documents of equal text apart.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = mix(batch.column("text_id").to_numpy(zero_copy_only=False).view(np.uint64))
        keys, owners = [], []
        paragraphs, _ = _flat(batch.column("p_id"))
        keys.append(_flat(batch.column("p_keys"))[0])
        owners.append(np.repeat(paragraphs, BANDS))
        for name, start in (("p_id", "p_start"), ("b_id", "b_start")):
            ids, rows = _flat(batch.column(name))
            keys.append(ids)
            owners.append(signed(texts[rows] + _flat(batch.column(start))[0].view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "v"])

    return map_arrow(units.select("text_id", "p_id", "p_start", "p_keys", "b_id", "b_start"), run, "key long, v long")


def _members(units: DataFrame, shared: DataFrame, held) -> DataFrame:
    """Distinct (key, v) of paragraphs under the band keys that two or more have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _flat(batch.column("p_keys"))[0]
        keep = held.value(keys)
        owners = np.repeat(_flat(batch.column("p_id"))[0], BANDS)
        both = np.unique(np.stack([keys[keep], owners[keep]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["key", "v"])

    thinned = map_arrow(units.select("p_id", "p_keys"), run, "key long, v long")
    return cut_lineage(thinned.join(shared, "key", "left_semi").distinct())


def _sets(docs: DataFrame, units: DataFrame, min_words: int, block_words: int, wanted: Membership) -> DataFrame:
    """(v, value, n, s0 to s7): shingles, their number and parity sketch of the paragraphs that ``wanted`` may hold."""
    spark = docs.sparkSession
    held = broadcast(spark, wanted)

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = _flat(batch.column("p_id"))
        some = np.unique(rows[held.value(ids)])
        return pa.RecordBatch.from_arrays([batch.column("text_id").take(pa.array(some))], ["text_id"])

    of_texts = cut_lineage(map_arrow(units.select("text_id", "p_id"), known, "text_id long"))
    texts = broadcast(spark, membership(of_texts, "text_id"))
    release(of_texts)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(texts.value(batch.column("text_id").to_numpy(zero_copy_only=False))))
        found: dict[int, np.ndarray] = {}
        for some in texts_of(batch):
            units = Units(some, min_words, block_words)
            ids = units.paragraph_ids()
            _, first = np.unique(ids, return_index=True)
            which = first[held.value(ids[first])] if len(first) else first
            found |= zip(ids[which].tolist(), units.paragraph_sets(which))
        sketches = np.array([parity_sketch(s) for s in found.values()]).reshape(-1, len(SKETCH))
        columns = [
            pa.array(found.keys(), pa.int64()),
            pa.array([s.tobytes() for s in found.values()], pa.binary()),
            pa.array([len(s) for s in found.values()], pa.int64()),
            *(pa.array(np.ascontiguousarray(c)) for c in sketches.T),
        ]
        return pa.RecordBatch.from_arrays(columns, ["v", "value", "n", *SKETCH])

    words = ", ".join(f"{s} long" for s in SKETCH)
    return map_texts(docs.select("text_id", "text"), run, f"v long, value binary, n long, {words}")


def _occurrences(units: DataFrame, block_words: int, held, near) -> DataFrame:
    """(v, doc_id, text_id, start, end, whole) of units whose hash may occur twice (``held``) or be
    that of a paragraph with a like one (``near``), of one document per text.

    start and end count the words of the text; ``whole`` is true of paragraphs.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        columns, counts = [], np.zeros(n, dtype=np.int64)
        paragraph, p_row = _flat(batch.column("p_id"))
        block, b_row = _flat(batch.column("b_id"))
        ids, rows = np.concatenate([paragraph, block]), np.concatenate([p_row, b_row])
        start = np.concatenate([_flat(batch.column(c))[0] for c in ("p_start", "b_start")])
        end = np.concatenate([_flat(batch.column("p_end"))[0], start[len(paragraph) :] + block_words])
        whole = np.arange(len(ids)) < len(paragraph)
        some = np.flatnonzero(held.value(ids) | near.value(ids))
        some = some[np.argsort(rows[some], kind="stable")]
        counts = np.bincount(rows[some], minlength=n)
        columns = [_lists(values[some], counts) for values in (ids, start, end, whole)]
        out = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_id"), *columns], ["doc_id", "text_id", "v", "start", "end", "whole"]
        )
        return out.filter(pa.array(counts > 0))

    lists = "v array<long>, start array<long>, end array<long>, whole array<boolean>"
    hits = map_arrow(units.drop("n_words", "line_ends", "p_keys"), run, f"doc_id long, text_id long, {lists}")
    names = ("v", "start", "end", "whole")
    once = hits.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in names))
    return once.select("doc_id", "text_id", F.inline(F.arrays_zip(*names)))


def _surroundings(docs: DataFrame, reach: int, places: DataFrame) -> DataFrame:
    """(text_id, at, before, after): hashes of up to ``reach`` words on both sides of word ``at``, for
    at least the (text_id, at) of ``places``."""
    spark = docs.sparkSession
    spots = cut_lineage(places.select("text_id", F.col("text_id").bitwiseXOR(F.col("at")).alias("spot")))
    texts, held = broadcast(spark, membership(spots, "text_id")), broadcast(spark, membership(spots, "spot", 64))
    release(spots)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(texts.value(batch.column("text_id").to_numpy(zero_copy_only=False))))
        ids: list[int] = []
        at: list[int] = []
        before: list[bytes] = []
        after: list[bytes] = []
        names = iter(batch.column("text_id").to_pylist())
        for some in texts_of(batch):
            found = Texts(some)
            for low, high, text_id in zip(found.text_start.tolist(), found.text_end.tolist(), names):
                spot = np.flatnonzero(held.value(np.arange(high - low + 1) ^ np.int64(text_id))).tolist()
                ids += [text_id] * len(spot)
                at += spot
                before += [found.hashes[max(low, low + s - reach) : low + s].tobytes() for s in spot]
                after += [found.hashes[low + s : min(high, low + s + reach)].tobytes() for s in spot]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
            ["text_id", "at", "before", "after"],
        )

    found = map_texts(docs.select("text_id", "text"), run, "text_id long, at long, before binary, after binary")
    return cut_lineage(found.groupBy("text_id", "at").agg(F.first("before").alias("before"), F.first("after").alias("after")))


def _ends(later: DataFrame) -> DataFrame:
    """The first and the last of the blocks of a text that touch, with the places beside them.

    (doc_id, text_id, at, left, component, kept, o_text, o_at, room): ``at`` is the word where the
    block begins (left) or ends, ``o_at`` the like word of the first place, ``room`` the most words
    that may be added where both places lie in one text.
    """
    span = F.struct("start", "end", "component", "kept", "o_text", "o_start")
    of_text = later.filter("NOT whole").groupBy("doc_id", "text_id").agg(F.collect_list(span).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("spans")
        flat = lists.flatten()
        row = _flat(lists)[1]
        start, end, component, o_text, o_start = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "component", "o_text", "o_start"))
        kept = flat.field("kept")
        order = np.lexsort((component, end, start, row))
        start, end, row, component, o_text, o_start = (x[order] for x in (start, end, row, component, o_text, o_start))
        kept = kept.take(pa.array(order))
        # texts stand apart in one row of words, so that one running maximum serves all
        width = int(end.max(initial=0)) + 2
        reach = np.maximum.accumulate(end + row * width)
        opens = np.r_[True, reach[:-1] < (start + row * width)[1:]][: len(start)]
        closes = np.r_[opens[1:], True][: len(start)]
        # of spans that touch, the one that reaches furthest closes
        group = np.cumsum(opens) - 1
        last = np.lexsort((start, end, group))
        last = last[np.flatnonzero(closes)] if len(last) else last
        first = np.flatnonzero(opens)
        which = np.concatenate([first, last])
        left = np.arange(len(which)) < len(first)
        at = np.where(left, start[which], end[which])
        o_at = o_start[which] + np.where(left, 0, end[which] - start[which])
        ids = batch.column("text_id").to_numpy(zero_copy_only=False)[row[which]]
        room = np.where(left & (ids == o_text[which]), at - (o_start[which] + end[which] - start[which]), 1 << 40)
        owner = pa.array(row[which])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(owner), batch.column("text_id").take(owner), pa.array(at), pa.array(left),
                pa.array(component[which]), kept.take(pa.array(which)), pa.array(o_text[which]), pa.array(o_at), pa.array(room),
            ],
            ["doc_id", "text_id", "at", "left", "component", "kept", "o_text", "o_at", "room"],
        )

    fields = "doc_id long, text_id long, at long, left boolean, component long, kept long, o_text long, o_at long, room long"
    return cut_lineage(map_arrow(of_text, run, fields))


def _extensions(docs: DataFrame, later: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_id, start, end, component, kept): words next to blocks that also stand next to the first place.

    Blocks that a shared run selects leave fewer than ``reach`` words at its ends, so only the first
    and the last of blocks that touch are extended.
    """
    ends = _ends(later)
    places = ends.select("text_id", "at").unionAll(ends.select(F.col("o_text").alias("text_id"), F.col("o_at").alias("at")))
    around = _surroundings(docs, reach, places)
    beside = around.select(F.col("text_id").alias("o_text"), F.col("at").alias("o_at"), F.col("before").alias("o_before"), F.col("after").alias("o_after"))
    both = ends.join(around, ["text_id", "at"]).join(beside, ["o_text", "o_at"])

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = []
        sides = (batch.column(c) for c in ("left", "before", "o_before", "after", "o_after"))
        for left, before, o_before, after, o_after in zip(*sides):
            pair = (before, o_before) if left.as_py() else (after, o_after)
            a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pair)
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1] if left.as_py() else a[:n] != b[:n])
            lengths.append(int(differ[0]) if len(differ) else n)
        # a copy in the text of the first place may not grow over it
        n = np.minimum(np.array(lengths, dtype=np.int64), batch.column("room").to_numpy(zero_copy_only=False))
        at, left = batch.column("at").to_numpy(), batch.column("left").to_numpy(zero_copy_only=False)
        names = ("doc_id", "text_id", "component", "kept")
        out = [*(batch.column(c) for c in names), pa.array(np.where(left, at - n, at)), pa.array(np.where(left, at, at + n))]
        return pa.RecordBatch.from_arrays(out, [*names, "start", "end"]).filter(pa.array(n > 0))

    out = cut_lineage(map_arrow(both, compare, "doc_id long, text_id long, component long, kept long, start long, end long"))
    release(ends, around)
    return out


@owned
def repeated_passages(docs: DataFrame, min_words: int = 20, block_words: int = 25, percent: int = 80) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that another place holds already.

    Documents of at least ``min_words`` words whose text equals that of a document of smaller id go
    whole.  The others' paragraphs whose 5-word shingle sets have a Jaccard similarity of at least
    ``percent`` are linked: candidates share a MinHash band, the sets of candidates are compared,
    and linked paragraphs form components.  Equal paragraphs and equal blocks (see :class:`Units`)
    are linked as well, so that any equal passage of at least twice ``block_words`` words is found
    wherever it stands, whatever its lines and punctuation.  Of each component the first place by
    doc_id and word stays.  Later blocks are extended both ways as far as they agree with the first
    place; words at a passage's end that agree with another place only may stay.  A passage inside
    other text that differs in some word of every ``block_words`` is not looked for.

    Returns a row for each run of words of a line to remove: doc_id, text_id (hash of the text),
    line, start, n_words, kept_doc_id (where the content stays) and component_id (the component's
    least content hash).  Rows that repeat a doc_id with an equal text are one document.  Null and
    empty texts have no passages; extra columns are ignored; an empty table gives no rows.
    """
    docs = keyed(docs)
    spark = docs.sparkSession
    units = cut_lineage(_units(docs, min_words, block_words))
    shared = shared_keys(_places(units))
    held = broadcast(spark, membership(shared, "key"))
    members = _members(units, shared, held)
    release(shared)
    sets = _sets(docs, units, min_words, block_words, membership(members, "v"))
    sets = cut_lineage(sets.groupBy("v").agg(*(F.first(c).alias(c) for c in ("value", "n", *SKETCH))))
    labels = link(members, lambda wanted: sets.select("v", "value"), jaccard(percent), percent, sets.select("v", "n", *SKETCH))
    release(members, sets)
    near = broadcast(spark, membership(labels, "v"))
    found = _occurrences(units, block_words, held, near).join(labels, "v", "left")
    found = cut_lineage(found.withColumn("component", F.coalesce("component", "v")).drop("v"))
    release(labels)
    place = F.struct("doc_id", "text_id", "start", "end")
    first = found.groupBy("component").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = cut_lineage(first.filter("NOT first <=> last").select("component", "first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    later = found.join(first, "component").filter(~same | (F.col("start") >= F.col("first.end")))
    later = cut_lineage(
        later.select(
            "doc_id", "text_id", "start", "end", "whole", "component", F.col("first.doc_id").alias("kept"),
            F.col("first.text_id").alias("o_text"), F.col("first.start").alias("o_start"),
        )
    )
    release(found, first)
    more = _extensions(docs, later, block_words)
    columns = ("doc_id", "text_id", "start", "end", "component", "kept")
    spans = cut_lineage(later.select(*columns).unionAll(more.select(*columns)).unionAll(_copies(units, min_words).select(*columns)))
    release(later, more)
    out = cut_lineage(_runs(units, spans))
    release(units, spans)
    return out


def _copies(units: DataFrame, min_words: int) -> DataFrame:
    """Whole texts, as spans, of the documents whose text another of smaller id has."""
    rows = units.filter(F.col("n_words") >= min_words).select("doc_id", "text_id", "n_words")
    kept = rows.groupBy("text_id").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("last"), F.count("doc_id").alias("of"), F.count(F.lit(1)).alias("all"))
    kept = cut_lineage(kept.filter("kept < last OR of < all AND of > 0").select("text_id", "kept"))
    later = rows.join(kept, "text_id").filter(~F.col("doc_id").eqNullSafe(F.col("kept"))).distinct()
    return later.select(
        "doc_id", "text_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.col("text_id").alias("component"), "kept"
    )


def _runs(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Join overlapping and touching spans of a text that one document keeps, and part them by line."""
    of_text = spans.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end", "component", "kept")).alias("spans"))
    held = broadcast(spans.sparkSession, membership(spans, "text_id"))

    def known(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value(batch.column("text_id").to_numpy(zero_copy_only=False))))

    lines = map_arrow(units.select("text_id", "line_ends"), known, "text_id long, line_ends array<long>")
    lines = cut_lineage(lines.groupBy("text_id").agg(F.first("line_ends").alias("line_ends")))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, kepts, components, line, first_word, length = [], [], [], [], [], []
        for row, (spans, ends) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("line_ends"))):
            ends = ends.values.to_numpy()
            by_kept: dict[int | None, list] = {}
            for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
                joined = by_kept.setdefault(span["kept"], [])
                if joined and joined[-1][1] >= span["start"]:
                    joined[-1][1] = max(joined[-1][1], span["end"])
                    joined[-1][2] = min(joined[-1][2], span["component"])
                else:
                    joined.append([span["start"], span["end"], span["component"]])
            for kept, joined in by_kept.items():
                for a, b, component in joined:
                    at = np.arange(np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left") + 1)
                    opens = np.where(at > 0, ends[at - 1], 0)
                    first, last = np.maximum(opens, a), np.minimum(ends[at], b)
                    some = last > first
                    n = int(some.sum())
                    rows += [row] * n
                    kepts += [kept] * n
                    components += [component] * n
                    line += at[some].tolist()
                    first_word += (first - opens)[some].tolist()
                    length += (last - first)[some].tolist()
        owner = pa.array(rows, pa.int64())
        numbers = [pa.array(x, pa.int64()) for x in (line, first_word, length, kepts, components)]
        names = ["doc_id", "text_id", "line", "start", "n_words", "kept_doc_id", "component_id"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("text_id").take(owner), *numbers], names)

    schema = "doc_id long, text_id long, line long, start long, n_words long, kept_doc_id long, component_id long"
    return map_arrow(of_text.join(lines, "text_id").select("doc_id", "text_id", "spans", "line_ends"), part, schema)


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the words of ``passages``; all columns stay, whatever their names.

    Lines that lose all words go; a line that loses some keeps the others, parted by single
    spaces.  Documents that lose all words go; those that lose none, null and empty texts among
    them, are left as they are.  An empty table of passages changes nothing.
    """
    spans = passages.groupBy("doc_id", "text_id").agg(
        F.collect_list(F.struct("line", "start", (F.col("start") + F.col("n_words")).alias("end"))).alias("spans")
    )
    (held,) = free_names(docs, "removed_spans")
    left = F.expr(
        f"""array_join(filter(transform(split(text, '\n', -1), (l, i) ->
             CASE WHEN exists(`{held}`, s -> s.line = i)
             THEN nullif(array_join(filter(filter(split(l, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''), (w, j) ->
                    NOT exists(`{held}`, s -> s.line = i AND j >= s.start AND j < s.end)), ' '), '')
             ELSE l END), l -> l IS NOT NULL), '\n')"""
    )
    marked = attach(docs, spans, "spans", held)
    rewritten = marked.withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(left))
    some = F.col(held).isNull() | F.col("text").rlike(WORD)
    return rewritten.filter(some).select(*(F.col(f"`{c}`") for c in docs.columns))


@owned
def dedup_passages(docs: DataFrame, **options) -> DataFrame:
    """Documents without the passages that an earlier place holds (see :func:`repeated_passages`).

    Defined cases are those of :func:`repeated_passages` and :func:`remove_passages`.
    """
    return remove_passages(docs, repeated_passages(docs, **options))
