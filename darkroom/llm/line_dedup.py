"""Delete runs of lines that an earlier place holds, found by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import (
    WORD,
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
from darkroom.llm.shingles import mix, signed

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The lines with a word of some texts, one after the other, and their shortest runs of enough words.

    Run ``r`` is the lines ``r`` to ``last[r]``: as many as hold ``min_words`` words together; runs
    that would leave their text are none (``runs`` names the others).  ``mark`` is the line of each
    run that winnowing selects: that of the least hash, the last among equals.
    """

    def __init__(self, texts: list[bytes], min_words: int):
        hashes: list[int] = []
        words: list[int] = []
        numbers: list[int] = []
        counts: list[int] = []
        for text in texts:
            before = len(numbers)
            for number, line in enumerate(text.split(b"\n")):
                line = line.strip()
                if line:
                    hashes.append(xxhash.xxh3_64_intdigest(line))
                    words.append(len(line.split()))
                    numbers.append(number)
            counts.append(len(numbers) - before)
        self.hashes = np.array(hashes, dtype=np.uint64)
        self.numbers = np.array(numbers, dtype=np.int64)
        self.text = np.repeat(np.arange(len(texts)), counts)
        upto = np.cumsum(np.array(words, dtype=np.int64))
        before = np.r_[0, upto][:-1]
        last = np.searchsorted(upto, before + min_words)
        inside = last < len(upto)
        inside[inside] = self.text[last[inside]] == self.text[inside]
        self.runs = np.flatnonzero(inside)
        self.last = last[inside]
        self.mark = self._marks()

    def _marks(self) -> np.ndarray:
        """By doubling: the least of a run is the lesser of those of two spans that cover it."""
        mark = np.zeros(len(self.runs), dtype=np.int64)
        size = self.last - self.runs + 1
        best, span = np.arange(len(self.hashes)), 1
        while len(self.runs):
            some = (size >= span) & (size < 2 * span)
            one, other = best[self.runs[some]], best[self.last[some] - span + 1]
            mark[some] = np.where(self.hashes[one] < self.hashes[other], one, other)
            if 2 * span > size.max():
                break
            one, other = best[:-span], best[span:]
            best = np.where(self.hashes[one] < self.hashes[other], one, other)
            span *= 2
        return mark

    def run_ids(self, which: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lines of some runs: a polynomial in each line's mixed hash."""
        value = np.zeros(len(which), dtype=np.uint64)
        first, last = self.runs[which], self.last[which]
        mixed = mix(self.hashes)
        for step in range(int((last - first).max(initial=-1)) + 1):
            at = first + step
            value = np.where(at <= last, value * _BASE + mixed[np.minimum(at, last)], value)
        return signed(mix(value + (last - first + 1).astype(np.uint64)))


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """(v): the winnowed line hashes of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros(0, dtype=np.int64)]
        for texts in texts_of(batch):
            lines = Lines(texts, min_words)
            found.append(signed(lines.hashes[np.unique(lines.mark)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["v"])

    return map_texts(docs.select("text"), run, "v long")


def positions(docs: DataFrame, min_words: int, repeated: DataFrame) -> DataFrame:
    """(run, doc_id, text_id, first, last): fingerprints that occur again, extended both ways.

    Of a fingerprint at a line all runs that selected it are given; ``run`` is the hash of a run's
    lines, first and last the numbers of its first and last line.
    """
    held = broadcast(docs.sparkSession, membership(repeated, "v"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
        row = 0
        for texts in texts_of(batch):
            lines = Lines(texts, min_words)
            which = np.flatnonzero(held.value(signed(lines.hashes[lines.mark])))
            first = lines.runs[which]
            found = (lines.run_ids(which), lines.text[first] + row, lines.numbers[first], lines.numbers[lines.last[which]])
            for column, values in zip(columns, found):
                column.append(values)
            row += len(texts)
        ids, rows, first, last = (np.concatenate(c) for c in columns)
        owner = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), batch.column("doc_id").take(owner), batch.column("text_id").take(owner), pa.array(first), pa.array(last)],
            ["run", "doc_id", "text_id", "first", "last"],
        )

    return map_texts(docs, run, "run long, doc_id long, text_id long, first long, last long")


def repeated_lines(docs: DataFrame, min_words: int = 3) -> DataFrame:
    """(doc_id, text_id, gone): the line ranges (first, last) of later repeated runs, disjoint and in order."""
    docs = keyed(docs)
    marks = fingerprints(docs, min_words).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    again = cut_lineage(marks.filter("n > 1").select("v"))
    found = cut_lineage(positions(docs, min_words, again))
    release(again)
    place = F.struct("doc_id", "text_id", "first")
    spans = found.groupBy("run").agg(F.min(place).alias("source"), F.max(place).alias("latest"))
    # written, so that the join with it is a broadcast or can be split where a run is frequent
    spans = cut_lineage(spans.filter("NOT source <=> latest").select("run", "source"))
    later = found.join(spans, "run").filter(~place.eqNullSafe(F.col("source")))
    of_text = later.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first", "last")).alias("gone"))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ranges in batch.column("gone").to_pylist():
            joined: list[dict] = []
            for r in sorted(ranges, key=lambda r: (r["first"], r["last"])):
                if joined and r["first"] <= joined[-1]["last"] + 1:
                    joined[-1]["last"] = max(joined[-1]["last"], r["last"])
                else:
                    joined.append(r)
            out.append(joined)
        gone = pa.array(out, batch.schema.field("gone").type)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), gone], ["doc_id", "text_id", "gone"])

    gone = cut_lineage(map_arrow(of_text, merged, "doc_id long, text_id long, gone array<struct<first:bigint,last:bigint>>"))
    release(found, spans)
    return gone


@owned
def dedup_lines(docs: DataFrame, min_words: int = 3, keep_emptied: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without later repeated runs of lines.

    A run is successive lines of together ``min_words`` words or more; lines without a word are
    passed over and stay, and blanks at the ends of lines do not count.  Every run that also occurs
    at an earlier place, by doc_id and line, is deleted, from single lines of ``min_words`` words to
    any number of shorter ones; with ``min_words`` 1 every later copy of a line.  The shortest runs
    from each line on are the windows of winnowing: the line of least hash of each is its
    fingerprint, so that runs with a copy surely share one.  Places of repeated fingerprints are
    extended both ways to the windows around them, and these joined by hash, so that no pairs are
    formed however often a run occurs.

    With ``counts``, adds n_lines (lines with a word) and n_removed to the columns, replacing columns
    of these names.  Documents that lose their last line with a word are dropped unless ``keep_emptied``.
    Rows that repeat a doc_id with an equal text are one document.  Other columns stay, whatever
    their names.  Null and empty texts stay as they are; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed") if counts else docs
    held, total, removed = free_names(docs, "gone_lines", "n_lines", "n_removed")
    marked = attach(docs, repeated_lines(docs, min_words), "gone", held)
    lines = F.split("text", "\n", -1)
    inside = lambda i: F.exists(F.col(held), lambda r: (r["first"] <= i) & (i <= r["last"]))
    worded = F.size(F.filter(lines, lambda line: line.rlike(WORD)))
    left = F.filter(lines, lambda line, i: ~(inside(i.cast("long")) & line.rlike(WORD)))
    whole = F.col(held).isNull()
    out = marked.withColumns(
        {
            total: F.when(F.col("text").isNull(), F.lit(0)).otherwise(worded).cast("long"),
            removed: F.when(whole, F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long"),
            "text": F.when(whole, F.col("text")).otherwise(F.array_join(left, "\n")),
        }
    )
    if not keep_emptied:
        out = out.filter((F.col(removed) == 0) | (F.col(removed) < F.col(total)))
    return out.drop(held, *([] if counts else [total, removed]))


#: The same by brute force: a line goes if it lies in a shortest run of 3 words that an earlier place holds.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS body,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), ahead AS (
  SELECT doc_id, p, [i, lead(i, 1) OVER w, lead(i, 2) OVER w] AS spots,
         [body, lead(body, 1) OVER w, lead(body, 2) OVER w] AS bodies,
         CASE WHEN words >= 3 THEN 1 WHEN words + lead(words, 1) OVER w >= 3 THEN 2
              WHEN words + lead(words, 1) OVER w + lead(words, 2) OVER w >= 3 THEN 3 END AS n
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), runs AS (
  SELECT doc_id, p, spots[1:n] AS spots, md5(array_to_string(bodies[1:n], chr(10))) AS run FROM ahead WHERE n IS NOT NULL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS nth FROM runs) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(spots) AS i FROM later
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
  FROM lines WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = lines.doc_id AND g.i = lines.i) GROUP BY doc_id
)
SELECT d.doc_id,
  coalesce((SELECT count(*) FROM worded x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
  coalesce((SELECT count(*) FROM gone x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
