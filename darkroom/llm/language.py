"""Language identification by string kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import broadcast, map_arrow, slices

UNDETERMINED = "und"
#: Characters of a text that are hashed at once; neighbouring blocks overlap by the n-gram length.
BLOCK = 1 << 20


def presence(text: str, lengths: Sequence[int], bits: int) -> np.ndarray:
    """Sorted numbers of the distinct hashed n-grams of a text, for all ``lengths``.

    Letters are lower-cased; every run of other characters counts as one space.
    """
    letters = "".join([c if c.isalpha() else " " for c in text.lower()])
    framed = f" {' '.join(letters.split())} "
    seen = np.zeros(1 << bits, dtype=bool)
    for low in range(0, len(framed), BLOCK):
        block = framed[low : low + BLOCK + max(lengths) - 1]
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        rolling = np.zeros(len(codes), dtype=np.uint64)
        for length in range(1, max(lengths) + 1):
            rolling = rolling[: len(codes) - length + 1] * np.uint64(0x100000001B3) + codes[length - 1 :]
            if length in lengths and len(rolling):
                mixed = (rolling + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
                seen[(mixed >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.flatnonzero(seen)


class LanguageModel:
    """One-versus-rest kernel ridge regression in the Nyström space of some landmark texts.

    The kernel of two texts is the number of hashed n-grams present in both over the geometric
    mean of their own numbers.  It is a dot product of normalised presence vectors, so the kernel
    with all landmarks, the whitening and the ridge weights fold into one matrix of
    ``2 ** bits`` rows and a column per language.
    """

    def __init__(self, languages: list[str], matrix: np.ndarray, lengths: tuple[int, ...], bits: int):
        self.languages, self.matrix, self.lengths, self.bits = languages, matrix, lengths, bits

    def predict(self, texts: Sequence[str | None], rows: int = 32) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; texts are multiplied ``rows`` at a time."""
        found = [UNDETERMINED] * len(texts)
        scores = np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
        if not self.languages:
            return found, scores
        dense = np.zeros((rows, 1 << self.bits), dtype=np.float32)
        for low in range(0, len(known), rows):
            some = known[low : low + rows]
            present = [presence(texts[i], self.lengths, self.bits) for i in some]
            for row, grams in enumerate(present):
                dense[row, grams] = 1.0 / np.sqrt(len(grams))
            margin = (dense[: len(some)] @ self.matrix).astype(np.float64)
            for row, grams in enumerate(present):
                dense[row, grams] = 0.0
            weights = np.exp(6.0 * (margin - margin.max(axis=1, keepdims=True)))
            weights /= weights.sum(axis=1, keepdims=True)
            for i, best, w in zip(some, margin.argmax(axis=1), weights):
                found[i], scores[i] = self.languages[best], w[best]
        return found, scores


def fit(
    texts: Sequence[str],
    languages: Sequence[str],
    landmarks_per_language: int = 64,
    lengths: tuple[int, ...] = (1, 2, 3, 4),
    bits: int = 15,
    ridge: float = 1e-3,
) -> LanguageModel:
    """Fit on texts of known language; texts without a letter are left out.

    Each language's first ``landmarks_per_language`` texts are the landmarks.  Classes weigh alike
    however many texts they have.
    """
    pairs = [(t, l) for t, l in zip(texts, languages) if t and l and any(c.isalpha() for c in t)]
    names = sorted({l for _, l in pairs})
    if not names:
        return LanguageModel([], np.zeros((1 << bits, 0), dtype=np.float32), lengths, bits)
    vectors = np.zeros((len(pairs), 1 << bits), dtype=np.float32)
    for row, (text, _) in enumerate(pairs):
        grams = presence(text, lengths, bits)
        vectors[row, grams] = 1.0 / np.sqrt(len(grams))
    label = np.array([names.index(l) for _, l in pairs])
    chosen = np.concatenate([np.flatnonzero(label == c)[:landmarks_per_language] for c in range(len(names))])
    marks = vectors[chosen]
    values, basis = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = basis[:, good] / np.sqrt(values[good])  # the Nyström map: kernel @ whiten
    mapped = (vectors @ marks.T).astype(np.float64) @ whiten
    share = 1.0 / np.bincount(label)[label]
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0 / max(1, len(names) - 1))
    weighted = mapped * share[:, None]
    weights = np.linalg.solve(weighted.T @ mapped + ridge * np.eye(mapped.shape[1]), weighted.T @ target)
    return LanguageModel(names, (marks.T.astype(np.float64) @ (whiten @ weights)).astype(np.float32), lengths, bits)


def training_sample(labelled: DataFrame, rows: int, rows_per_language: int, max_chars: int) -> list:
    """A bounded sample of (text, lang) for the driver: of every language some rows.

    The languages share ``rows`` rows, each getting at most ``rows_per_language`` and at least 4.
    Rows are those of the smallest id hash; the hash limit that their count suggests leaves about
    twice as many to sort.  Of texts longer than ``max_chars`` characters a piece of that length,
    from a place that the id hash chooses, is an example.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    counts = usable.groupBy("lang").count().collect()
    each = max(4, min(rows_per_language, rows // max(1, len(counts))))
    if not counts:
        return []
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30))
    limits = [(r["lang"], int(min(1.0, (2 * each + 40) / r["count"]) * (1 << 30))) for r in counts]
    limits = labelled.sparkSession.createDataFrame(limits, "lang string, below long")  # a row a language
    free = F.greatest(F.lit(1), F.length("text") - max_chars + 1)
    piece = F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id"), free).cast("int") + 1, F.lit(max_chars))
    found = usable.join(F.broadcast(limits), "lang").filter(place < F.col("below"))
    kept: dict[str, list] = {}
    for row in sorted(found.select(piece.alias("text"), "lang", place.alias("h")).collect(), key=lambda r: (r.lang, r.h, r.text)):
        some = kept.setdefault(row.lang, [])
        if len(some) < each:
            some.append(row)
    return [row for some in kept.values() for row in some]


def identify(
    docs: DataFrame,
    rows: int = 1000,
    rows_per_language: int = 400,
    max_chars: int = 8192,
    folds: int = 4,
    held_out_fold: int = 2,
    **options,
) -> DataFrame:
    """Predict the language of every text of ``docs`` (doc_id, text, lang).

    Learns from rows outside the held-out fold, crc32(doc_id) mod ``folds``, whose lang is not
    null: from ``rows`` of them, shared by all languages (see :func:`training_sample`), so every
    language can be predicted.  Whole texts of any length are read.  Null texts and those without a letter are ``und``
    with score 0; so are all texts if nothing can be learnt.  Repeated rows are scored each; extra
    columns are ignored; an empty table gives no rows.  Returns doc_id, held_out, lang_pred, score.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    sample = training_sample(docs.filter(fold != held_out_fold), rows, rows_per_language, max_chars)
    model = fit([r.text for r in sample], [r.lang for r in sample], **options)
    shared = broadcast(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names: list[str] = []
        scores: list[np.ndarray] = []
        for part in slices(batch, "text"):
            found, score = shared.value.predict(part.column("text").to_pylist())
            names += found
            scores.append(score)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held_out_fold).alias("held_out"), "text")
    return map_arrow(columns, run, "doc_id long, held_out boolean, lang_pred string, score double")
