"""Toxicity scores by a counterfactually regularised linear classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import broadcast, map_arrow, slices

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
#: The most that a word takes from its sentence's sum, so that harmless words do not drown an insult.
LEAST = -0.15
#: Share of clean texts, held out of the fit in turn, that the cut of 0.5 leaves alone.
LEFT_ALONE = 0.995
#: Words of a window; longer sentences are read in windows that overlap by half.
WINDOW = 64

#: Words that name groups of people, by kind.  Swaps stay within a kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "woman", "man", "transgender", "nonbinary", "female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young", "old"),
    ("immigrant", "refugee", "foreigner", "migrant", "native", "citizen"),
    ("mexican", "chinese", "indian", "american", "german", "french", "spanish", "turkish"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "gitanos"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
)


def word_features(word: str, bits: int) -> list[int]:
    """Hashed features of a lower-cased word: itself, its beginnings and its 4-grams."""
    framed = f"<{word}>"
    names = {f"w:{word}", f"p:{word[:4]}", f"q:{word[:5]}"}
    names.update(framed[i : i + 4] for i in range(max(1, len(framed) - 3)))
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) >> (32 - bits) for n in sorted(names)]


def windows(text: str) -> list[list[str]]:
    """The distinct words of each sentence, of long sentences in overlapping windows."""
    out = []
    for sentence in SENTENCE_END.split(text.lower()):
        words = WORD.findall(sentence)
        if len(words) <= WINDOW:
            if words:
                out.append(sorted(set(words)))
        else:
            for i in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                out.append(sorted(set(words[i : i + WINDOW])))
    return out


class ToxicityModel:
    """Sum of word weights (none below LEAST) per sentence, largest sentence per text, logistic link."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float, bits: int):
        self.weights, self.slope, self.shift, self.bits = weights, slope, shift, bits
        self._memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def _weight(self, word: str) -> float:
        found = self._memo.get(word)
        if found is None:
            found = max(LEAST, float(self.weights[word_features(word, self.bits)].sum()))
            if len(word) <= 64:
                self._memo[word] = found
        return found

    def raw(self, text: str) -> float:
        """The largest sum over the text's sentences; 0 without words."""
        return self.largest(windows(text))

    def largest(self, groups: Sequence[Sequence[str]]) -> float:
        if len(self._memo) > 300_000:
            self._memo.clear()
        weight = self._weight
        return max((sum(map(weight, words)) for words in groups), default=0.0)

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        z = np.array([self.raw(t) for t in texts], dtype=np.float64) * self.slope + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class _Sentences:
    """Sentences as runs of word numbers, words as runs of feature numbers."""

    def __init__(self, sentences: Sequence[Sequence[str]], bits: int):
        number: dict[str, int] = {}
        self.words = np.array([number.setdefault(w, len(number)) for s in sentences for w in s], dtype=np.int64)
        self.sentence = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        self.n = len(sentences)
        features = [word_features(w, bits) for w in number]
        self.features = np.array([f for fs in features for f in fs], dtype=np.int64)
        self.word_of = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.n_words, self.n_features = len(features), 1 << bits

    def sums(self, weights: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.word_of, weights[self.features], minlength=self.n_words)
        return np.bincount(self.sentence, by_word[self.words], minlength=self.n)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.words, error[self.sentence], minlength=self.n_words)
        return np.bincount(self.features, by_word[self.word_of], minlength=self.n_features)


def counterfactuals(
    sentences: Sequence[Sequence[str]], clean: Sequence[int], terms: Sequence[Sequence[str]], seed: int, carriers: int
) -> list[tuple[list[str], list[str]]]:
    """Pairs of a labelled sentence and the same sentence with its identity term swapped.

    Few corpora mention every group, so up to ``carriers`` clean sentences also get one word
    replaced by two different terms of a kind.
    """
    rng = np.random.default_rng(seed)
    kind_of = {t: kind for kind in terms for t in kind}
    pairs = []
    for words in sentences:
        at = [i for i, w in enumerate(words) if w in kind_of]
        if at:
            kind = [kind_of[words[i]] for i in at]
            swapped = list(words)
            for i, k in zip(at, kind):
                others = [t for t in k if t != words[i]]
                if others:
                    swapped[i] = others[rng.integers(len(others))]
            pairs.append((list(words), swapped))
    if len(clean):
        for index in rng.choice(clean, size=min(carriers, len(clean)), replace=False):
            kind = terms[rng.integers(len(terms))] if terms else ()
            if len(kind) > 1:
                one, other = rng.choice(len(kind), size=2, replace=False)
                first, second = list(sentences[index]), list(sentences[index])
                at = rng.integers(len(first))
                first[at], second[at] = kind[one], kind[other]
                pairs.append((first, second))
    return pairs


def fit(
    texts: Sequence[str],
    labels: Sequence[int],
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    penalty: float = 1.0,
    bits: int = 18,
    rounds: int = 3,
    steps: int = 60,
    decay: float = 1e-4,
    carriers: int = 1000,
    seed: int = 7,
) -> ToxicityModel:
    """Fit on labelled texts.

    A text is toxic if one of its sentences is.  Each round fits sentence scores: every sentence
    of clean texts counts as clean, and of each toxic text all sentences (first round) or the one
    that scores highest (later rounds) count as toxic.  ``penalty`` times the squared change of
    score between counterfactual sentences is added to the logistic loss.  The logistic link is
    fitted to sums of texts that two further fits, each on half of the texts, have not seen.
    Without both labels every text gets a low (or high) score according to the one label seen.
    """
    known: dict[str, str] = {}  # a word is held once, however often it occurs
    groups = [[[known.setdefault(w, w) for w in words] for words in windows(t)] for t in texts]
    labels = np.asarray(labels, dtype=np.int64)
    kept = [i for i, g in enumerate(groups) if g]
    if len(set(labels[kept].tolist())) < 2:
        shift = 4.0 if len(labels) and labels.mean() > 0.5 else -4.0
        return ToxicityModel(np.zeros(1 << bits, dtype=np.float32), 1.0, shift, bits)
    groups, labels = [groups[i] for i in kept], labels[kept]
    learn = lambda which: ToxicityModel(
        _learn([groups[i] for i in which], labels[which], terms, penalty, bits, rounds, steps, decay, carriers, seed), 1.0, 0.0, bits
    )
    model = learn(np.arange(len(labels)))
    half = np.zeros(len(labels), dtype=np.int64)  # of each label every other text
    for value in (0, 1):
        some = np.flatnonzero(labels == value)
        half[some] = np.arange(len(some)) % 2
    raw = np.zeros(len(labels))
    for side in (0, 1):
        others = np.flatnonzero(half != side)
        other = learn(others) if len(set(labels[others].tolist())) == 2 else model
        for i in np.flatnonzero(half == side):
            raw[i] = other.largest(groups[i])
    model.slope, model.shift = _calibrate(raw, labels)
    return model


def _learn(
    groups: Sequence[Sequence[Sequence[str]]],
    of_text: np.ndarray,
    terms: Sequence[Sequence[str]],
    penalty: float,
    bits: int,
    rounds: int,
    steps: int,
    decay: float,
    carriers: int,
    seed: int,
) -> np.ndarray:
    """Feature weights from the sentences of texts and the texts' labels, both of which occur."""
    sentences = [s for g in groups for s in g]
    text_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    label = of_text[text_of]
    pairs = counterfactuals(sentences, np.flatnonzero(label == 0), terms, seed, carriers)
    data = _Sentences([*sentences, *(p[0] for p in pairs), *(p[1] for p in pairs)], bits)
    n, m = len(sentences), len(pairs)
    starts = np.flatnonzero(np.r_[True, np.diff(text_of) > 0])
    weights, bias = np.zeros(1 << bits), 0.0
    first, second = np.zeros(1 << bits), np.zeros(1 << bits)
    first_b = second_b = 0.0
    step = 0
    use = np.ones(n, dtype=bool)
    for round_ in range(rounds):
        if round_:
            z = data.sums(weights)[:n]
            best = np.maximum.reduceat(z, starts)[text_of]
            use = (label == 0) | (z >= best)
        # Each class carries half of the weight; each toxic text the same share of its half.
        share = np.where(use, 1.0, 0.0)
        positive = label == 1
        per_text = np.bincount(text_of, share * positive, minlength=len(groups))
        share[positive] /= per_text[text_of[positive]]
        share[positive] *= 0.5 / share[positive].sum()
        share[~positive] *= 0.5 / max(1e-9, share[~positive].sum())
        for _ in range(steps):
            z = data.sums(weights)
            probability = 1.0 / (1.0 + np.exp(-np.clip(z[:n] + bias, -60, 60)))
            error = np.zeros(data.n)
            error[:n] = (probability - label) * share
            if m:
                change = z[n : n + m] - z[n + m :]
                pull = 2.0 * penalty * change / m
                error[n : n + m] += pull
                error[n + m :] -= pull
            slope = data.gradient(error) + decay * weights
            slope_b = float(error[:n].sum())
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            first_b, second_b = 0.9 * first_b + 0.1 * slope_b, 0.99 * second_b + 0.01 * slope_b**2
            rate = 0.05 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            weights -= rate * first / (np.sqrt(second) + 1e-8)
            bias -= rate * first_b / (np.sqrt(second_b) + 1e-8)
    return weights.astype(np.float32)


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift of text sums, with both classes weighted alike, by Newton steps."""
    centre, spread = float(raw.mean()), float(raw.std()) or 1.0
    x = (raw - centre) / spread
    target = np.where(label == 1, 0.98, 0.02)  # smoothed, so that a separable sample has a finite optimum
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    a = b = 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * share * x).sum() + 1e-3 * a, ((p - target) * share).sum()])
        w = np.maximum(share * p * (1 - p), 1e-9)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    slope, shift = a / spread, b - a * centre / spread
    clean, toxic = np.quantile(raw[label == 0], LEFT_ALONE), np.quantile(raw[label == 1], 0.02)
    if slope > 0:  # the cut: midway if the classes lie apart, else where it leaves clean texts alone
        shift = -slope * ((clean + toxic) / 2 if clean < toxic else clean)
    return slope, shift


def training_sample(
    docs: DataFrame, labels: DataFrame, rows_per_class: int, max_chars: int
) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts for the driver.

    ``labels`` has one (doc_id, toxic) row per document.  Of each class the ``2 * rows_per_class``
    rows of the smallest id hash are broadcast to the documents, so that no text is shuffled; the
    first ``rows_per_class`` of the texts found are kept, of a longer text than ``max_chars`` characters a
    piece of that length, from a place chosen by the id's hash.  Rows without text or label are no
    examples.
    """
    place = F.xxhash64("doc_id", F.lit("toxicity"))
    start = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1) + 1
    chosen = None
    for value in (0, 1):
        some = labels.filter(F.col("toxic") == value).select("doc_id", "toxic", place.alias("h"))
        some = some.orderBy("h", "doc_id").limit(2 * rows_per_class)
        chosen = some if chosen is None else chosen.unionAll(some)
    found = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("text").substr(start.cast("int"), F.lit(max_chars)).alias("text"), "toxic", "h")
        .collect()
    )
    texts: list[str] = []
    kept: list[int] = []
    for value in (0, 1):
        rows = sorted((r.h, r.text) for r in found if r.toxic == value)[:rows_per_class]
        texts += [t for _, t in rows]
        kept += [value] * len(rows)
    return texts, kept


def score(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ()) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= 0.5) to doc_id, text and ``keep``.

    The model, of fixed size, is broadcast.  A null text is scored as an empty one.
    """
    shared = broadcast(docs.sparkSession, model)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name != "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.scores([t or "" for t in s.column("text").to_pylist()]) for s in slices(batch, "text")]
        scores = np.concatenate(found) if found else np.zeros(0)
        names = [n for n in batch.schema.names if n != "text"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
            [*names, "score", "predicted"],
        )

    return map_arrow(columns, run, f"{schema}, score double, predicted int")


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    rows_per_class: int = 3000,
    max_chars: int = 16_384,
    folds: int = 5,
    held_out_fold: int = 0,
    **options,
) -> ToxicityModel:
    """Fit on the labelled documents outside the held-out fold, crc32(doc_id) mod ``folds``."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.filter(fold != held_out_fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(*training_sample(docs, known, rows_per_class, max_chars), **options)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Score every document of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic).

    Returns doc_id, held_out, score, predicted, one row per input row.  Repeated ids are scored
    each; a document labelled twice counts as toxic if one label says so; extra columns are
    ignored; without usable labels all scores are low; an empty table gives no rows.
    """
    model = fit_on(docs, labels, **options)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % options.get("folds", 5)
    held = F.coalesce(fold == options.get("held_out_fold", 0), F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are predicted toxic; all columns stay, whatever their names.

    A null or empty text, or one without words, scores as the model scores no words and so stays unless
    all labels are toxic.  Repeated rows are judged each; without usable labels all stay; an empty
    table gives no rows.
    """
    shared = broadcast(docs.sparkSession, fit_on(docs, labels, **options))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names of any kind pass through
    text = f"c{docs.columns.index('text')}"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for part in slices(batch, text):
            keep += (shared.value.scores([t or "" for t in part.column(text).to_pylist()]) < 0.5).tolist()
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(plain, run, plain.schema).toDF(*docs.columns)
