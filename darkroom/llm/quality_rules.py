"""Quality rules: counts over words and lines, and divergence from language references.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import cut_lineage, owned, release

#: Frequent short words of some languages, the bins of the common-word histogram.
COMMON_WORDS: tuple[str, ...] = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "with",
    "der", "die", "und", "das", "den", "von", "ein", "mit", "sich", "ist",
    "de", "la", "que", "el", "los", "se", "del", "las", "un", "por",
    "le", "les", "et", "des", "est", "en", "une", "du", "dans", "pour",
)
#: Character classes of the other histogram; what is left over is the last class.
CHARACTER_CLASSES = (
    ("lower", "[a-z]+"),
    ("blank", "[\\x20\\x09-\\x0D]+"),
    ("upper", "[A-Z]+"),
    ("letter", "\\p{L}+"),
    ("digit", "\\p{Nd}+"),
    ("stop", "[.,;:?'\"()\\-]+"),
)


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` under ``name``: evaluated once, also where body has it inside another lambda."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _flagged(sorted_: str, same: str, position: str) -> str:
    """Positions in a sorted array whose neighbour before or behind has the same gram."""
    return f"""sort_array(filter(transform({sorted_}, (s, k) ->
        CASE WHEN {same.format(a="s", b=f"get({sorted_}, k - 1)")}
               OR {same.format(a="s", b=f"get({sorted_}, k + 1)")} THEN {position} END), p -> p IS NOT NULL))"""


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts over words ``[^\\x20\\x09-\\x0D]+`` and lines of each text (null: no words).

    n_repeat_words counts the words inside 3-word windows that occur twice or more in the text,
    the first occurrence included.  Windows are compared by 64-bit hashes: hash and position are
    sorted as one long where 40 bits tell the text's windows apart, else as pairs.  Repeated rows
    are counted each; an empty table gives no rows.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.expr("array_remove(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn(
        "grams",
        F.expr(
            """CASE WHEN n_words < 4 THEN cast(array() AS array<bigint>) ELSE
               transform(sequence(0, cast(n_words AS int) - 3),
                         i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"""
        ),
    )
    df = df.withColumn(
        "n_grams_apart", F.expr("size(array_distinct(grams))")
    ).withColumn(
        "packed",
        F.expr(
            """CASE WHEN n_grams_apart < size(grams) AND size(grams) < 16777216
                     AND size(array_distinct(transform(grams, g -> shiftrightunsigned(g, 24)))) = n_grams_apart
               THEN sort_array(transform(grams, (g, i) -> shiftleft(shiftrightunsigned(g, 24), 24) | cast(i AS bigint))) END"""
        ),
    ).withColumn(
        "paired",
        F.expr(
            """CASE WHEN n_grams_apart < size(grams) AND packed IS NULL
               THEN array_sort(transform(grams, (g, i) -> struct(g AS g, i AS i))) END"""
        ),
    )
    by_packed = _flagged(
        "packed", "coalesce(shiftright({a}, 24) = shiftright({b}, 24), false)", "cast(s & 16777215L AS int)"
    )
    by_pair = _flagged("paired", "coalesce({a}.g = {b}.g, false)", "s.i")
    df = df.withColumn(
        "flagged",
        F.expr(f"CASE WHEN packed IS NOT NULL THEN {by_packed} WHEN paired IS NOT NULL THEN {by_pair} END"),
    )
    lines = "filter(split(text, '\\n', -1), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    df = df.withColumn("lines", F.expr(lines))
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))
    return df.select(
        "doc_id",
        *keep,
        "text",
        "words",
        "n_words",
        symbols.cast("long").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(
            """coalesce(aggregate(flagged, struct(-3 AS last, 0L AS covered),
                 (a, p) -> struct(p AS last, a.covered + least(3, p - a.last) AS covered),
                 a -> a.covered), 0L)"""
        ).alias("n_repeat_words"),
    )


def histograms(df: DataFrame) -> DataFrame:
    """Replace text and words by word_chars, classes and commons (arrays of counts, zeros for empty texts)."""
    df = df.withColumn("_joined", F.array_join("words", ""))  # the text without its blanks, which part words only
    taken, rest = {"blank": F.length("text") - F.length("_joined")}, "_joined"
    for name, pattern in CHARACTER_CLASSES:
        if name not in taken:
            df = df.withColumn(f"_{name}", F.regexp_replace(rest, pattern, ""))
            taken[name] = F.length(rest) - F.length(f"_{name}")
            rest = f"_{name}"
    quoted = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    longest = max(map(len, COMMON_WORDS))
    common = f"filter(words, w -> length(w) <= {longest} AND lower(w) IN ({quoted}))"  # lower-casing shortens no word
    df = df.withColumn("_common", F.expr(f"transform({common}, w -> lower(w))"))
    other = F.col("n_words") - F.size("_common")
    count = "CASE WHEN array_contains(kinds, c) THEN cast(size(_common) - size(array_remove(_common, c)) AS bigint) ELSE 0L END"
    commons = F.expr(_bound("array_distinct(_common)", "kinds", f"transform(array({quoted}), c -> {count})"))
    dropped = ["text", "words", "_common", "_joined", *(f"_{n}" for n, _ in CHARACTER_CLASSES)]
    return (
        df.withColumn("word_chars", F.length("_joined").cast("long"))
        .withColumn("classes", F.array(*(taken[n].cast("long") for n, _ in CHARACTER_CLASSES), F.length(rest).cast("long")))
        .withColumn("commons", F.concat(commons, F.array(other.cast("long"))))
        .drop(*dropped)
    )


def shares(counts: str) -> str:
    """SQL for an array of counts divided by their sum, which is taken once."""
    return _bound(f"aggregate({counts}, 0D, (a, x) -> a + x)", "total", f"transform({counts}, x -> x / total)")


def divergence(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; a share that meets none counts whole."""
    terms = f"""zip_with({p}, {q}, (x, y) -> CASE WHEN x > 0 AND y > 0
        THEN x * log2(2 * x / (x + y)) + y * log2(2 * y / (x + y)) ELSE x + y END)"""
    return f"sqrt(greatest(0D, 0.5D * aggregate({terms}, 0D, (a, x) -> a + x)))"


def js_distance(p: str, q: str) -> str:
    """SQL for the :func:`divergence` of two arrays of counts."""
    return _bound(shares(p), "of_p", _bound(shares(q), "of_q", divergence("of_p", "of_q")))


N_CLASSES, N_COMMONS = len(CHARACTER_CLASSES) + 1, len(COMMON_WORDS) + 1


def references(features: DataFrame, shrinkage: float) -> DataFrame:
    """(lang, n, ref_classes, ref_commons): a reference for every language, and one of the whole corpus, whose lang is null.

    References are given as shares, so that no distance sums them again.
    A language's is the sum of the histograms of its documents that pass the base rules and of
    ``shrinkage`` average documents of the corpus that do, so that a few documents under a label of
    their own make no standard by themselves, and their label counts for more the more there are.
    """
    sums = [F.sum(F.col("classes")[i]).alias(f"k{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(N_COMMONS)]
    by_language = cut_lineage(features.filter(~F.col("base_failed")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums))
    names = ["n", *(f"k{i}" for i in range(N_CLASSES)), *(f"w{i}" for i in range(N_COMMONS))]
    whole = by_language.agg(*(F.sum(c).alias(f"all_{c}") for c in names))  # one row
    mixed = {c: F.col(c) + shrinkage * F.col(f"all_{c}") / F.col("all_n") for c in names[1:]}
    joined = by_language.filter("lang IS NOT NULL").crossJoin(F.broadcast(whole)).withColumns(mixed).select("lang", *names)
    everything = whole.filter("all_n > 0").select(
        F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n"), *(F.col(f"all_{c}").cast("double").alias(c) for c in names[1:])
    )
    found = joined.unionByName(everything)
    bins = lambda name, n: f"array({', '.join(f'{name}{i}' for i in range(n))})"
    out = cut_lineage(
        found.select(
            "lang", "n", F.expr(shares(bins("k", N_CLASSES))).alias("ref_classes"), F.expr(shares(bins("w", N_COMMONS))).alias("ref_commons")
        )
    )
    release(by_language)
    return out


def nearest(column: str, references: list[list[float]]) -> Column:
    """The smallest distance of an array of counts to any reference (shares)."""
    literal = ", ".join(f"array({', '.join(f'{n!r}D' for n in r)})" for r in references)
    return F.expr(_bound(shares(column), "own", f"array_min(transform(array({literal}), r -> {divergence('own', 'r')}))"))


@owned
def quality_rules(
    docs: DataFrame,
    max_class_distance: float = 0.30,
    max_word_distance: float = 0.62,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    shrinkage: float = 5.0,
    common: int = 16,
) -> DataFrame:
    """Base counts and a verdict on every document of ``docs`` (doc_id, text, lang).

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them
    repeated.  Other documents are kept if both their histograms lie within the given
    Jensen-Shannon distances of a reference (see :func:`references`): that of their own language, however
    few documents it has, that of the whole corpus, or one of the ``common`` languages with most documents, as labels may be
    missing or wrong.  ``min_words`` is also the guard below which no distance is judged, as short
    texts stray far by chance.  Null texts have no words; repeated rows are judged
    each; extra columns are ignored; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    features = cut_lineage(histograms(base_counts(docs, "lang")).withColumn("base_failed", base_failed))
    found = references(features, shrinkage)
    ranked = found.orderBy(F.col("lang").isNotNull(), F.desc("n"), "lang").limit(common + 1).collect()  # the corpus, then languages
    near = near_words = F.lit(0.0)
    if ranked:
        judged = ~F.col("base_failed")
        near = F.when(judged, nearest("classes", [r["ref_classes"] for r in ranked]))
        near_words = F.when(judged, nearest("commons", [r["ref_commons"] for r in ranked]))
    if len(ranked) > common:
        rare = found.filter(F.col("lang").isNotNull() & ~F.col("lang").isin([r["lang"] for r in ranked[1:]]))
        features = features.join(rare.select("lang", "ref_classes", "ref_commons"), "lang", "left")
        own = lambda column: F.when(judged & F.col(f"ref_{column}").isNotNull(), F.expr(_bound(shares(column), "own", divergence("own", f"ref_{column}"))))
        near, near_words = F.least(near, own("classes")), F.least(near_words, own("commons"))
    return features.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        near.alias("class_distance"),
        near_words.alias("word_distance"),
    ).withColumn(
        "kept",
        ~F.col("base_failed")
        & (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance)
        & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance),
    )


def _distance_sql(p: str, q: str) -> str:
    total = "list_sum({0})::DOUBLE"
    return f"""sqrt(greatest(0, 0.5 * list_sum(list_transform(range(1, len({p}) + 1), lambda i:
      CASE WHEN {p}[i] > 0 THEN {p}[i] / {total.format(p)} * log2(2 * ({p}[i] / {total.format(p)}) / ({p}[i] / {total.format(p)} + {q}[i] / {total.format(q)})) ELSE 0 END +
      CASE WHEN {q}[i] > 0 THEN {q}[i] / {total.format(q)} * log2(2 * ({q}[i] / {total.format(q)}) / ({p}[i] / {total.format(p)} + {q}[i] / {total.format(q)})) ELSE 0 END))))"""


def _oracle() -> str:
    """The query's SQL: counts, summed references of the languages, and the least distances."""
    stages, rest = [], "t"
    for k, (_, pattern) in enumerate(CHARACTER_CLASSES):
        stages.append(f"r{k} AS (SELECT *, regexp_replace({rest}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS x{k} FROM {'base' if k == 0 else f'r{k - 1}'})")
        rest = f"x{k}"
    texts = ["t", *(f"x{k}" for k in range(len(CHARACTER_CLASSES)))]
    classes = ", ".join(f"length({a}) - length({b})" for a, b in zip(texts, texts[1:]))
    commons = ", ".join(f"len(list_filter(words, lambda w: lower(w) = '{c}'))" for c in COMMON_WORDS)
    sums = lambda column, n: "[" + ", ".join(f"sum({column}[{i}])" for i in range(1, n + 1)) + "]"
    mixed = lambda column, n: "[" + ", ".join(f"s.{column}[{i}] + 5.0 * a.{column}[{i}] / a.n" for i in range(1, n + 1)) + "]"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams SEMI JOIN
    (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) d ON d.doc_id = grams.doc_id AND d.g = grams.g) GROUP BY doc_id
), {", ".join(stages)}, counted AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(again.n, 0)::BIGINT AS n_repeat_words, [{classes}, length({rest})] AS k, [{commons}] AS c FROM {f"r{len(CHARACTER_CLASSES) - 1}"} LEFT JOIN again USING (doc_id)
), judged AS (
  SELECT *, list_append(c, n_words - list_sum(c)) AS w, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), summed AS (
  SELECT lang, count(*) AS n, {sums("k", N_CLASSES)} AS k, {sums("w", N_COMMONS)} AS w FROM judged WHERE NOT base_failed GROUP BY lang
), whole AS (
  SELECT count(*) AS n, {sums("k", N_CLASSES)} AS k, {sums("w", N_COMMONS)} AS w FROM judged WHERE NOT base_failed
), refs AS (
  SELECT s.lang, {mixed("k", N_CLASSES)} AS k, {mixed("w", N_COMMONS)} AS w, row_number() OVER (ORDER BY s.n DESC, s.lang) AS place
  FROM summed s CROSS JOIN whole a WHERE s.lang IS NOT NULL
  UNION ALL SELECT NULL, k, w, 0 FROM whole WHERE n > 0
), near AS (
  SELECT j.doc_id, min({_distance_sql("j.k", "r.k")}) AS class_distance, min({_distance_sql("j.w", "r.w")}) AS word_distance
  FROM judged j JOIN refs r ON r.place <= 16 OR r.lang = j.lang WHERE NOT j.base_failed GROUP BY j.doc_id
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
  NOT base_failed AND coalesce(class_distance, 0) <= 0.30 AND coalesce(word_distance, 0) <= 0.62 AS kept FROM judged j LEFT JOIN near USING (doc_id)
"""


ORACLE = _oracle()
