"""Named queries over the library view of a data directory, each with equivalent SQL.

The SQL is for DuckDB over the same tables; names and types of columns agree.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions import hashing, paths
from darkroom.functions.vectors import l2_normalized, rounded, stub_embedding
from darkroom.operators import classify, grouping, ingest, learning, matching, ranking, ratings, review
from darkroom.operators.classify import Filter, listing
from darkroom.operators.learning import LinearHead, MlpHead, initial, predict_linear, predict_mlp
from darkroom.schema import schema
from darkroom.sources import library
from darkroom.sources.library import read
from darkroom.sources.scratch import delete, materialize, owned, shared_folder
from darkroom.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Query]:
    return {name: owned(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: The library view: see darkroom.sources.library.
INSTANCES = """
inst AS (
  SELECT doc_id AS instance_id, sha256(text) AS sha256, source || '/doc-' || doc_id || '.' || lang AS current_path,
         lower(source || '/doc-' || doc_id || '.' || lang) AS path_key, lang AS extension, source,
         strlen(text)::BIGINT AS file_size, n_chars AS width, (doc_id % 97 + 1)::BIGINT AS height,
         (n_chars % 101)::DOUBLE AS quality FROM documents
), rec AS (
  SELECT i.*, a.asset_id FROM inst i JOIN (SELECT sha256, min(instance_id) AS asset_id FROM inst GROUP BY sha256) a USING (sha256)
), rat AS (SELECT doc_id AS instance_id, (1 + 3 * quality + toxic)::INT AS rating, doc_id AS event_id FROM labels)
"""
WITH = "WITH " + INSTANCES
GROUPS = """, sizes AS (SELECT asset_id, count(*)::BIGINT AS n_members FROM rec GROUP BY asset_id HAVING count(*) >= 2)"""


# ---------------------------------------------------------------- sources and functions


@query(
    """SELECT count(*)::BIGINT AS n_rows, sum(l_quantity)::DOUBLE AS sum_quantity, min(l_shipdate) AS first_ship,
       max(l_shipdate) AS last_ship FROM lineitem WHERE l_quantity < 10"""
)
def table_scan_pushdown(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").filter("l_quantity < 10")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_quantity"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query(
    r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
    SELECT page_id, lower(trim(regexp_extract(name, '^.+\.([^.]*)$', 1))) AS ext,
      lower(trim(CASE WHEN name LIKE '_%.%' THEN regexp_replace(name, '(.)\.[^.]*$', '\1') ELSE name END)) AS stem,
      lower(trim(replace(url, '\', '/'))) AS path_key,
      CASE WHEN lower(trim(replace(url, '\', '/'))) LIKE '%/' THEN lower(trim(replace(url, '\', '/')))
           ELSE lower(trim(replace(url, '\', '/'))) || '/' END AS root_key, name AS file_name FROM u"""
)
def path_functions(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", paths.extension(url).alias("ext"), paths.stem(url).alias("stem"), paths.path_key(url).alias("path_key"),
        paths.root_key(url).alias("root_key"), paths.file_name(url).alias("file_name"),
    )


_EXTS = ["jpg", "jpeg", "png", "webp", "heic", "heif", "rw2", "mp4", "mov", "aae", "xmp", "zip", "7z", "rar", "txt", ""]
_EXT_SQL = "list_extract(['" + "','".join(_EXTS) + "'], (doc_id % 16 + 1)::INT)"


@query(
    f"""WITH e AS (SELECT doc_id, {_EXT_SQL} AS ext FROM documents), c AS (SELECT doc_id, ext, CASE
      WHEN ext IN ('jpg','jpeg','png','webp','heic','heif') THEN 'image' WHEN ext = 'rw2' THEN 'raw_image'
      WHEN ext IN ('mp4','mov') THEN 'video' WHEN ext IN ('aae','xmp') THEN 'sidecar'
      WHEN ext IN ('zip','7z','rar') THEN 'archive' ELSE 'other' END AS file_class FROM e)
    SELECT file_class, ext, count(*)::BIGINT AS n, bool_and(file_class IN ('image','raw_image','video')) AS needs_sha,
      bool_and(file_class = 'image') AS needs_visual, bool_and(ext IN ('jpg','jpeg','png','webp')) AS decodable
    FROM c GROUP BY file_class, ext"""
)
def classify_extensions(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 16).cast("int"))
    rows = read(spark, sf_dir, "documents").select(ext.alias("ext")).withColumn("file_class", paths.file_class(F.col("ext")))
    return rows.groupBy("file_class", "ext").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(paths.needs_sha256(F.col("file_class"))).alias("needs_sha"),
        F.bool_and(paths.needs_visual(F.col("file_class"))).alias("needs_visual"), F.bool_and(paths.can_decode(F.col("ext"))).alias("decodable"),
    )


@query(
    f"""WITH e AS (SELECT doc_id, source, {_EXT_SQL} AS ext FROM documents)
    SELECT ext AS extension, count(*)::BIGINT AS n, min(source || '/f' || doc_id) AS example_path FROM e
    WHERE ext IN ('zip','7z','rar','txt','') GROUP BY ext"""
)
def unknown_formats_count(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 16).cast("int"))
    rows = read(spark, sf_dir, "documents").select(
        ext.alias("extension"), F.concat("source", F.lit("/f"), F.col("doc_id").cast("string")).alias("path")
    )
    _, _, counted = ingest.route(rows.withColumn("file_class", paths.file_class(F.col("extension"))))
    return ingest.unknown_formats(counted)


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", hashing.sha256_hex(F.col("text")).alias("sha256"), F.md5("text").alias("md5"))


_SIGNATURES = """
assets AS (SELECT text, min(doc_id) AS asset_id, max(n_chars) AS n_chars FROM documents GROUP BY text),
toks AS (SELECT asset_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda t: t <> '')) AS t FROM assets),
bins AS (SELECT asset_id, ('0x' || md5(t)[1:2])::INT % 64 AS b, count(*) AS c FROM toks GROUP BY ALL),
grid AS (SELECT a.asset_id, r.b, coalesce(x.c, 0) AS c FROM assets a CROSS JOIN range(64) r(b) LEFT JOIN bins x ON x.asset_id = a.asset_id AND x.b = r.b),
e AS (SELECT asset_id, list(c::DOUBLE / greatest(m, 1) ORDER BY b) AS e FROM (SELECT *, max(c) OVER (PARTITION BY asset_id) AS m FROM grid) GROUP BY asset_id),
m AS (SELECT asset_id, e, list_sum(e[2:64]) / 63 AS mean FROM e),
bits AS (SELECT asset_id, e,
  list_reduce(list_transform(e[2:64], lambda x: CASE WHEN x > mean THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda a, x: a * 2 + x) AS phash,
  list_reduce(list_transform(range(1, 64), lambda i: CASE WHEN e[i] > e[i + 1] THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda a, x: a * 2 + x) AS dhash FROM m),
sig AS (SELECT asset_id, e, phash::BIGINT AS phash, dhash::BIGINT AS dhash FROM bits)
"""
_CANDIDATES = _SIGNATURES + """, cand AS (SELECT a.asset_id AS a, b.asset_id AS b, a.e AS x, b.e AS y FROM sig a JOIN sig b
  ON a.asset_id < b.asset_id AND bit_count(xor(a.phash, b.phash)) <= 8 AND bit_count(xor(a.dhash, b.dhash)) <= 12)
"""
_CONFIRMED = _CANDIDATES + """, stats AS (SELECT a, b, x, y, list_sum(x) / 64 AS mx, list_sum(y) / 64 AS my FROM cand),
cov AS (SELECT a, b, mx, my, list_sum(list_transform(x, lambda v: (v - mx) * (v - mx))) / 63 AS vx,
  list_sum(list_transform(y, lambda v: (v - my) * (v - my))) / 63 AS vy,
  list_sum(list_transform(range(1, 65), lambda i: (x[i] - mx) * (y[i] - my))) / 63 AS c FROM stats),
scored AS (SELECT a, b, least(1, greatest(0, ((2 * mx * my + 1e-4) * (2 * c + 9e-4)) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4)))) AS s FROM cov),
pairs AS (SELECT a, b, s FROM scored WHERE s >= 0.97)
"""


@query("WITH " + _SIGNATURES + "SELECT asset_id, printf('%016x', phash) AS phash_hex, printf('%016x', dhash) AS dhash_hex, phash, dhash FROM sig")
def phash_dhash_hex(spark, sf_dir):
    return library.signatures(spark, sf_dir).select(
        "asset_id", hashing.hex16(F.col("phash")).alias("phash_hex"), hashing.hex16(F.col("dhash")).alias("dhash_hex"), "phash", "dhash"
    )


@query("WITH " + _CANDIDATES + "SELECT a, b FROM cand")
def hamming_candidates(spark, sf_dir):
    return matching.hamming_join(library.signatures(spark, sf_dir))


def _twin_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of twin classes, and all assets with their class."""
    found = library.signatures(spark, sf_dir)
    nodes = materialize(found.join(matching.twin_classes(found), "asset_id"))
    firsts = nodes.filter("asset_id = twin")
    return matching.confirmed_pairs(matching.hamming_join(firsts), firsts), nodes


@query("WITH " + _CONFIRMED + "SELECT a, b, round(s, 6) AS similarity FROM pairs")
def ssim_confirmed_pairs(spark, sf_dir):
    pairs, nodes = _twin_pairs(spark, sf_dir)
    return matching.expanded(pairs, nodes).select("a", "b", F.round("similarity", 6).alias("similarity"))


_CLIQUES = "WITH RECURSIVE " + _CONFIRMED + """, ways AS (SELECT a, b, s FROM pairs UNION ALL SELECT b, a, s FROM pairs),
verts AS (SELECT a AS v, list(b ORDER BY s DESC, b) AS near, row_number() OVER (ORDER BY max(d.n_chars % 101) DESC, a) AS k
  FROM ways JOIN documents d ON d.doc_id = a GROUP BY a),
known AS (SELECT list(a || '-' || b) AS links FROM ways),
steps AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS used, []::BIGINT[] AS clique
  UNION ALL
  SELECT k, CASE WHEN len(c) > 1 THEN list_concat(used, c) ELSE used END, c FROM (
    SELECT v.k, used, CASE WHEN list_contains(used, v.v) THEN []::BIGINT[] ELSE
      list_reduce(list_prepend([v.v], list_transform(near, lambda x: [x])), lambda c, x: CASE WHEN len(c) < 4 AND NOT list_contains(used, x[1])
        AND len(list_filter(c, lambda m: NOT list_contains(links, m || '-' || x[1]))) = 0 THEN list_concat(c, x) ELSE c END) END AS c
    FROM steps s JOIN verts v ON v.k = s.k + 1, known)
), placed AS (SELECT clique[1] AS anchor_id, unnest(clique) AS asset_id, clique FROM steps WHERE len(clique) > 1)
SELECT anchor_id, asset_id, round((SELECT max(s) FROM ways WHERE ways.a = asset_id AND list_contains(clique, ways.b)), 6) AS similarity FROM placed
"""


@query(_CLIQUES)
def greedy_cliques(spark, sf_dir):
    pairs, nodes = _twin_pairs(spark, sf_dir)
    return matching.greedy_cliques(pairs, nodes).withColumn("similarity", F.round("similarity", 6))


@query(
    "WITH " + _CONFIRMED + """SELECT round(min(s), 6) AS least, round(max(s), 6) AS most, count(*)::BIGINT AS n FROM pairs"""
)
def similarity_summary(spark, sf_dir):
    counted = matching.counted(*_twin_pairs(spark, sf_dir))
    return counted.agg(F.round(F.min("similarity"), 6).alias("least"), F.round(F.max("similarity"), 6).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(
    """SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 5)) AS unit
    FROM embeddings"""
)
def l2_normalized_vectors(spark, sf_dir):
    unit = F.transform(l2_normalized(F.col("embedding")), lambda x: rounded(x, 5))
    return read(spark, sf_dir, "embeddings").select("vec_id", unit.alias("unit"))


_WEIGHT_SQL = "list_transform(range(1, 65), lambda i: sin(i * 0.618034) * 0.8)"


@query(
    f"""WITH s AS (SELECT vec_id, 1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({_WEIGHT_SQL})[i])) + 0.05))) AS s FROM embeddings)
    SELECT vec_id AS asset_id, round(s, 6) AS ai_score, round(2 * abs(s - 0.5), 6) AS ai_confidence,
      CASE WHEN s < 0.33 THEN 'low' WHEN s < 0.67 THEN 'maybe' ELSE 'high' END AS ai_bucket,
      (s < 0.2 AND 2 * abs(s - 0.5) > 0.6) AS delete_candidate FROM s"""
)
def linear_predict_buckets(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding")
    out = predict_linear(rows, LinearHead(initial((64,), 0.8), 0.05))
    return out.withColumns({c: F.round(c, 6) for c in ("ai_score", "ai_confidence")})


_UNIT = """u AS (SELECT vec_id AS asset_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"""


def _hidden(n: int, scale: float, before: int = 0) -> str:
    """A column of the outputs of ``n`` hidden units with start weights on the 64 places of e."""
    return (
        f"h AS (SELECT asset_id, list_transform(range(0, {n}), lambda j: greatest(0, list_sum(list_transform(range(1, 65), "
        f"lambda i: e[i] * sin((j * 64 + i + {before}) * 0.618034) * sqrt(2 / 64) * {scale})))) AS h FROM u)"
    )


@query(
    f"""WITH {_UNIT}, {_hidden(8, 0.35)},
    s AS (SELECT asset_id, h, 1 / (1 + exp(-list_sum(list_transform(range(1, 9), lambda j: h[j] * sin((j + 512) * 0.618034) * sqrt(2 / 8) * 0.35)))) AS s FROM h),
    c AS (SELECT asset_id, s, least(1, greatest(0, 2 * abs(s - 0.5) + 0.15 * list_sum(h) / 8)) AS c FROM s)
    SELECT asset_id, round(s, 6) AS ai_score, round(c, 6) AS ai_confidence, CASE WHEN s < 0.33 THEN 'low' WHEN s < 0.67 THEN 'maybe' ELSE 'high' END AS ai_bucket,
      s < 0.2 AND c > 0.6 AS delete_candidate FROM c"""
)
def mlp_predict(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding")
    return predict_mlp(rows, MlpHead.new(64)).withColumns({c: F.round(c, 6) for c in ("ai_score", "ai_confidence")})


@query(
    f"""WITH {_UNIT}, {_hidden(16, 0.28, 97)},
    s AS (SELECT asset_id, asset_id % 4 AS set_id, list_sum(list_transform(range(1, 17), lambda j: h[j] * sin((j + 1024 + 193) * 0.618034) * sqrt(2 / 16) * 0.25)) AS s FROM h)
    SELECT set_id, asset_id, round(s, 6) AS score, row_number() OVER (PARTITION BY set_id ORDER BY s DESC, asset_id)::BIGINT AS rank_position FROM s"""
)
def rank_model_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding")
    items = rows.select((F.col("asset_id") % 4).alias("set_id"), "asset_id")
    out = ranking.rank_set(rows, items, ranking.PairwiseNet.new(64))
    return out.select("set_id", "asset_id", F.round("score", 6).alias("score"), "rank_position")


@query(
    "WITH " + _SIGNATURES + """, hx AS (SELECT asset_id, printf('%016x', phash) AS p, printf('%016x', dhash) AS d FROM sig)
    SELECT asset_id, list_concat(list_transform(range(0, 16), lambda i: ((('0x' || p[i // 4 + 1])::INT >> (3 - i % 4)) & 1)::FLOAT),
      list_transform(range(0, 12), lambda i: ((('0x' || d[i // 4 + 1])::INT >> (3 - i % 4)) & 1)::FLOAT),
      [((n_chars % 101)::DOUBLE / 100)::FLOAT, (ln(1.8) / ln(51))::FLOAT, 0::FLOAT, 0::FLOAT]) AS embedding
    FROM hx JOIN documents ON doc_id = asset_id"""
)
def stub_embeddings(spark, sf_dir):
    found = library.signatures(spark, sf_dir)
    return found.select(
        "asset_id",
        stub_embedding(hashing.hex16(F.col("phash")), hashing.hex16(F.col("dhash")), F.col("quality"), F.lit(1000), F.lit(800)).alias("embedding"),
    )


# ---------------------------------------------------------------- groups and review


@query(WITH + GROUPS + "SELECT asset_id, n_members, 'exact:' || asset_id AS anchor FROM sizes")
def exact_groups(spark, sf_dir):
    return matching.exact_groups(library.active_records(spark, sf_dir))


_PLACED = GROUPS + """, placed AS (SELECT r.*, s.n_members, row_number() OVER (PARTITION BY r.asset_id
  ORDER BY quality DESC, width * height DESC, current_path) AS place FROM rec r JOIN sizes s USING (asset_id))"""


@query(
    WITH + _PLACED + """SELECT asset_id, instance_id, n_members, place::INT AS place,
    CASE WHEN place = 1 THEN 'recommended_keep' ELSE 'duplicate' END AS role, 1.0::DOUBLE AS similarity FROM placed"""
)
def exact_group_members_best(spark, sf_dir):
    found = matching.exact_members(library.active_records(spark, sf_dir))
    return found.select("asset_id", "instance_id", "n_members", "place", "role", "similarity")


@query(
    WITH + """SELECT source, instance_id, current_path, quality FROM (SELECT *, row_number() OVER (PARTITION BY source
    ORDER BY quality DESC, width * height DESC, current_path) AS k FROM rec) WHERE k = 1"""
)
def best_member_per_group(spark, sf_dir):
    records = library.active_records(spark, sf_dir).withColumn("pixels", F.col("width") * F.col("height"))
    return matching.best_member(records, "source").select("source", "instance_id", "current_path", "quality")


_PAIR = "source || '|' || ((doc_id // 7) % 40)"


@query(
    f"""WITH k AS (SELECT doc_id, {_PAIR} AS pair_key, lang = 'en' AS raw FROM documents),
    b AS (SELECT pair_key, count(*)::BIGINT AS n_members FROM k GROUP BY pair_key HAVING bool_or(raw) AND bool_or(NOT raw))
    SELECT doc_id, pair_key, n_members, CASE WHEN raw THEN 'protected_raw' ELSE 'paired_export' END AS role FROM k JOIN b USING (pair_key)"""
)
def raw_export_pairs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    key = F.concat("source", F.lit("|"), F.expr("cast((doc_id div 7) % 40 AS string)"))
    found = matching.raw_export_sets(docs, key, F.col("lang") == "en", F.col("lang") != "en")
    return found.select("doc_id", "pair_key", "n_members", "role")


def _groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Exact groups of the library as headers and members; every third is applied."""
    members = matching.exact_members(library.active_records(spark, sf_dir))
    members = members.select(F.col("asset_id").alias("group_id"), "asset_id", "instance_id", "role", "quality", "current_path")
    status = F.when(F.col("group_id") % 3 == 0, "applied").otherwise("pending")
    groups = members.select("group_id").distinct().select(
        "group_id", F.lit("exact").alias("kind"), status.alias("status"), (F.col("group_id") % 50).alias("updated_at")
    )
    return groups, members


_GROUP_SQL = _PLACED + """, grp AS (SELECT asset_id AS group_id, 'exact' AS kind, CASE WHEN asset_id % 3 = 0 THEN 'applied' ELSE 'pending' END AS status,
  (asset_id % 50)::BIGINT AS updated_at, n_members FROM sizes),
mem AS (SELECT asset_id AS group_id, instance_id, quality, current_path FROM placed)"""


@query(WITH + _GROUP_SQL + "SELECT group_id AS id, kind, status, updated_at, n_members FROM grp WHERE status = 'pending'")
def list_groups_summary(spark, sf_dir):
    groups, members = _groups(spark, sf_dir)
    return review.list_groups(groups.withColumnRenamed("group_id", "id"), members, status="pending")


@query(
    WITH + _GROUP_SQL + """SELECT (SELECT count(*) FROM rec)::BIGINT AS n_files, (SELECT count(DISTINCT asset_id) FROM rec)::BIGINT AS n_assets,
    (SELECT count(*) FROM rat)::BIGINT AS n_rated, (SELECT count(*) FROM grp WHERE status = 'pending')::BIGINT AS n_pending_groups"""
)
def snapshot_counts(spark, sf_dir):
    groups, _ = _groups(spark, sf_dir)
    records = library.active_records(spark, sf_dir)
    one_row = [
        records.agg(F.count(F.lit(1)).alias("n_files")),
        records.select("asset_id").distinct().agg(F.count(F.lit(1)).alias("n_assets")),
        library.ratings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rated")),
        groups.agg(F.count_if(F.col("status") == "pending").alias("n_pending_groups")),
    ]
    out = one_row[0]
    for other in one_row[1:]:
        out = out.crossJoin(F.broadcast(other))  # one row each
    return out


@query(
    WITH + _GROUP_SQL + """, live AS (SELECT * FROM mem WHERE instance_id % 4 <> 0),
    n AS (SELECT group_id, count(*) AS c FROM live GROUP BY group_id),
    best AS (SELECT group_id, arg_min(instance_id, (-quality, current_path)) AS best FROM live GROUP BY group_id)
    SELECT g.group_id, g.status, best.best AS recommended_id FROM grp g LEFT JOIN n USING (group_id) LEFT JOIN best USING (group_id)
    WHERE g.status = 'applied' OR coalesce(n.c, 0) >= 2"""
)
def prune_small_groups(spark, sf_dir):
    groups, members = _groups(spark, sf_dir)
    records = library.active_records(spark, sf_dir)
    instances = records.select(
        F.col("instance_id").alias("id"), "current_path", F.col("instance_id").alias("content_asset_id"), (F.col("instance_id") % 4 != 0).alias("exists_flag")
    )
    assets = records.select(F.col("instance_id").alias("id"), F.col("quality").alias("quality_score"))
    headers = groups.select(F.col("group_id").alias("id"), "status", F.lit(None).cast("long").alias("recommended_keep_instance_id"))
    held = members.select("group_id", F.col("instance_id").alias("file_instance_id"))
    kept, _ = review.prune(headers, held, instances, assets)
    return kept.select(F.col("id").alias("group_id"), "status", F.col("recommended_keep_instance_id").alias("recommended_id"))


_DECISION_SQL = """, c AS (SELECT group_id, list_sort(list(instance_id)) AS ids FROM mem GROUP BY group_id),
 d AS (SELECT group_id, ids, CASE group_id % 6 WHEN 0 THEN ids[1:1] WHEN 1 THEN [] WHEN 2 THEN ids WHEN 3 THEN [ids[1], ids[1]] ELSE ids[1:1] END AS keep,
   CASE group_id % 6 WHEN 2 THEN [] WHEN 4 THEN ids WHEN 5 THEN list_append(ids[2:], -1) ELSE ids[2:] END AS recycle FROM c)
SELECT group_id, CASE WHEN len(list_distinct(keep)) < len(keep) THEN 'duplicate keep id'
  WHEN len(list_distinct(recycle)) < len(recycle) THEN 'duplicate recycle id'
  WHEN len(keep) = 0 THEN 'at least one file must be kept' WHEN len(recycle) = 0 THEN 'at least one file must be recycled'
  WHEN list_has_any(keep, recycle) THEN 'a file is both kept and recycled'
  WHEN NOT list_has_all(ids, list_concat(keep, recycle)) THEN 'a file is not in the group'
  WHEN NOT list_has_all(list_concat(keep, recycle), ids) THEN 'every file needs a decision' END AS error FROM d"""


@query(WITH + _GROUP_SQL + _DECISION_SQL)
def decision_validation(spark, sf_dir):
    _, members = _groups(spark, sf_dir)
    cases = members.groupBy("group_id").agg(F.array_sort(F.collect_list("instance_id")).alias("ids"))  # a group's members
    none = F.array().cast("array<bigint>")
    case, ids = F.col("group_id") % 6, F.col("ids")
    head, tail = F.slice(ids, 1, 1), F.slice(ids, F.lit(2), F.size(ids))
    keep = F.when(case == 1, none).when(case == 2, ids).when(case == 3, F.concat(head, head)).otherwise(head)
    recycle = F.when(case == 2, none).when(case == 4, ids).when(case == 5, F.concat(tail, F.array(F.lit(-1).cast("bigint")))).otherwise(tail)
    return cases.select("group_id", review.decision_error(keep, recycle, ids).alias("error"))


@query(
    WITH + _GROUP_SQL + """SELECT a.instance_id AS a, b.instance_id AS b FROM mem a JOIN mem b ON a.group_id = b.group_id AND a.instance_id < b.instance_id"""
)
def pair_cache_self_join(spark, sf_dir):
    _, members = _groups(spark, sf_dir)
    return matching.cached_pairs(members.select("group_id", F.col("instance_id").alias("content_asset_id")))


@query(
    WITH + _GROUP_SQL + """, d AS (SELECT 'exact:' || group_id AS anchor FROM grp WHERE group_id % 5 <> 0 UNION ALL SELECT 'exact:new' || group_id FROM grp WHERE group_id % 5 = 0),
    j AS (SELECT coalesce(d.anchor, 'exact:' || g.group_id) AS anchor, g.group_id, g.status, d.anchor IS NOT NULL AS dr FROM d FULL JOIN grp g ON d.anchor = 'exact:' || g.group_id)
    SELECT anchor, group_id, status, CASE WHEN group_id IS NULL THEN 'insert' WHEN dr AND status = 'applied' THEN 'archive_insert' WHEN dr THEN 'replace'
      WHEN status = 'applied' THEN 'keep' ELSE 'drop' END AS action,
      CASE WHEN dr AND status = 'applied' THEN anchor || '#applied:' || group_id || ':t1' END AS archived_anchor FROM j"""
)
def reconcile_groups(spark, sf_dir):
    groups, _ = _groups(spark, sf_dir)
    id_ = F.col("group_id").cast("string")
    anchor = F.when(F.col("group_id") % 5 != 0, F.concat(F.lit("exact:"), id_)).otherwise(F.concat(F.lit("exact:new"), id_))
    drafts = groups.select(anchor.alias("anchor"), "kind")
    held = groups.select(F.col("group_id").alias("id"), F.concat(F.lit("exact:"), id_).alias("anchor"), "status")
    return matching.reconcile(drafts, held, "t1")


# ---------------------------------------------------------------- ratings and listing


@query(WITH + "SELECT rec.asset_id, max(rating)::INT AS rating FROM rat JOIN rec USING (instance_id) GROUP BY rec.asset_id")
def best_rating_per_asset(spark, sf_dir):
    return ratings.best_per_asset(library.ratings(spark, sf_dir), library.active_records(spark, sf_dir))


@query(WITH + "SELECT rec.asset_id, arg_max(rating, event_id)::INT AS rating FROM rat JOIN rec USING (instance_id) GROUP BY rec.asset_id")
def latest_rating_per_asset(spark, sf_dir):
    return ratings.latest_per_asset(library.ratings(spark, sf_dir), library.active_records(spark, sf_dir))


@query(
    WITH + """, j AS (SELECT rec.instance_id, rating FROM rec LEFT JOIN rat USING (instance_id) WHERE rating >= 3)
    SELECT instance_id, rating, (SELECT count(*) FROM j)::BIGINT AS total FROM j ORDER BY instance_id LIMIT 500"""
)
def rated_page_total(spark, sf_dir):
    rows = ratings.list_rated(library.active_records(spark, sf_dir), library.ratings(spark, sf_dir), min_rating=3)
    shown, total_ = ratings.page(rows.select("instance_id", "rating"), 0, 500)
    return shown.crossJoin(F.broadcast(total_))  # one row


@query(
    """WITH ev AS (SELECT event_id, user_id AS file_instance_id, (event_id % 6)::INT AS rating FROM events),
    last AS (SELECT file_instance_id, max(event_id) AS m FROM ev GROUP BY ALL),
    prev AS (SELECT ev.* FROM ev WHERE event_id <> (SELECT max(event_id) FROM ev))
    SELECT file_instance_id, arg_max(rating, event_id)::INT AS rating FROM prev GROUP BY file_instance_id"""
)
def rating_undo_log(spark, sf_dir):
    """The current ratings of an event log after its last event is undone."""
    log = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_instance_id"), (F.col("event_id") % 6).cast("int").alias("rating"),
        F.lit(None).cast("string").alias("note"), "event_id", F.col("ts").alias("at"),
    )
    return ratings.current(ratings.undo(log, F.to_timestamp(F.lit("2030-01-01")))).select("file_instance_id", "rating")


def _rows(spark, sf_dir, wanted: Filter) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups, members = _groups(spark, sf_dir)
    records, rated = library.listed_records(spark, sf_dir), library.ratings(spark, sf_dir)
    rows = listing(records, rated, library.predictions(spark, sf_dir), members, groups, wanted, library.models(spark))
    return rows, members, groups


def _page(spark, sf_dir, wanted: Filter, sort: str, limit: int = 50, offset: int = 0) -> DataFrame:
    rows, members, groups = _rows(spark, sf_dir, wanted)
    shown = classify.with_first_group(classify.page(rows, sort, offset, limit), members, groups)
    return shown.select("instance_id", "asset_id", "current_path", "quality", "rating", "ai_score", "ai_bucket", "group_id", "group_status")


_LIVE = """SELECT rec.*, rat.rating, p.ai_score, 2 * abs(p.ai_score - 0.5) AS ai_confidence, rec.instance_id % 5 <> 0 AS preview_supported, rec.instance_id % 1000 AS last_seen_at,
  CASE WHEN p.ai_score < 0.33 THEN 'low' WHEN p.ai_score < 0.67 THEN 'maybe' WHEN p.ai_score IS NOT NULL THEN 'high' END AS ai_bucket,
  p.ai_score < 0.2 AND 2 * abs(p.ai_score - 0.5) > 0.6 AS delete_candidate, g.group_id, g.status AS group_status
  FROM rec LEFT JOIN rat USING (instance_id) LEFT JOIN (SELECT DISTINCT asset_id, (asset_id * 3 % 100)::DOUBLE / 100 AS ai_score FROM rec WHERE asset_id % 7 <> 0) p ON p.asset_id = rec.asset_id
  LEFT JOIN mem m ON m.instance_id = rec.instance_id LEFT JOIN grp g ON g.group_id = m.group_id
  WHERE rec.instance_id % 13 <> 0 AND rec.instance_id % 11 <> 0"""
_LIST = _GROUP_SQL + f""", lst AS ({_LIVE})
SELECT instance_id, asset_id, current_path, quality, rating, ai_score, ai_bucket, group_id, group_status FROM lst """


@query(WITH + _LIST + "ORDER BY quality DESC NULLS LAST, instance_id LIMIT 50")
def classify_quality_desc_page(spark, sf_dir):
    return _page(spark, sf_dir, Filter(), "quality_desc")


@query(WITH + _LIST + "ORDER BY rating DESC NULLS LAST, instance_id LIMIT 50 OFFSET 50")
def classify_rating_second_page(spark, sf_dir):
    return _page(spark, sf_dir, Filter(), "rating_desc", 50, 50)


@query(WITH + _LIST + "WHERE rating IS NULL ORDER BY current_path LIMIT 50")
def classify_unrated(spark, sf_dir):
    return _page(spark, sf_dir, Filter(rating_mode="unrated"), "path_asc")


@query(WITH + _LIST + "WHERE rating >= 4 ORDER BY quality, instance_id LIMIT 50")
def classify_min_rating(spark, sf_dir):
    return _page(spark, sf_dir, Filter(rating_mode="min", rating_min=4), "quality_asc")


@query(WITH + _LIST + "WHERE lower(current_path) LIKE '%src1/doc-1%' ORDER BY current_path LIMIT 50")
def classify_path_contains(spark, sf_dir):
    return _page(spark, sf_dir, Filter(path_contains=" SRC1/doc-1 "), "path_asc")


@query(WITH + _LIST + "WHERE group_id IS NULL ORDER BY width * height DESC, instance_id LIMIT 50")
def classify_not_in_group(spark, sf_dir):
    return _page(spark, sf_dir, Filter(group="not_in_group"), "resolution_desc")


@query(WITH + _LIST + "WHERE group_status = 'pending' ORDER BY quality DESC, instance_id LIMIT 500")
def classify_pending_group(spark, sf_dir):
    return _page(spark, sf_dir, Filter(group="pending_group"), "quality_desc", 500)


@query(
    WITH + _LIST + """WHERE quality BETWEEN 20 AND 80 AND width >= 500 AND height >= 10 AND width * height >= 10000 AND extension IN ('en', 'de')
    AND rating IS NOT NULL ORDER BY quality DESC, instance_id LIMIT 50"""
)
def classify_combined(spark, sf_dir):
    wanted = Filter("rated", quality_min=20, quality_max=80, width_min=500, height_min=10, megapixels_min=0.01, extensions=["EN", "de"])
    return _page(spark, sf_dir, wanted, "quality_desc")


#: Each filter of the listing, alone, with its condition in SQL.
_FILTERS: dict[str, tuple[Filter, str]] = {
    "none": (Filter(), "true"),
    "unrated": (Filter(rating_mode="unrated"), "rating IS NULL"),
    "rated": (Filter(rating_mode="rated"), "rating IS NOT NULL"),
    "rating_min": (Filter(rating_mode="min", rating_min=4), "rating >= 4"),
    "rating_min_without_value": (Filter(rating_mode="min"), "true"),
    "quality_min": (Filter(quality_min=50), "quality >= 50"),
    "quality_max": (Filter(quality_max=50), "quality <= 50"),
    "width_min": (Filter(width_min=500), "width >= 500"),
    "height_min": (Filter(height_min=40), "height >= 40"),
    "megapixels_min": (Filter(megapixels_min=0.03), "width * height >= 30000"),
    "preview_only": (Filter(preview_only=True), "preview_supported"),
    "extensions": (Filter(extensions=["EN", "fr"]), "extension IN ('en', 'fr')"),
    "path_contains": (Filter(path_contains=" DOC-1"), "current_path LIKE '%doc-1%'"),
    "score_min": (Filter(score_min=0.4), "ai_score >= 0.4"),
    "score_max": (Filter(score_max=0.4), "ai_score <= 0.4"),
    "bucket": (Filter(bucket="maybe"), "ai_bucket = 'maybe'"),
    "delete_candidate_only": (Filter(delete_candidate_only=True), "delete_candidate"),
    "has_prediction": (Filter(has_prediction=True), "ai_score IS NOT NULL"),
    "has_no_prediction": (Filter(has_prediction=False), "ai_score IS NULL"),
    "in_group": (Filter(group="in_group"), "group_id IS NOT NULL"),
    "not_in_group": (Filter(group="not_in_group"), "group_id IS NULL"),
    "pending_group": (Filter(group="pending_group"), "group_status = 'pending'"),
    "exact": (Filter(group="exact"), "group_status = 'pending'"),
    "similar": (Filter(group="similar"), "false"),
    "raw_jpeg_set": (Filter(group="raw_jpeg_set"), "false"),
}
#: Each order of the listing in SQL.
_ORDERS = {
    "quality_desc": "quality DESC NULLS LAST, instance_id", "quality_asc": "quality ASC NULLS LAST, instance_id",
    "rating_desc": "rating DESC NULLS LAST, instance_id", "rating_asc": "rating ASC NULLS LAST, instance_id",
    "resolution_desc": "width * height DESC NULLS LAST, instance_id", "path_asc": "current_path",
    "file_id_asc": "instance_id", "updated_desc": "last_seen_at DESC, instance_id",
    "ai_score_desc": "ai_score DESC NULLS LAST, instance_id", "ai_score_asc": "ai_score ASC NULLS LAST, instance_id",
}


@query(
    WITH + _GROUP_SQL + f", lst AS ({_LIVE}) "
    + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*)::BIGINT AS total FROM lst WHERE {c}" for n, (_, c) in _FILTERS.items())
)
def classify_filter_totals(spark, sf_dir):
    """The total under each filter of the listing, from one pass over it."""
    rows, members, groups = _rows(spark, sf_dir, Filter())
    return classify.totals(rows, {name: wanted for name, (wanted, _) in _FILTERS.items()}, members, groups)


@query(
    WITH + _GROUP_SQL + f", lst AS ({_LIVE}) "
    + " UNION ALL ".join(f"(SELECT '{n}' AS sort, instance_id FROM lst ORDER BY {c} LIMIT 7 OFFSET 20)" for n, c in _ORDERS.items())
)
def classify_sort_pages(spark, sf_dir):
    """A page under each order of the listing."""
    out = None
    for name in classify.SORTS:
        shown = classify.page(_rows(spark, sf_dir, Filter())[0], name, 20, 7).select(F.lit(name).alias("sort"), "instance_id")
        out = shown if out is None else out.unionAll(shown)
    return out


@query(
    WITH + _GROUP_SQL + f", lst AS ({_LIVE}) "
    + " UNION ALL ".join(f"(SELECT '{n}' AS sort, instance_id FROM lst ORDER BY {c} LIMIT 7 OFFSET 20)" for n, c in _ORDERS.items() if n != "path_asc")
)
def classify_pages_after(spark, sf_dir):
    """The page behind the twentieth row under the orders of the listing, found by that row's values."""
    rows = _rows(spark, sf_dir, Filter())[0]
    out = None
    for name, columns in classify.SORTS.items():
        if name != "path_asc":
            last = classify.page(rows, name, 19, 1).first().asDict()  # one row
            shown = classify.page_after(rows, name, {c: last[c] for c, _ in columns}, 7).select(F.lit(name).alias("sort"), "instance_id")
            out = shown if out is None else out.unionAll(shown)
    return out


@query(WITH + "SELECT count(*)::BIGINT AS total FROM rec WHERE instance_id % 13 <> 0 AND instance_id % 11 <> 0")
def classify_without_predictions(spark, sf_dir):
    """The listing where nothing was ever predicted: no file has a prediction."""
    rows = listing(library.listed_records(spark, sf_dir), library.ratings(spark, sf_dir), wanted=Filter(has_prediction=False))
    return classify.total(rows)


@query(WITH + "SELECT count(*)::BIGINT AS total FROM rec LEFT JOIN rat USING (instance_id) WHERE rating >= 4 AND instance_id % 13 <> 0 AND instance_id % 11 <> 0")
def classify_total(spark, sf_dir):
    rows = listing(library.listed_records(spark, sf_dir), library.ratings(spark, sf_dir), wanted=Filter("min", 4))
    return classify.total(rows)


@query(
    WITH + _GROUP_SQL + "SELECT instance_id, min(group_id) AS group_id, 'exact' AS group_kind, arg_min(status, group_id) AS group_status FROM mem JOIN grp USING (group_id) GROUP BY instance_id"
)
def classify_first_group(spark, sf_dir):
    groups, members = _groups(spark, sf_dir)
    return classify.first_group(members, groups)


# ---------------------------------------------------------------- ingest


def _state(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instances and assets of two thirds of the documents, and an observed manifest of all but a tenth."""
    records = library.active_records(spark, sf_dir)
    known = records.filter("instance_id % 3 != 0")
    instances = known.select(
        F.col("instance_id").alias("id"), F.col("asset_id").alias("content_asset_id"), "current_path", "path_key",
        F.lit("V").alias("volume_id"), F.col("instance_id").cast("string").alias("file_id"), "file_size",
        F.when(F.col("instance_id") % 5 == 0, 1).otherwise(0).cast("long").alias("modified_ms"), F.lit(True).alias("exists_flag"),
    )
    assets = known.groupBy("asset_id").agg(F.min("sha256").alias("sha256"), F.min("file_size").alias("file_size")).select(
        F.col("asset_id").alias("id"), "sha256", "file_size", F.col("sha256").alias("quick_fingerprint"),
        F.when(F.col("asset_id") % 7 == 0, 1).otherwise(2).alias("analysis_version"),
    )
    moved = F.col("instance_id") % 11 == 1
    observed = records.filter("instance_id % 10 != 9").select(
        F.when(moved, F.concat(F.lit("moved/"), "current_path")).otherwise(F.col("current_path")).alias("path"),
        F.when(moved, F.concat(F.lit("moved/"), "path_key")).otherwise(F.col("path_key")).alias("path_key"),
        F.col("file_size").alias("size"), F.lit(0).cast("long").alias("modified_ms"), F.lit("V").alias("volume_id"),
        F.col("instance_id").cast("string").alias("file_id"), "sha256", F.col("sha256").alias("quick_fingerprint"),
    )
    return observed, instances, assets


_STATE = """, kn AS (SELECT instance_id AS id, asset_id AS content_asset_id, current_path, path_key, instance_id::VARCHAR AS file_id, file_size,
   CASE WHEN instance_id % 5 = 0 THEN 1 ELSE 0 END AS modified_ms FROM rec WHERE instance_id % 3 <> 0),
 ast AS (SELECT asset_id AS id, min(sha256) AS sha256, min(file_size) AS file_size, CASE WHEN asset_id % 7 = 0 THEN 1 ELSE 2 END AS version
   FROM rec WHERE instance_id % 3 <> 0 GROUP BY asset_id),
 obs AS (SELECT CASE WHEN instance_id % 11 = 1 THEN 'moved/' ELSE '' END || current_path AS path, CASE WHEN instance_id % 11 = 1 THEN 'moved/' ELSE '' END || path_key AS path_key,
   file_size AS size, instance_id::VARCHAR AS file_id, sha256 FROM rec WHERE instance_id % 10 <> 9),
 st AS (SELECT o.*, k.id AS instance_id, k.content_asset_id AS known_asset_id, coalesce(k.id IS NOT NULL AND o.size = k.file_size AND k.modified_ms = 0
   AND o.file_id = k.file_id AND a.version = 2, false) AS is_unchanged FROM obs o LEFT JOIN kn k USING (path_key) LEFT JOIN ast a ON a.id = k.content_asset_id)
"""


@query(WITH + _STATE + "SELECT is_unchanged, instance_id IS NOT NULL AS known_path, count(*)::BIGINT AS n FROM st GROUP BY ALL")
def unchanged_test(spark, sf_dir):
    observed, instances, assets = _state(spark, sf_dir)
    state = ingest.with_state(observed, instances, assets).withColumn("is_unchanged", ingest.unchanged())
    return state.groupBy("is_unchanged", F.col("instance_id").isNotNull().alias("known_path")).agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH + _STATE + """SELECT k.id AS instance_id, k.current_path AS old_path, st.path, st.path_key FROM st JOIN kn k ON k.file_id = st.file_id AND k.path_key <> st.path_key
    WHERE NOT is_unchanged"""
)
def same_volume_moves(spark, sf_dir):
    observed, instances, assets = _state(spark, sf_dir)
    state = ingest.with_state(observed, instances, assets).filter(~ingest.unchanged())
    return ingest.same_volume_moves(state, instances)


@query(
    WITH + _STATE + """SELECT path_key, a.id AS asset_id FROM st JOIN ast a ON a.sha256 = st.sha256 AND a.file_size = st.size AND a.version = 2 WHERE NOT is_unchanged"""
)
def quick_fingerprint_semi_join(spark, sf_dir):
    observed, instances, assets = _state(spark, sf_dir)
    pending = ingest.with_state(observed, instances, assets).filter(~ingest.unchanged())
    hits, _ = ingest.known_content(pending, assets)
    return hits.select("path_key", "asset_id")


@query(
    WITH + _STATE + """SELECT CASE WHEN a.id IS NULL THEN 'create' WHEN a.version = 2 THEN 'reuse' ELSE 'refresh' END AS asset_action, count(*)::BIGINT AS n,
    count(DISTINCT coalesce(a.id::VARCHAR, st.sha256))::BIGINT AS n_assets FROM st LEFT JOIN ast a USING (sha256) WHERE NOT is_unchanged GROUP BY 1"""
)
def asset_resolution(spark, sf_dir):
    observed, instances, assets = _state(spark, sf_dir)
    pending = ingest.with_state(observed, instances, assets).filter(~ingest.unchanged())
    resolved = ingest.resolve_assets(pending.drop("known_sha256"), assets)
    return resolved.groupBy("asset_action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("asset_id").alias("n_assets"))


@query(
    WITH + _STATE + """SELECT k.id, (k.path_key IN (SELECT path_key FROM obs) OR NOT k.path_key LIKE 'src1/%') AS exists_flag FROM kn k"""
)
def mark_missing_anti(spark, sf_dir):
    observed, instances, _ = _state(spark, sf_dir)
    return ingest.mark_missing(instances, observed, ["SRC1"]).select("id", "exists_flag")


@query(
    WITH + _STATE + """, mv AS (SELECT st.path_key FROM st JOIN kn k ON k.file_id = st.file_id AND k.path_key <> st.path_key WHERE NOT is_unchanged),
    f AS (SELECT CASE WHEN is_unchanged THEN 'unchanged' WHEN instance_id IS NOT NULL AND known_asset_id = (SELECT a.id FROM ast a WHERE a.sha256 = st.sha256) THEN 'unchanged'
      WHEN instance_id IS NOT NULL THEN 'updated' WHEN path_key IN (SELECT path_key FROM mv) THEN 'updated' ELSE 'new' END AS d FROM st)
    SELECT count(*) FILTER (d = 'new')::BIGINT AS new_count, count(*) FILTER (d = 'updated')::BIGINT AS updated_count, count(*) FILTER (d = 'unchanged')::BIGINT AS unchanged_count FROM f"""
)
def disposition_counts(spark, sf_dir):
    observed, instances, assets = _state(spark, sf_dir)
    state = ingest.with_state(observed, instances, assets).withColumn("is_unchanged", ingest.unchanged())
    moves = ingest.same_volume_moves(state.filter(~F.col("is_unchanged")), instances).select("path_key", F.lit(True).alias("moved"))
    known = assets.select(F.col("id").alias("asset_id"), "sha256")
    files = state.join(known, "sha256", "left").join(moves, "path_key", "left").fillna(False, ["moved"])
    return ingest.run_counters(files.withColumn("disposition", ingest.disposition()))


@query(
    WITH + _STATE + """, mv AS (SELECT st.path_key, min(k.id) AS id FROM st JOIN kn k ON k.file_id = st.file_id AND k.path_key <> st.path_key
      WHERE NOT is_unchanged AND st.instance_id IS NULL GROUP BY st.path_key),
    single AS (SELECT content_asset_id, min(id) AS id FROM kn WHERE path_key NOT IN (SELECT path_key FROM obs) AND id NOT IN (SELECT id FROM mv) GROUP BY content_asset_id HAVING count(*) = 1),
    far AS (SELECT s.id, min(st.path_key) AS path_key FROM st JOIN ast a USING (sha256) JOIN single s ON s.content_asset_id = a.id
      WHERE NOT is_unchanged AND st.instance_id IS NULL AND st.path_key NOT IN (SELECT path_key FROM mv) GROUP BY s.id),
    f AS (SELECT CASE WHEN is_unchanged OR known_asset_id = a.id THEN 'unchanged' WHEN st.instance_id IS NOT NULL OR mv.id IS NOT NULL OR far.id IS NOT NULL THEN 'updated' ELSE 'new' END AS disposition,
      CASE WHEN mv.id IS NOT NULL THEN 'same_volume_move' WHEN far.id IS NOT NULL THEN 'cross_volume_move' ELSE 'none' END AS change_type
      FROM st LEFT JOIN ast a USING (sha256) LEFT JOIN mv ON mv.path_key = st.path_key LEFT JOIN far ON far.path_key = st.path_key)
    SELECT disposition, change_type, count(*)::BIGINT AS n FROM f GROUP BY ALL"""
)
def scan_dispositions(spark, sf_dir):
    """A whole scan over known instances and assets; file names end in .jpg, so that all are media."""
    observed, instances, assets = _state(spark, sf_dir)
    jpg = lambda c: F.concat(F.col(c), F.lit(".jpg"))
    observed = observed.withColumn("path", jpg("path"))
    instances = instances.withColumns({c: jpg(c) for c in ("current_path", "path_key")})
    empty = lambda t: spark.createDataFrame([], schema(t))
    now = F.to_timestamp(F.lit("2026-01-01"))
    out = ingest.scan(observed, ingest.fitted(instances, empty("file_instances")), ingest.fitted(assets, empty("content_assets")), ["src1"], 9, now)
    change = F.coalesce("change_type", F.lit("none")).alias("change_type")
    return out["files"].groupBy("disposition", change).agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH + _STATE + """, gone AS (SELECT k.* FROM kn k WHERE k.path_key LIKE 'src1/%' AND k.path_key NOT IN (SELECT path_key FROM obs)
      AND k.id NOT IN (SELECT k2.id FROM st JOIN kn k2 ON k2.file_id = st.file_id AND k2.path_key <> st.path_key WHERE NOT is_unchanged AND st.instance_id IS NULL))
    SELECT count(*)::BIGINT AS n_gone, (SELECT count(DISTINCT sha256) FROM (SELECT sha256 FROM ast UNION SELECT sha256 FROM obs))::BIGINT AS n_assets FROM gone"""
)
def scan_missing_and_assets(spark, sf_dir):
    """What a scan of one root marks as gone, and how many assets there are after it; cross-volume moves apart."""
    observed, instances, assets = _state(spark, sf_dir)
    jpg = lambda c: F.concat(F.col(c), F.lit(".jpg"))
    observed = observed.withColumn("path", jpg("path"))
    instances = instances.withColumns({c: jpg(c) for c in ("current_path", "path_key")})
    empty = lambda t: spark.createDataFrame([], schema(t))
    now = F.to_timestamp(F.lit("2026-01-01"))
    out = ingest.scan(observed, ingest.fitted(instances, empty("file_instances")), ingest.fitted(assets, empty("content_assets")), ["src1"], 9, now)
    far = out["path_history"].filter("change_type = 'cross_volume_move' AND old_path LIKE 'src1/%'").agg(F.count(F.lit(1)).alias("far"))
    gone = out["file_instances"].agg(F.count_if(~F.col("exists_flag")).alias("gone"))
    held = out["content_assets"].agg(F.count(F.lit(1)).alias("n_assets"))
    return gone.crossJoin(F.broadcast(far)).crossJoin(F.broadcast(held)).select((F.col("gone") + F.col("far")).alias("n_gone"), "n_assets")  # one row each


@query(
    """SELECT user_id AS instance_id, event_id, ts AS detected_at, prev AS old_path, event_type AS new_path FROM (SELECT *, lag(event_type)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev <> event_type"""
)
def move_history_lag(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("old_path", F.lag("event_type").over(order))
    return rows.filter(F.col("old_path") != F.col("event_type")).select(
        F.col("user_id").alias("instance_id"), "event_id", F.col("ts").alias("detected_at"), "old_path", F.col("event_type").alias("new_path")
    )


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS k, -o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0)
    SELECT count(*)::BIGINT AS n, round(sum(v), 2) AS v FROM (SELECT * FROM b UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b))"""
)
def upsert_by_key(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (-F.col("o_totalprice")).alias("v"))
    return ingest.upsert(old, new, ["k"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


# ---------------------------------------------------------------- ranking

_RANKED = """WITH sc AS (SELECT vec_id % 4 AS set_id, vec_id AS asset_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings),
 p AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, asset_id) AS rank_position, count(*) OVER (PARTITION BY set_id) AS n,
   lag(score) OVER (PARTITION BY set_id ORDER BY score DESC, asset_id) - score AS before, score - lead(score) OVER (PARTITION BY set_id ORDER BY score DESC, asset_id) AS after FROM sc),
 g AS (SELECT *, coalesce(least(before, after), 0.0) AS score_gap, rank_position * 100.0::DOUBLE / n AS percentile FROM p),
 q AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score_gap, asset_id) - 1 AS gi FROM g),
 c AS (SELECT set_id, max(CASE WHEN gi = floor((n - 1) * 0.35 + 0.5) THEN score_gap END) AS lo, max(CASE WHEN gi = floor((n - 1) * 0.7 + 0.5) THEN score_gap END) AS hi FROM q GROUP BY set_id),
 r AS (SELECT q.*, CASE WHEN percentile <= 20 THEN 'top' WHEN percentile >= 80 THEN 'back' ELSE 'mid' END AS rank_bucket,
   CASE WHEN score_gap <= lo THEN 'high' WHEN score_gap <= hi THEN 'medium' ELSE 'low' END AS uncertainty_bucket FROM q JOIN c USING (set_id))
"""


@query(_RANKED + "SELECT set_id, asset_id, rank_position::BIGINT AS rank_position, round(percentile, 6) AS percentile FROM r")
def rank_positions(spark, sf_dir):
    out = ranking.ranked(library.scores(spark, sf_dir))
    return out.select("set_id", "asset_id", "rank_position", F.round("percentile", 6).alias("percentile"))


@query(_RANKED + "SELECT set_id, asset_id, round(score_gap, 6) AS score_gap FROM r")
def rank_score_gaps(spark, sf_dir):
    return ranking.ranked(library.scores(spark, sf_dir)).select("set_id", "asset_id", F.round("score_gap", 6).alias("score_gap"))


@query(_RANKED + "SELECT set_id, asset_id, rank_bucket FROM r")
def rank_buckets(spark, sf_dir):
    return ranking.ranked(library.scores(spark, sf_dir)).select("set_id", "asset_id", "rank_bucket")


@query(_RANKED + "SELECT set_id, asset_id, uncertainty_bucket FROM r")
def uncertainty_buckets(spark, sf_dir):
    return ranking.ranked(library.scores(spark, sf_dir)).select("set_id", "asset_id", "uncertainty_bucket")


@query(
    _RANKED + """SELECT set_id, count(*)::BIGINT AS n_items, count(*) FILTER (rank_bucket = 'top')::BIGINT AS n_top, count(*) FILTER (rank_bucket = 'back')::BIGINT AS n_back,
    count(*) FILTER (uncertainty_bucket = 'high')::BIGINT AS n_uncertain_high, count(*) FILTER (uncertainty_bucket = 'medium')::BIGINT AS n_uncertain_medium FROM r GROUP BY set_id"""
)
def set_detail_counts(spark, sf_dir):
    return ranking.bucket_counts(ranking.ranked(library.scores(spark, sf_dir)))


_ITEMS = "it AS (SELECT vec_id % 4 AS set_id, vec_id AS asset_id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY label, vec_id) - 1 AS idx FROM embeddings)"
_NEXT = "nb AS (SELECT a.set_id, a.asset_id AS left_id, b.asset_id AS right_id, g.gap, a.idx FROM it a CROSS JOIN (SELECT unnest([1,2,4,8,16,32]) AS gap) g JOIN it b ON b.set_id = a.set_id AND b.idx = a.idx + g.gap)"


def _items(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    order = Window.partitionBy("set_id").orderBy("label", "asset_id")
    items = rows.select((F.col("vec_id") % 4).alias("set_id"), F.col("vec_id").alias("asset_id"), "label")
    return items.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).drop("label")


@query(f"WITH {_ITEMS}, {_NEXT} SELECT set_id, left_id, right_id, gap::INT AS gap, idx::BIGINT AS idx FROM nb")
def preference_neighbor_pairs(spark, sf_dir):
    return ranking.neighbour_pairs(_items(spark, sf_dir))


_VOTES = """vt AS (SELECT set_id, left_id, right_id, CASE (left_id + right_id) % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'tie' ELSE 'skip' END AS choice,
  CASE WHEN left_id % 2 = 0 THEN 1.0 ELSE 0.2 END::DOUBLE AS weight FROM nb WHERE gap = 1 AND idx % 2 = 0)"""


def _votes(spark, sf_dir) -> DataFrame:
    near = ranking.neighbour_pairs(_items(spark, sf_dir), (1,)).filter("idx % 2 = 0")
    choice = F.get(F.array(*map(F.lit, ranking.CHOICES)), ((F.col("left_id") + F.col("right_id")) % 4).cast("int"))
    return near.select("set_id", "left_id", "right_id", choice.alias("choice"), F.when(F.col("left_id") % 2 == 0, 1.0).otherwise(0.2).alias("weight"))


@query(
    f"""WITH {_ITEMS}, {_NEXT}, {_VOTES} SELECT nb.set_id, nb.left_id, nb.right_id, nb.gap::INT AS gap, nb.idx::BIGINT AS idx, 'cold_start' AS source FROM nb
    WHERE NOT EXISTS (SELECT 1 FROM vt WHERE vt.set_id = nb.set_id AND ((vt.left_id = nb.left_id AND vt.right_id = nb.right_id) OR (vt.left_id = nb.right_id AND vt.right_id = nb.left_id)))
    ORDER BY gap, idx, set_id LIMIT 30"""
)
def preference_tasks(spark, sf_dir):
    tasks = ranking.preference_tasks(_items(spark, sf_dir), _votes(spark, sf_dir), 30)
    return tasks.select("set_id", "left_id", "right_id", "gap", "idx", "source")


@query(
    f"""WITH {_ITEMS}, {_NEXT}, {_VOTES} SELECT CASE WHEN choice = 'right' THEN right_id ELSE left_id END AS better_id, CASE WHEN choice = 'right' THEN left_id ELSE right_id END AS worse_id,
    CASE WHEN choice = 'tie' THEN greatest(weight, 0.4) ELSE weight END::DOUBLE AS weight, choice = 'tie' AS tie FROM vt WHERE choice <> 'skip'"""
)
def vote_samples(spark, sf_dir):
    embeddings = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"))
    return ranking.vote_samples(_votes(spark, sf_dir), embeddings)


@query(
    WITH + """, b AS (SELECT rec.asset_id, max(rating) AS rating FROM rat JOIN rec USING (instance_id) GROUP BY rec.asset_id),
    p AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY asset_id) - 1 AS idx, count(*) OVER (PARTITION BY rating) AS size FROM b),
    lv AS (SELECT rating AS low, count(*) AS size FROM b GROUP BY rating)
    SELECT h.asset_id AS better_id, l.asset_id AS worse_id, round(least(0.5, greatest(0.2, 0.2 + 0.1 * (h.rating - lv.low - 2))), 6)::DOUBLE AS weight
    FROM p h JOIN lv ON lv.low <= h.rating - 2 CROSS JOIN range(2) k(k) JOIN p l ON l.rating = lv.low AND l.idx = (h.idx + k.k) % lv.size
    WHERE h.rating >= 2 AND k.k < least(2, lv.size)"""
)
def star_pairs(spark, sf_dir):
    return ranking.star_pairs(ratings.best_per_asset(library.ratings(spark, sf_dir), library.active_records(spark, sf_dir)))


@query(
    WITH + """SELECT 5::BIGINT AS set_id, asset_id, row_number() OVER (ORDER BY n) - 1 AS position FROM (SELECT asset_id, min(n) AS n FROM
    (SELECT asset_id, row_number() OVER (ORDER BY quality DESC, instance_id) AS n FROM rec) GROUP BY asset_id)"""
)
def create_set_positions(spark, sf_dir):
    rows = library.active_records(spark, sf_dir).select("asset_id", "quality", "instance_id")
    return ranking.create_set(rows, [F.desc("quality"), F.col("instance_id")], 5)


@query(
    _RANKED + ", " + INSTANCES + """, ph AS (SELECT asset_id, min(instance_id) AS instance_id FROM rec WHERE instance_id % 13 <> 0 AND instance_id % 11 <> 0 GROUP BY asset_id),
    lr AS (SELECT rec.asset_id, arg_max(rating, event_id) AS rating FROM rat JOIN rec USING (instance_id) GROUP BY rec.asset_id)
    SELECT r.set_id, r.asset_id, r.rank_position::BIGINT AS rank_position, ph.instance_id, CASE WHEN ph.instance_id IS NOT NULL THEN lr.rating END::INT AS rating
    FROM r LEFT JOIN ph USING (asset_id) LEFT JOIN lr USING (asset_id) WHERE rank_bucket = 'top'"""
)
def ranked_items_page(spark, sf_dir):
    ranks = ranking.ranked(library.scores(spark, sf_dir))
    out = ranking.ranked_items(ranks, library.listed_records(spark, sf_dir), library.ratings(spark, sf_dir), "top")
    return out.select("set_id", "asset_id", "rank_position", "instance_id", "rating")


@query(
    WITH + """SELECT count(*) FILTER (rating > 2)::BIGINT AS n_rated, count(*) FILTER (instance_id % 13 <> 0 AND instance_id % 11 <> 0)::BIGINT AS n_rated_images
    FROM rat JOIN rec USING (instance_id)"""
)
def rated_counts(spark, sf_dir):
    files = library.listed_records(spark, sf_dir).withColumnRenamed("instance_id", "id")
    rated = library.ratings(spark, sf_dir).select(F.col("instance_id").alias("file_instance_id"), (F.col("rating") - 2).alias("rating"))
    return learning.rated_counts(rated, files)


@query(
    WITH + """SELECT asset_id, arg_min(instance_id, (-quality, current_path)) AS instance_id FROM rec WHERE extension <> 'fr' GROUP BY asset_id"""
)
def representatives_per_asset(spark, sf_dir):
    records = library.active_records(spark, sf_dir).withColumn("preview", F.when(F.col("extension") != "fr", F.col("extension")))
    return matching.representatives(records, ["preview"]).select("asset_id", "instance_id")


@query(
    WITH + _GROUP_SQL + """SELECT group_id AS anchor_id, 'similar:' || string_agg(instance_id::VARCHAR, '-' ORDER BY instance_id) AS anchor, count(*)::BIGINT AS n_members
    FROM mem GROUP BY group_id"""
)
def similar_anchors(spark, sf_dir):
    _, members = _groups(spark, sf_dir)
    return matching.similar_anchor(members.select(F.col("group_id").alias("anchor_id"), F.col("instance_id").alias("asset_id")))


_PAIRS = """, pr AS (SELECT a.instance_id AS a, b.instance_id AS b FROM mem a JOIN mem b ON a.group_id = b.group_id AND a.instance_id < b.instance_id)"""


@query(
    WITH + _GROUP_SQL + _PAIRS + """SELECT a, b, 'fresh' AS kind, NULL::DOUBLE AS similarity FROM pr WHERE a % 3 = 0 OR b % 3 = 0
    UNION ALL SELECT a, b, 'reused' AS kind, (a % 10)::DOUBLE / 10 AS similarity FROM pr WHERE a % 3 <> 0 AND b % 3 <> 0 AND a % 2 = 0"""
)
def incremental_pairs_split(spark, sf_dir):
    _, members = _groups(spark, sf_dir)
    pairs = matching.cached_pairs(members.select("group_id", F.col("instance_id").alias("content_asset_id")))
    new = members.filter("instance_id % 3 = 0").select(F.col("instance_id").alias("asset_id")).distinct()
    cached = pairs.filter("a % 2 = 0").withColumn("similarity", (F.col("a") % 10).cast("double") / 10)
    todo, reused = matching.incremental_pairs(pairs, new, cached)
    none = F.lit(None).cast("double").alias("similarity")
    return todo.select("a", "b", F.lit("fresh").alias("kind"), none).unionByName(reused.withColumn("kind", F.lit("reused")))


@query(
    WITH + _GROUP_SQL + """SELECT g.group_id AS id, g.status, g.n_members, rec.current_path AS recommended_path FROM grp g
    LEFT JOIN rec ON rec.instance_id = CASE WHEN g.group_id % 2 = 0 THEN g.group_id END"""
)
def list_groups_recommended(spark, sf_dir):
    groups, members = _groups(spark, sf_dir)
    best = F.when(F.col("group_id") % 2 == 0, F.col("group_id")).alias("recommended_keep_instance_id")
    headers = groups.select(F.col("group_id").alias("id"), "status", "updated_at", best)
    files = library.active_records(spark, sf_dir).withColumnRenamed("instance_id", "id")
    return review.list_groups(headers, members, instances=files).select("id", "status", "n_members", "recommended_path")


@query("WITH " + _SIGNATURES + "SELECT asset_id, min(asset_id) OVER (PARTITION BY phash, dhash) AS rep FROM sig")
def hash_class_members(spark, sf_dir):
    return matching.hash_classes(library.signatures(spark, sf_dir)).select("asset_id", "rep")


@query(
    WITH + _GROUP_SQL + """SELECT coalesce(CASE WHEN status = 'applied' AND group_id % 5 <> 0 THEN 'archived' END, CASE WHEN group_id % 5 <> 0 THEN 'replaced' END,
      CASE WHEN status = 'applied' THEN 'kept' ELSE 'dropped' END) AS fate, count(*)::BIGINT AS n_groups, sum(n_members)::BIGINT AS n_members FROM grp GROUP BY ALL"""
)
def recompute_fates(spark, sf_dir):
    """What becomes of known groups when the drafts of four fifths of them are found again."""
    groups, members = _groups(spark, sf_dir)
    drafts = matching.exact_drafts(library.active_records(spark, sf_dir)).filter("asset_id % 5 != 0")
    anchor = F.concat(F.lit("exact:"), F.col("group_id").cast("string"))
    none = F.lit(None).cast("long").alias("recommended_keep_instance_id")
    headers = groups.select(F.col("group_id").alias("id"), anchor.alias("anchor"), "kind", "status", none)
    held = members.select("group_id", F.col("instance_id").alias("file_instance_id"), F.col("asset_id").alias("content_asset_id"), F.lit(1.0).alias("similarity"), "role")
    out, kept = matching.recompute(drafts, headers, held, None, "t1")
    sizes = kept.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("after"))
    before = held.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("before"))
    joined = headers.select("id").join(out.join(sizes, "id", "left"), "id", "left").join(before, "id")
    fate = F.when(F.col("anchor").isNull(), "dropped").when(F.col("anchor").contains("#applied"), "archived").when(F.col("recommended_keep_instance_id").isNotNull(), "replaced").otherwise("kept")
    return joined.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.coalesce("after", "before")).alias("n_members"))


# ---------------------------------------------------------------- generic listing at scale


@query(
    """SELECT o_orderkey, c_name, o_totalprice, n_lines, qty FROM (SELECT o.o_orderkey, c.c_name, o.o_totalprice, count(*)::BIGINT AS n_lines, sum(l_quantity)::DOUBLE AS qty
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY ALL)
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""
)
def orders_listing_page(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty")
    )
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(lines, "o_orderkey")
    shown = joined.select("o_orderkey", "c_name", "o_totalprice", "n_lines", "qty")
    return shown.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


_EIGHT_BIT = "WITH " + _SIGNATURES.replace("sig AS (", "all_sig AS (") + """,
eight AS (SELECT asset_id, phash, dhash, list_transform(e, lambda x: floor(x * 255 + 0.5) / 255) AS e FROM all_sig),
sig AS (SELECT min(asset_id) AS asset_id, e, phash, dhash FROM eight GROUP BY e, phash, dhash)
""" + _CONFIRMED.removeprefix(_SIGNATURES)


@query(_EIGHT_BIT + "SELECT a, b, round(s, 6) AS similarity FROM pairs")
def incremental_similar_pairs(spark, sf_dir):
    """All similar pairs, found in three runs of an index that is kept between them."""
    found = library.signatures(spark, sf_dir)
    eight = F.transform("buffer", lambda x: F.lpad(F.hex(F.floor(x * 255 + 0.5).cast("long")), 2, "0"))
    none = F.lit(None).cast("int")
    features = found.select(
        F.col("asset_id").alias("content_asset_id"), "phash", "dhash", F.col("quality").alias("quality_score"), none.alias("width"), none.alias("height"),
        F.unhex(F.array_join(eight, "")).alias("buffer"),
    )
    folder = f"{shared_folder(spark)}/index-{uuid4().hex}"
    store = Store(spark, folder)
    run = F.pmod(F.xxhash64("content_asset_id"), F.lit(3))  # each asset comes in one of three runs
    for number in range(3):
        grouping.extend(store, features.filter(run == number))
    # Classes are named by the asset that came first, the SQL names them by the least id.
    named = found.select("asset_id").join(store.read("picture_twins").withColumnRenamed("content_asset_id", "asset_id"), "asset_id")
    least = named.groupBy("twin").agg(F.min("asset_id").alias("least"))
    pairs = store.read("similar_pairs")
    for side in ("a", "b"):
        pairs = pairs.join(least.select(F.col("twin").alias(side), F.col("least").alias(f"{side}_")), side)
    out = materialize(pairs.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), F.round("similarity", 6).alias("similarity")))
    delete(spark, folder)
    return out
