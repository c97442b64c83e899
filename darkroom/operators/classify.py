"""The listing query: files with asset, rating, prediction and first group; filters, orders, pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.paths import contains_folded, megapixels_at_least
from darkroom.operators.learning import active_model


@dataclass(frozen=True)
class Filter:
    """Listing filters; None filters nothing."""

    rating_mode: str = "all"  # all, unrated, rated, min
    rating_min: int | None = None
    quality_min: float | None = None
    quality_max: float | None = None
    width_min: int | None = None
    height_min: int | None = None
    megapixels_min: float | None = None
    preview_only: bool = False
    extensions: list[str] = field(default_factory=list)
    path_contains: str | None = None
    score_min: float | None = None
    score_max: float | None = None
    bucket: str | None = None
    delete_candidate_only: bool = False
    has_prediction: bool | None = None
    group: str | None = None  # in_group, not_in_group, pending_group or a kind of pending group

    def conditions(self) -> list[Column]:
        """Conditions on the joined row; a missing value never satisfies a bound."""
        out: list[Column] = []
        add = out.append
        if self.rating_mode == "unrated":
            add(F.col("rating").isNull())
        elif self.rating_mode == "rated":
            add(F.col("rating").isNotNull())
        elif self.rating_mode == "min" and self.rating_min is not None:
            add(F.col("rating") >= self.rating_min)
        for column, low, high in (("quality", self.quality_min, self.quality_max), ("ai_score", self.score_min, self.score_max)):
            if low is not None:
                add(F.col(column) >= low)
            if high is not None:
                add(F.col(column) <= high)
        if self.width_min is not None:
            add(F.col("width") >= self.width_min)
        if self.height_min is not None:
            add(F.col("height") >= self.height_min)
        if self.megapixels_min is not None:
            add(megapixels_at_least(F.col("width"), F.col("height"), self.megapixels_min))
        if self.preview_only:
            add(F.col("preview_supported"))
        if self.extensions:
            add(F.lower("extension").isin([e.lower() for e in self.extensions]))
        if self.path_contains and self.path_contains.strip():
            add(contains_folded(F.col("current_path"), self.path_contains))
        if self.bucket is not None:
            add(F.col("ai_bucket") == self.bucket)
        if self.delete_candidate_only:
            add(F.col("delete_candidate"))
        if self.has_prediction is not None:
            add(F.col("ai_score").isNotNull() if self.has_prediction else F.col("ai_score").isNull())
        return out


#: Sort orders.  Paths are unique; all others end with the id.
SORTS: dict[str, list[tuple[str, bool]]] = {
    "quality_desc": [("quality", False), ("instance_id", True)],
    "quality_asc": [("quality", True), ("instance_id", True)],
    "rating_desc": [("rating", False), ("instance_id", True)],
    "rating_asc": [("rating", True), ("instance_id", True)],
    "path_asc": [("current_path", True)],
    "file_id_asc": [("instance_id", True)],
    "updated_desc": [("last_seen_at", False), ("instance_id", True)],
    "resolution_desc": [("pixels", False), ("instance_id", True)],
    "ai_score_desc": [("ai_score", False), ("instance_id", True)],
    "ai_score_asc": [("ai_score", True), ("instance_id", True)],
}


def order(sort: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in SORTS[sort]]


def first_group(members: DataFrame, groups: DataFrame) -> DataFrame:
    """instance_id, group_id, group_kind, group_status of the group with the least id."""
    joined = members.select("group_id", "instance_id").join(groups.select("group_id", "kind", "status"), "group_id")
    least = joined.groupBy("instance_id").agg(F.min_by(F.struct("group_id", "kind", "status"), "group_id").alias("g"))
    return least.select("instance_id", F.col("g.group_id"), F.col("g.kind").alias("group_kind"), F.col("g.status").alias("group_status"))


def in_group(rows: DataFrame, wanted: str | None, members: DataFrame, groups: DataFrame) -> DataFrame:
    """The group filter: semi-join or anti-join with the members of the groups asked for."""
    if wanted is None:
        return rows
    chosen = groups
    if wanted == "pending_group":
        chosen = groups.filter("status = 'pending'")
    elif wanted not in ("in_group", "not_in_group"):
        chosen = groups.filter((F.col("status") == "pending") & (F.col("kind") == wanted))
    of = members.join(chosen.select("group_id"), "group_id", "left_semi").select("instance_id")
    return rows.join(of, "instance_id", "left_anti" if wanted == "not_in_group" else "left_semi")


#: What a prediction says of an asset.
PREDICTED = {"ai_score": "double", "ai_confidence": "double", "ai_bucket": "string", "delete_candidate": "boolean"}


def with_predictions(rows: DataFrame, predictions: DataFrame | None, models: DataFrame | None) -> DataFrame:
    """``rows`` with the active model's predictions; all null if there are none or no model is active.

    ``predictions`` has asset_id, model_id and the columns of PREDICTED; without ``models`` all
    of them are taken as one model's.
    """
    if predictions is None:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in PREDICTED.items()})
    if models is not None:
        active = active_model(models).select(F.col("id").alias("model_id"))
        predictions = predictions.join(F.broadcast(active), "model_id")  # one row at most
    return rows.join(predictions.select("asset_id", *PREDICTED), "asset_id", "left")


def listing(
    records: DataFrame,
    ratings: DataFrame,
    predictions: DataFrame | None = None,
    members: DataFrame | None = None,
    groups: DataFrame | None = None,
    wanted: Filter = Filter(),
    models: DataFrame | None = None,
) -> DataFrame:
    """Filtered rows of live images, before order and page.

    ``records`` has exists_flag, file_class and preview_supported besides what is shown.  Filters on
    the files run before the joins.
    """
    rows = records.filter(F.col("exists_flag") & (F.col("file_class") == "image"))
    rows = rows.withColumn("pixels", F.col("width").cast("long") * F.col("height").cast("long"))
    rows = rows.join(ratings.select("instance_id", "rating"), "instance_id", "left")
    rows = with_predictions(rows, predictions, models)
    if wanted.conditions():
        rows = rows.filter(reduce(and_, wanted.conditions()))
    if groups is not None and members is not None:
        rows = in_group(rows, wanted.group, members, groups)
    return rows


def with_first_group(shown: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of a page with their first group; only groups of files on the page are looked at."""
    of_page = members.join(shown.select("instance_id"), "instance_id", "left_semi")
    return shown.join(first_group(of_page, groups), "instance_id", "left")


def page(rows: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order(sort)).offset(offset).limit(limit)


def behind(sort: str, last: dict, at: str = "") -> Column:
    """Whether a row, or the struct ``at``, comes after the row ``last`` (a value for each column of the order)."""
    found, equal = F.lit(False), F.lit(True)
    for name, up in SORTS[sort]:
        column, value = F.col(f"{at}.{name}" if at else name), last[name]
        if value is not None:  # nulls come last
            past = column > value if up else column < value
            found = found | (equal & (past | column.isNull()))
        equal = equal & column.eqNullSafe(F.lit(value))
    return found


def page_after(rows: DataFrame, sort: str, last: dict, limit: int) -> DataFrame:
    """The page behind the row ``last``, whatever was added meanwhile.

    Unlike an offset this reads no row before it, and never shows a row twice.
    """
    return rows.filter(behind(sort, last)).orderBy(*order(sort)).limit(limit)


def cluster(rows: DataFrame, sort: str, folder: str, rows_per_file: int = 100_000) -> None:
    """Write a listing in its order, a range a file, and a table of the files: path, number of rows, and the last row's sort values."""
    files = max(1, -(-rows.count() // rows_per_file))
    ordered = rows.repartitionByRange(files, *order(sort)).sortWithinPartitions(*order(sort))
    ordered.write.parquet(f"{folder}/rows")
    written = rows.sparkSession.read.parquet(f"{folder}/rows")
    last = F.max_by(F.struct(*(c for c, _ in SORTS[sort])), F.col("_metadata.row_index"))
    about = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    about.write.parquet(f"{folder}/files")


def clustered_page(spark: SparkSession, folder: str, sort: str, last: dict | None, limit: int) -> DataFrame:
    """:func:`page_after` (or the first page) of a listing of :func:`cluster`; only the files that the page lies in are opened.

    The first is that whose last row comes after ``last``, and the next ones follow until they hold enough rows:
    two in all, where files hold at least a page.
    """
    about = spark.read.parquet(f"{folder}/files")
    if last is not None:
        about = about.filter(behind(sort, last, "last"))
    wanted, held = [], 0
    for row in about.orderBy("file").select("file", "n").limit(limit + 1).collect():  # every file has a row at least
        wanted.append(row["file"])
        held += row["n"] if last is None or len(wanted) > 1 else 1
        if held >= limit:
            break
    if not wanted:
        return spark.read.parquet(f"{folder}/rows").limit(0)
    rows = spark.read.parquet(*wanted)
    return rows.orderBy(*order(sort)).limit(limit) if last is None else page_after(rows, sort, last, limit)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def totals(rows: DataFrame, filters: dict[str, Filter], members: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(filter, total): the number of ``rows`` (a listing without filters) under each of ``filters``, in one pass.

    What the group filters ask is worked out once for each file that is in a group.
    """
    if members is not None and groups is not None:
        joined = members.select("group_id", "instance_id").join(groups.select("group_id", "kind", "status"), "group_id")
        of = joined.groupBy("instance_id").agg(
            F.lit(True).alias("_in"), F.bool_or(F.col("status") == "pending").alias("_pending"),
            F.collect_set(F.when(F.col("status") == "pending", F.col("kind"))).alias("_kinds"),  # of a few kinds
        )
        rows = rows.join(of, "instance_id", "left")
    named = {"in_group": "_in", "pending_group": "_pending"}

    def condition(wanted: Filter) -> Column:
        found = list(wanted.conditions())
        if wanted.group == "not_in_group":
            found.append(F.col("_in").isNull())
        elif wanted.group in named:
            found.append(F.col(named[wanted.group]))
        elif wanted.group is not None:
            found.append(F.array_contains("_kinds", wanted.group))
        return reduce(and_, found, F.lit(True))

    numbers = rows.agg(*(F.count_if(condition(wanted)).alias(f"n{i}") for i, wanted in enumerate(filters.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("filter"), F.col(f"n{i}").alias("total")) for i, name in enumerate(filters)))
    return numbers.select(F.explode(pairs).alias("r")).select("r.*")
