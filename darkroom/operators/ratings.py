"""Star ratings as an append-only log of events (file_instance_id, rating, note, event_id, at).

A null rating is the absence of one.  The current rating is the last event; undo appends the state
before the last event, so nothing is ever overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.operators.review import prune


def set_rating(events: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` and ``new``; ratings outside 0 to 5 raise an error when the rows are read."""
    good = F.col("rating").between(0, 5)
    checked = new.withColumn("rating", F.when(good, F.col("rating")).otherwise(F.raise_error(F.lit("rating must be 0 to 5")).cast("int")))
    return events.unionByName(checked)


def current(events: DataFrame) -> DataFrame:
    """Latest rating per file; files whose last event removed it have none."""
    last = events.groupBy("file_instance_id").agg(F.max_by(F.struct("rating", "note", "at"), "event_id").alias("e"))
    return last.select("file_instance_id", "e.rating", "e.note", F.col("e.at").alias("updated_at")).filter("rating IS NOT NULL")


def undo(events: DataFrame, now) -> DataFrame:
    """Events with the last one compensated: the rating before it, without its note; null if none."""
    last = events.orderBy(F.desc("event_id")).limit(1).select("file_instance_id", F.col("event_id").alias("_last"))
    of_file = events.join(F.broadcast(last), "file_instance_id")  # one row
    before = of_file.filter(F.col("event_id") < F.col("_last")).agg(F.max_by("rating", "event_id").alias("rating"))
    back = last.crossJoin(before).select(
        "file_instance_id", "rating", F.lit(None).cast("string").alias("note"), (F.col("_last") + 1).alias("event_id"), now.alias("at")
    )
    return events.unionByName(back)


def latest_per_asset(ratings: DataFrame, instances: DataFrame) -> DataFrame:
    """asset_id, rating: the newest rating among an asset's files, by event then file."""
    joined = ratings.join(instances.select("instance_id", "asset_id"), "instance_id")
    return joined.groupBy("asset_id").agg(F.max_by("rating", F.struct("event_id", "instance_id")).alias("rating"))


def best_per_asset(ratings: DataFrame, instances: DataFrame) -> DataFrame:
    """asset_id, rating: the greatest rating among an asset's files."""
    joined = ratings.join(instances.select("instance_id", "asset_id"), "instance_id")
    return joined.groupBy("asset_id").agg(F.max("rating").alias("rating")).filter("rating IS NOT NULL")


def list_rated(instances: DataFrame, ratings: DataFrame, unrated_only: bool = False, min_rating: int | None = None) -> DataFrame:
    """Files with their rating, by id."""
    joined = instances.join(ratings.select("instance_id", "rating"), "instance_id", "left")
    if unrated_only:
        joined = joined.filter("rating IS NULL")
    if min_rating is not None:
        joined = joined.filter(F.col("rating") >= min_rating)
    return joined.orderBy("instance_id")


def page(rows: DataFrame, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page of ordered rows, and their total as one row."""
    return rows.offset(offset).limit(limit), rows.agg(F.count(F.lit(1)).alias("total"))


def recycle_rated(state: dict[str, DataFrame], instance_id: int, now) -> dict[str, DataFrame]:
    """State without a live image, which gets the rating 0: instances, rating_events, match_groups, group_members.

    The file is no longer a member of any group, and groups left with one member go.  ``recycle_plan``
    has the file to move away.  Raises ValueError if there is no such live image.
    """
    instances, events = state["file_instances"], state["rating_events"]
    this = (F.col("id") == instance_id) & F.col("exists_flag") & (F.col("file_class") == "image")
    plan = instances.filter(this).select("id", "current_path")
    if plan.isEmpty():
        raise ValueError("photo not found or already removed")
    event = events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("top")).select(
        F.lit(instance_id).cast("long").alias("file_instance_id"), F.lit(0).alias("rating"), F.lit(None).cast("string").alias("note"),
        (F.col("top") + 1).alias("event_id"), now.alias("at"),
    )
    gone = instances.withColumn("last_seen_at", F.when(this, now).otherwise(F.col("last_seen_at")))
    gone = gone.withColumn("exists_flag", F.when(this, F.lit(False)).otherwise(F.col("exists_flag")))
    groups, members = prune(state["match_groups"], state["group_members"], gone, state["content_assets"])
    return state | {
        "file_instances": gone, "rating_events": events.unionByName(event), "match_groups": groups, "group_members": members, "recycle_plan": plan,
    }
