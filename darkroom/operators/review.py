"""Review of groups: listing, decisions, pruning and the action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.operators.ingest import numbered
from darkroom.sources.scratch import materialize, owned


def list_groups(
    groups: DataFrame, members: DataFrame, kind: str | None = None, status: str | None = None, instances: DataFrame | None = None
) -> DataFrame:
    """Group headers with their number of members, newest first; absent filters filter nothing.

    With ``instances`` (id, current_path) also recommended_path, that of the recommended file, null if there is none.
    """
    if kind is not None:
        groups = groups.filter(F.col("kind") == kind)
    if status is not None:
        groups = groups.filter(F.col("status") == status)
    counts = members.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("n_members"))
    out = groups.join(counts, "id")
    if instances is not None:
        files = instances.select(F.col("id").alias("recommended_keep_instance_id"), F.col("current_path").alias("recommended_path"))
        out = out.join(files, "recommended_keep_instance_id", "left")
    return out.orderBy(F.desc("updated_at"), F.desc("id"))


def group_detail(group_id: int, members: DataFrame, instances: DataFrame, assets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Members of one group with file, asset and rating, best first."""
    found = members.filter(F.col("group_id") == group_id)
    found = found.join(instances.select(F.col("id").alias("file_instance_id"), "current_path", "exists_flag"), "file_instance_id")
    found = found.join(assets.select(F.col("id").alias("content_asset_id"), "quality_score", "width", "height"), "content_asset_id")
    return found.join(ratings.select("file_instance_id", "rating"), "file_instance_id", "left").orderBy(
        F.coalesce("quality_score", F.lit(0.0)).desc(), "current_path"
    )


def decision_error(keep: Column, recycle: Column, members: Column) -> Column:
    """The first rule that a decision breaks, null for a valid one.

    ``members`` are the group's live instance ids, null if there is no such group.
    """
    both = F.concat(keep, recycle)
    return (
        F.when(members.isNull(), "group not found")
        .when(F.size(F.array_distinct(keep)) < F.size(keep), "duplicate keep id")
        .when(F.size(F.array_distinct(recycle)) < F.size(recycle), "duplicate recycle id")
        .when(F.size(keep) == 0, "at least one file must be kept")
        .when(F.size(recycle) == 0, "at least one file must be recycled")
        .when(F.arrays_overlap(keep, recycle), "a file is both kept and recycled")
        .when(F.size(F.array_except(both, members)) > 0, "a file is not in the group")
        .when(F.size(F.array_except(members, both)) > 0, "every file needs a decision")
    )


def apply_decision(
    state: dict[str, DataFrame], group_id: int, keep: list[int], recycle: list[int], note: str | None, action_id: int, now: Column
) -> dict[str, DataFrame]:
    """State after a valid decision, with the files to move away as ``recycle_plan``; raises ValueError otherwise."""
    instances, groups, members = state["file_instances"], state["match_groups"], state["group_members"]
    spark = instances.sparkSession
    live = members.filter(F.col("group_id") == group_id).join(
        instances.filter("exists_flag").select(F.col("id").alias("file_instance_id")), "file_instance_id", "left_semi"
    )
    ids = sorted(r[0] for r in live.select("file_instance_id").collect())  # one group's members
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    error = decision_error(array(keep), array(recycle), array(ids) if ids else F.lit(None).cast("array<bigint>"))
    message = spark.range(1).select(error.alias("e")).first()["e"]
    if message:
        raise ValueError(message)
    gone = F.col("id").isin(recycle)
    next_instances = instances.withColumn("exists_flag", F.when(gone, F.lit(False)).otherwise(F.col("exists_flag")))
    this = F.col("id") == group_id
    next_groups = groups.withColumn("status", F.when(this, "applied").otherwise(F.col("status")))
    next_groups = next_groups.withColumn("updated_at", F.when(this, now).otherwise(F.col("updated_at")))
    action = groups.filter(this).select(
        F.lit(action_id).cast("long").alias("id"), F.col("id").alias("group_id"), F.col("kind").alias("group_kind"),
        F.lit("apply").alias("action_type"), array(keep).alias("keep_ids"), array(recycle).alias("recycle_ids"),
        F.lit(note).cast("string").alias("note"), now.alias("created_at"),
    )
    pruned_groups, pruned_members = prune(next_groups, members, next_instances, state["content_assets"])
    return state | {
        "file_instances": next_instances,
        "match_groups": pruned_groups,
        "group_members": pruned_members,
        "review_actions": state["review_actions"].unionByName(action),
        "recycle_plan": instances.filter(gone).select("id", "current_path"),
    }


@owned
def apply_decisions(state: dict[str, DataFrame], decisions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """State after many decisions (seq, group_id, keep_ids, recycle_ids, note), as if they were applied one by one by ``seq``.

    A decision is judged by the files of its group that are live when all earlier ones have been
    applied or rejected.  Those that touch no earlier open decision (none on the same group, none
    that recycles a file of it or has a file that this one recycles) are judged together, in one
    plan; the others wait for the next round.  ``outcomes`` has seq, group_id and the error that a decision was rejected for, null for accepted
    ones; a group with fewer than two live files counts as not found.  Actions are numbered
    on from the greatest id in order of ``seq``; seq is unique.
    """
    instances, groups, members = state["file_instances"], state["match_groups"], state["group_members"]
    decisions = materialize(decisions.select(F.col("seq").cast("long").alias("seq"), "group_id", "keep_ids", "recycle_ids", "note"))
    alive = instances.filter("exists_flag").select(F.col("id").alias("file_instance_id"))
    of_groups = members.join(decisions.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "file_instance_id")
    live = materialize(of_groups.join(alive, "file_instance_id", "left_semi").distinct())
    todo, outcomes, gone = decisions, None, None
    while not todo.isEmpty():
        by_file = todo.select("seq", F.explode("recycle_ids").alias("file_instance_id")).groupBy("file_instance_id").agg(F.min("seq").alias("first"))
        touched = live.join(by_file, "file_instance_id").groupBy("group_id").agg(F.min("first").alias("touched"))
        same = todo.groupBy("group_id").agg(F.min("seq").alias("same"))
        open_files = live.join(same, "group_id").groupBy("file_instance_id").agg(F.min("same").alias("asked"))
        needed = todo.select("seq", F.explode("recycle_ids").alias("file_instance_id")).join(open_files, "file_instance_id")
        needed = needed.groupBy("seq").agg(F.min("asked").alias("asked"))
        ids = live.groupBy("group_id").agg(F.collect_list("file_instance_id").alias("live_ids"))  # as many as a valid decision names
        judged = todo.join(same, "group_id").join(touched, "group_id", "left").join(needed, "seq", "left").join(ids, "group_id", "left")
        first = F.least("same", F.coalesce("touched", "seq"), F.coalesce("asked", "seq"))
        ready = first >= F.col("seq")
        found = F.when(F.size("live_ids") >= 2, F.col("live_ids"))
        error = decision_error(F.col("keep_ids"), F.col("recycle_ids"), found)
        done = materialize(judged.filter(ready).withColumn("error", error).select(*decisions.columns, "error"))
        accepted = done.filter("error IS NULL").select(F.explode("recycle_ids").alias("file_instance_id"))
        outcomes = done if outcomes is None else materialize(outcomes.unionByName(done))
        gone = materialize(accepted if gone is None else gone.unionAll(accepted))
        live = materialize(live.join(accepted, "file_instance_id", "left_anti"))
        todo = materialize(todo.join(done.select("seq"), "seq", "left_anti"))
    empty = decisions.filter("false").withColumn("error", F.lit(None).cast("string"))
    outcomes = empty if outcomes is None else outcomes
    accepted = outcomes.filter("error IS NULL")
    out = state | {"outcomes": outcomes.select("seq", "group_id", "error"), "recycle_plan": instances.filter("false").select("id", "current_path")}
    if accepted.isEmpty():
        return out
    dead = gone.select(F.col("file_instance_id").alias("id"), F.lit(True).alias("_gone")).distinct()
    next_instances = instances.join(dead, "id", "left").withColumn("exists_flag", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("exists_flag")))
    applied = accepted.select(F.col("group_id").alias("id"), F.lit(True).alias("_applied")).distinct()
    next_groups = groups.join(applied, "id", "left").withColumns(
        {"status": F.when(F.col("_applied"), "applied").otherwise(F.col("status")), "updated_at": F.when(F.col("_applied"), now).otherwise(F.col("updated_at"))}
    )
    named = accepted.join(groups.select(F.col("id").alias("group_id"), F.col("kind").alias("group_kind")), "group_id")
    numbered_ = numbered(named, "seq", state["review_actions"], "id", "id")
    actions = numbered_.withColumns({"action_type": F.lit("apply"), "created_at": now}).select(*state["review_actions"].columns)
    next_instances = next_instances.select(*instances.columns)
    kept, held = prune(next_groups.select(*groups.columns), members, next_instances, state["content_assets"])
    return out | {
        "file_instances": next_instances,
        "match_groups": kept,
        "group_members": held,
        "review_actions": state["review_actions"].unionByName(actions),
        "recycle_plan": instances.join(dead, "id", "left_semi").select("id", "current_path"),
    }


def prune(groups: DataFrame, members: DataFrame, instances: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members without dead files.

    Dead members go from all groups; groups that are not applied and have fewer than two members go;
    the recommendation moves to the live member of the best quality, then the least path.
    """
    alive = instances.filter("exists_flag").select(
        F.col("id").alias("file_instance_id"), "current_path", F.col("content_asset_id").alias("_asset")
    )
    live = members.join(alive, "file_instance_id").join(assets.select(F.col("id").alias("_asset"), "quality_score"), "_asset", "left")
    place = F.struct(-F.coalesce("quality_score", F.lit(0.0)), "current_path", "file_instance_id")
    of_group = live.groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("_size"), F.min_by("file_instance_id", place).alias("_best"))
    kept = groups.join(of_group, "id", "left").filter((F.col("status") == "applied") | (F.coalesce("_size", F.lit(0)) >= 2))
    kept = kept.withColumn("recommended_keep_instance_id", F.coalesce("_best", "recommended_keep_instance_id"))
    next_members = live.join(kept.select(F.col("id").alias("group_id")), "group_id", "left_semi").select(*members.columns)
    return kept.select(*groups.columns), next_members


def default_recycle(members: DataFrame) -> DataFrame:
    """Members recycled unless the user decides otherwise: all but the recommended one; none of raw pairs."""
    return members.filter((F.col("kind") != "raw_jpeg_set") & (F.col("role") != "recommended_keep"))


def list_actions(actions: DataFrame) -> DataFrame:
    return actions.orderBy(F.desc("created_at"), F.desc("id"))


def lookup_history(history: DataFrame, instances: DataFrame, asset_id: int) -> DataFrame:
    """Moves of an asset's files, newest first."""
    of_asset = instances.filter(F.col("content_asset_id") == asset_id).select(F.col("id").alias("file_instance_id"))
    return history.join(of_asset, "file_instance_id", "left_semi").orderBy(F.desc("detected_at"), "file_instance_id")
