"""Incremental ingest: an observed manifest against the known state.

State tables are DataFrames in and out.  A manifest row is a file seen now: path, path_key, size,
modified_ms, volume_id, file_id, extension, file_class, sha256 and quick_fingerprint where known.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from darkroom.functions import paths
from darkroom.operators.order import placed
from darkroom.schema import ANALYSIS_VERSION
from darkroom.sources.scratch import materialize, owned


def prepare_roots(roots: list[str]) -> list[str]:
    """Trimmed roots, without blanks, backslashes and repeats (by key), in order."""
    out: dict[str, str] = {}
    for root in roots:
        clean = root.strip().replace("\\", "/")
        key = clean.lower().rstrip("/") + "/"
        if clean and key not in out:
            out[key] = clean
    return list(out.values())


def checked_roots(roots: list[str]) -> list[str]:
    """Prepared roots in their canonical form; raises ValueError for none, and for those that are no folders."""
    out = []
    for root in prepare_roots(roots):
        if not os.path.exists(root):
            raise ValueError(f"folder does not exist: {root}")
        if not os.path.isdir(root):
            raise ValueError(f"not a folder: {root}")
        out.append(os.path.realpath(root))
    if not out:
        raise ValueError("no folder to scan")
    return prepare_roots(out)


def classified(manifest: DataFrame) -> DataFrame:
    """Manifest with path_key, extension and file_class."""
    out = manifest.withColumn("path_key", paths.path_key(F.col("path"))).withColumn("extension", paths.extension(F.col("path")))
    return out.withColumn("file_class", paths.file_class(F.col("extension")))


def route(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media to prepare, sidecars, and files that are only counted."""
    kind = F.col("file_class")
    return (
        manifest.filter(kind.isin("image", "raw_image", "video")),
        manifest.filter(kind == "sidecar"),
        manifest.filter(kind.isin("archive", "other")),
    )


def unknown_formats(counted: DataFrame) -> DataFrame:
    """extension, n, example_path (the least path), most frequent first."""
    found = counted.groupBy("extension").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example_path"))
    return found.orderBy(F.desc("n"), "extension")


def same_identity(volume: Column, file: Column, seen_volume: Column, seen_file: Column) -> Column:
    """Unknown identities match anything."""
    known = seen_volume.isNotNull() & seen_file.isNotNull() & volume.isNotNull() & file.isNotNull()
    return ~known | ((volume == seen_volume) & (file == seen_file))


def with_state(observed: DataFrame, instances: DataFrame, assets: DataFrame) -> DataFrame:
    """Observed files left-joined with the instance of the same path_key and its asset."""
    known = instances.select(
        "path_key",
        F.col("id").alias("instance_id"),
        F.col("content_asset_id").alias("known_asset_id"),
        F.col("file_size").alias("known_size"),
        F.col("modified_ms").alias("known_ms"),
        F.col("volume_id").alias("known_volume"),
        F.col("file_id").alias("known_file"),
        F.col("exists_flag").alias("known_exists"),
    )
    versions = assets.select(
        F.col("id").alias("known_asset_id"),
        F.col("analysis_version").alias("known_version"),
        F.col("sha256").alias("known_sha256"),
    )
    return observed.join(known, "path_key", "left").join(versions, "known_asset_id", "left")


def unchanged(version: int = ANALYSIS_VERSION) -> Column:
    """Predicate over :func:`with_state`: nothing about the file needs a new look."""
    return F.coalesce(
        F.col("instance_id").isNotNull()
        & (F.col("size") == F.col("known_size"))
        & (F.col("modified_ms") == F.col("known_ms"))
        & F.col("known_exists")
        & same_identity(F.col("known_volume"), F.col("known_file"), F.col("volume_id"), F.col("file_id"))
        & (F.col("known_version") == version),
        F.lit(False),
    )


def same_volume_moves(changed: DataFrame, instances: DataFrame) -> DataFrame:
    """(instance_id, old_path, path, path_key): files whose identity is known under another path.

    Where several known instances have the identity, the least id counts.
    """
    known = instances.select(
        F.col("id").alias("instance_id"), F.col("current_path").alias("old_path"), F.col("path_key").alias("old_key"), "volume_id", "file_id"
    )
    found = changed.drop("instance_id").join(known, ["volume_id", "file_id"]).filter(F.col("old_key") != F.col("path_key"))
    least = found.groupBy("path_key", "path").agg(F.min_by(F.struct("instance_id", "old_path"), "instance_id").alias("k"))
    return least.select("k.instance_id", "k.old_path", "path", "path_key")


def known_content(pending: DataFrame, assets: DataFrame, version: int = ANALYSIS_VERSION) -> tuple[DataFrame, DataFrame]:
    """Pending files whose quick fingerprint and then full hash name a current asset; and the others.

    The full hash is only compared after size and fingerprint agree.
    """
    current = assets.filter(F.col("analysis_version") == version).select(
        F.col("id").alias("asset_id"), F.col("file_size").alias("size"), "quick_fingerprint", F.col("sha256").alias("asset_sha")
    )
    hits = pending.join(current, ["size", "quick_fingerprint"]).filter(F.col("sha256") == F.col("asset_sha")).drop("asset_sha")
    return hits, pending.join(hits.select("path_key"), "path_key", "left_anti")


def resolve_assets(misses: DataFrame, assets: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """Each file's asset: reuse, refresh (known hash, old analysis) or create, with its asset_id.

    New ids follow the greatest known one in the order of the hash.
    """
    known = assets.select(F.col("id").alias("asset_id"), "sha256", F.col("analysis_version").alias("v"))
    joined = misses.join(known, "sha256", "left")
    action = F.when(F.col("asset_id").isNull(), "create").when(F.col("v") == version, "reuse").otherwise("refresh")
    joined = joined.withColumn("asset_action", action).drop("v")
    new = numbered(joined.filter("asset_action = 'create'").select("sha256").distinct(), "sha256", assets, "id", "new_id")
    return joined.join(new, "sha256", "left").withColumn("asset_id", F.coalesce("asset_id", "new_id")).drop("new_id")


def numbered(rows: DataFrame, key: str, known: DataFrame, id_: str, name: str) -> DataFrame:
    """``rows`` with ids above the greatest of ``known``, in the order of ``key``.

    Numbers are dealt per range partition from its offset, so the rows are never gathered in one task.
    """
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    joined = placed(rows, [], [F.col(key)], "_at").crossJoin(F.broadcast(top))  # one row
    return joined.withColumn(name, (F.col("_top") + F.col("_at") + 1).cast("long")).drop("_at", "_top")


def cross_volume_moves(resolved: DataFrame, instances: DataFrame, observed_keys: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(path_key, instance_id, old_path): new paths of assets with exactly one instance gone from disk.

    The instances of ``moved`` (instance_id) are found elsewhere and so not gone.
    """
    gone = instances.join(observed_keys.select("path_key"), "path_key", "left_anti")
    if moved is not None:
        gone = gone.join(moved.select(F.col("instance_id").alias("id")), "id", "left_anti")
    single = (
        gone.groupBy("content_asset_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("instance_id"), F.min("current_path").alias("old_path"))
        .filter("n = 1")
        .select(F.col("content_asset_id").alias("asset_id"), "instance_id", "old_path")
    )
    fresh = resolved.drop("instance_id").join(instances.select("path_key"), "path_key", "left_anti").join(single, "asset_id")
    one = fresh.groupBy("instance_id").agg(F.min_by(F.struct("path_key", "old_path"), "path_key").alias("k"))
    return one.select("k.path_key", "instance_id", "k.old_path")


def disposition() -> Column:
    """Of an instance commit, by precedence: known path, then move, else new.

    A known path whose content changed is reported as updated.
    """
    known = F.col("instance_id").isNotNull()
    return (
        F.when(F.col("is_unchanged"), "unchanged")
        .when(known & (F.col("asset_id") == F.col("known_asset_id")), "unchanged")
        .when(known, "updated")
        .when(F.col("moved"), "updated")
        .otherwise("new")
    )


#: Fixed values.
DISPOSITIONS = ("new", "updated", "unchanged")


def run_counters(committed: DataFrame) -> DataFrame:
    """One row: new_count, updated_count, unchanged_count."""
    return committed.agg(
        *(F.count_if(F.col("disposition") == d).alias(f"{d}_count") for d in DISPOSITIONS)
    )


def mark_missing(instances: DataFrame, observed_keys: DataFrame, roots: list[str]) -> DataFrame:
    """Live instances below a scanned root that were not observed get exists_flag false."""
    below = F.lit(False)
    for root in roots:
        below = below | F.col("path_key").startswith(root.replace("\\", "/").strip().lower().rstrip("/") + "/")
    seen = observed_keys.select("path_key", F.lit(True).alias("_seen")).distinct()
    joined = instances.join(seen, "path_key", "left")
    missing = F.col("exists_flag") & below & F.col("_seen").isNull()
    return joined.withColumn("exists_flag", F.when(missing, F.lit(False)).otherwise(F.col("exists_flag"))).drop("_seen")


def newly_missing(instances: DataFrame, observed_keys: DataFrame, roots: list[str]) -> DataFrame:
    """The rows that :func:`mark_missing` changes, with exists_flag false."""
    live = instances.filter("exists_flag")
    return mark_missing(live, observed_keys, roots).filter("NOT exists_flag")


def fitted(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``, null where missing."""
    have = set(rows.columns)
    return rows.select(
        *(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema)
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key it has not."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` and those of ``new`` whose key it has not."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def resume_candidate(runs: DataFrame, queue: DataFrame) -> DataFrame:
    """The newest running run with a discovered file in its queue; no row if there is none."""
    waiting = queue.filter("stage = 'discovered'").select(F.col("scan_run_id").alias("id")).distinct()
    return runs.filter("status = 'running'").join(waiting, "id", "left_semi").orderBy(F.desc("id")).limit(1)


def promote(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Queue rows of the done keys, failed files included, become promoted."""
    keys = done.select("scan_run_id", "path_key", F.lit(True).alias("_done")).distinct()
    joined = queue.join(keys, ["scan_run_id", "path_key"], "left")
    return joined.withColumn("stage", F.when(F.col("_done"), "promoted").otherwise(F.col("stage"))).drop("_done")


def job_group(run_id: int) -> str:
    return f"scan-{run_id}"


@contextmanager
def grouped(spark: SparkSession, run_id: int) -> Iterator[None]:
    """Jobs of this thread under the group of a run, and after that under what they were before."""
    context = spark.sparkContext
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = {name: context.getLocalProperty(name) for name in names}
    context.setJobGroup(job_group(run_id), f"scan {run_id}", True)
    try:
        yield
    finally:
        for name, value in before.items():
            context.setLocalProperty(name, value)


def cancel(spark, run_id: int, runs: DataFrame) -> DataFrame:
    """Stop the run's jobs, which :func:`scan` runs under its group, and mark it cancelled, so that it is not resumed."""
    spark.sparkContext.cancelJobGroup(job_group(run_id))
    return runs.withColumn("status", F.when(F.col("id") == run_id, "cancelled").otherwise(F.col("status")))


def enqueue(observed: DataFrame, run_id: int) -> DataFrame:
    """Queue rows of the files that a run found: scan_run_id, path_key, path, stage, chunk."""
    rows = observed.select(F.lit(run_id).cast("long").alias("scan_run_id"), "path_key", "path", F.lit("discovered").alias("stage"))
    return rows.withColumn("chunk", F.lit(0).cast("long"))


def resume(observed: DataFrame, instances: DataFrame, assets: DataFrame, runs: DataFrame, queue: DataFrame, now: Column):
    """Go on with the newest run that has files left: (run id, tables as of :func:`scan`, runs, queue).

    Of ``observed`` only files that the run found and has not done are taken, whatever was asked for
    since; known content is not looked up by fingerprint and nothing is marked missing.  The run ends
    as completed.  Without such a run: (None, {}, runs, queue).
    """
    found = resume_candidate(runs, queue).select("id").collect()  # one row at most
    if not found:
        return None, {}, runs, queue
    run_id = found[0]["id"]
    waiting = queue.filter((F.col("scan_run_id") == run_id) & (F.col("stage") == "discovered"))
    todo = classified(observed).join(waiting.select("path_key").distinct(), "path_key", "left_semi")
    out = scan(todo, instances, assets, [], run_id, now, known=False)
    done = F.col("id") == run_id
    runs = runs.withColumn("status", F.when(done, "completed").otherwise(F.col("status")))
    runs = runs.withColumn("finished_at", F.when(done, now).otherwise(F.col("finished_at")))
    return run_id, out, runs, promote(queue, waiting)


@owned
def scan(
    observed: DataFrame,
    instances: DataFrame,
    assets: DataFrame,
    roots: list[str],
    run_id: int,
    now: Column,
    known: bool = True,
    seen: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One scan: the next instances and assets, the move log and a disposition per file.

    ``changed_instances`` and ``changed_assets`` are the rows of these that differ from before.  Where
    ``observed`` is a part of what the run found, ``seen`` has the path_key of all of it.  ``counts``
    (of the rows' dispositions) are observed as ``files`` is written.

    ``observed`` has path, size, modified_ms, volume_id, file_id, quick_fingerprint and sha256.
    Precedence is unchanged, same-volume move, known content, cross-volume move, new.  With ``known``,
    changed files whose fingerprint and hash name a current asset take it at once; the others are
    resolved by hash.  A changed file without a hash could not be read: it is listed with its ``error``,
    counts as seen, and changes nothing.  Jobs run under the run's group, see :func:`cancel`.
    """
    with grouped(observed.sparkSession, run_id):
        return _scanned(observed, instances, assets, roots, run_id, now, known, seen)


def _scanned(
    observed: DataFrame, instances: DataFrame, assets: DataFrame, roots: list[str], run_id: int, now: Column, known: bool, seen: DataFrame | None
) -> dict[str, DataFrame]:
    media, sidecars, counted = route(classified(observed))
    # Each step is written once, as the later ones read it several times.
    state = materialize(with_state(media, instances, assets).withColumn("is_unchanged", unchanged()))
    same = state.filter("is_unchanged").withColumn("asset_id", F.col("known_asset_id"))
    changed = state.filter(~F.col("is_unchanged") & F.col("sha256").isNotNull())
    failed = state.filter(~F.col("is_unchanged") & F.col("sha256").isNull())
    moves = same_volume_moves(changed.filter("instance_id IS NULL"), instances).withColumn("change_type", F.lit("same_volume_move"))
    if known:
        hits, misses = known_content(changed, assets)
        hits = hits.withColumn("asset_action", F.lit("reuse"))
        resolved = hits.unionByName(resolve_assets(misses, assets).select(*hits.columns))
    else:
        resolved = resolve_assets(changed, assets)
    resolved = materialize(resolved)
    rest = resolved.join(moves.select("path_key"), "path_key", "left_anti")
    all_keys = media if seen is None else seen
    far = cross_volume_moves(rest, instances, all_keys, moves).withColumn("change_type", F.lit("cross_volume_move"))
    log = materialize(moves.select("path_key", "instance_id", "old_path", "change_type").unionByName(far))
    moved = log.select("path_key", F.col("instance_id").alias("moved_id"), "change_type")
    columns = ["path_key", "path", "size", "modified_ms", "volume_id", "file_id", "extension", "file_class", "sha256",
               "quick_fingerprint", "instance_id", "known_asset_id", "asset_id", "is_unchanged"]
    files = same.select(*columns).unionByName(resolved.select(*columns)).join(moved, "path_key", "left")
    files = files.withColumn("moved", F.col("moved_id").isNotNull()).withColumn("disposition", disposition())
    files = files.withColumn("instance_id", F.coalesce("instance_id", "moved_id"))
    new_ids = numbered(files.filter("instance_id IS NULL").select("path_key"), "path_key", instances, "id", "new_id")
    files = files.join(new_ids, "path_key", "left").withColumn("instance_id", F.coalesce("instance_id", "new_id"))
    counted_as = Observation()
    files = materialize(files.observe(counted_as, *(F.count_if(F.col("disposition") == d).alias(f"{d}_count") for d in DISPOSITIONS)))
    counts = counted_as.get
    written = files.select(
        F.col("instance_id").alias("id"), F.col("asset_id").alias("content_asset_id"), F.col("path").alias("current_path"), "path_key",
        "volume_id", "file_id", F.col("size").alias("file_size"), "modified_ms", "extension", "file_class",
        now.alias("last_seen_at"), F.lit(run_id).cast("long").alias("last_scan_run_id"), F.lit(True).alias("exists_flag"),
    )
    first_seen = instances.select("id", "first_seen_at")
    written = written.join(first_seen, "id", "left").withColumn("first_seen_at", F.coalesce("first_seen_at", "last_seen_at"))
    written = materialize(fitted(written, instances))
    missing = newly_missing(instances.join(written.select("id"), "id", "left_anti"), all_keys, roots) if roots else None
    changed_instances = written if missing is None else written.unionByName(missing.select(*written.columns))
    next_instances = upsert(instances, changed_instances, ["id"])
    fresh = resolved.filter("asset_action != 'reuse'").dropDuplicates(["sha256"])
    rows = fresh.select(
        F.col("asset_id").alias("id"), "sha256", F.col("size").alias("file_size"), "quick_fingerprint", "extension",
        paths.file_class(F.col("extension")).alias("media_type"), paths.format_name(F.col("extension")).alias("format_name"),
        paths.can_decode(F.col("extension")).alias("preview_supported"), F.lit(ANALYSIS_VERSION).alias("analysis_version"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    changed_assets = materialize(fitted(rows, assets))
    return {
        "file_instances": next_instances,
        "content_assets": upsert(assets, changed_assets, ["id"]),
        "changed_instances": changed_instances,
        "changed_assets": changed_assets,
        "counts": counts,
        "path_history": log.join(files.select("path_key", F.col("path").alias("new_path")), "path_key").select(
            F.col("instance_id").alias("file_instance_id"), "old_path", "new_path", "change_type", now.alias("detected_at")
        ),
        "files": files.select("path_key", "instance_id", "asset_id", "disposition", "change_type"),
        "sidecar_files": sidecars.select(F.lit(run_id).cast("long").alias("scan_run_id"), "path_key", "path", "extension"),
        "unknown_formats": unknown_formats(counted),
        "failed_files": failed.select(
            F.lit(run_id).cast("long").alias("scan_run_id"), "path_key", "path", F.col("error") if "error" in failed.columns else F.lit(None).cast("string").alias("error")
        ),
    }
