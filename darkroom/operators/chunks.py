"""Scans that are committed chunk by chunk, and go on where they were interrupted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.operators.ingest import DISPOSITIONS, classified, enqueue, newly_missing, resume_candidate, scan
from darkroom.operators.order import placed
from darkroom.schema import schema
from darkroom.sources.scratch import materialize, owned, release
from darkroom.sources.store import Commit, Conflict, Store

#: Files of a chunk.
CHUNK_FILES = 100_000


def run_changes(out: dict, run_id: int, roots: list[str], now: Column, status: str, counts: dict[str, int]) -> dict[str, DataFrame]:
    """Rows that a scan's result changes in a store, the run's own row with them."""
    spark = out["changed_instances"].sparkSession
    return {
        "file_instances": out["changed_instances"],
        "content_assets": out["changed_assets"],
        "path_history": out["path_history"],
        "sidecar_files": out["sidecar_files"],
        "failed_files": out["failed_files"],
        "scan_runs": run_row(spark, run_id, roots, now, status, counts),
    }


def run_row(spark, run_id: int, roots: list[str], now: Column, status: str, counts: dict[str, int], started: Column | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).cast("long").alias("id"), F.array(*(F.lit(r) for r in roots)).cast("array<string>").alias("roots"), F.lit(status).alias("status"),
        (now if started is None else started).alias("started_at"),
        (now if status != "running" else F.lit(None)).cast("timestamp").alias("finished_at"),
        *(F.lit(counts.get(f"{d}_count", 0)).cast("long").alias(f"{d}_count") for d in DISPOSITIONS),
    )


@owned
def begin(store: Store, observed: DataFrame, roots: list[str], now: Column, chunk_files: int = CHUNK_FILES) -> int:
    """Commit a new run and its queue: the files of ``observed`` in chunks, by path.  Returns the run's id."""
    seen = store.latest()
    top = store.read("scan_runs", seen).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    run_id = int(top) + 1
    keys = classified(observed).select("path_key", "path").dropDuplicates(["path_key"])
    queue = placed(enqueue(keys, run_id).drop("chunk"), [], [F.col("path_key")], "place")
    queue = queue.withColumn("chunk", F.floor(F.col("place") / chunk_files).cast("long")).drop("place")
    store.commit(changes={"scan_queue": queue, "scan_runs": run_row(store.spark, run_id, roots, now, "running", {})}, seen=seen)
    return run_id


def cancel_run(store: Store, run_id: int, tries: int = 20) -> None:
    """Mark a run as cancelled; whoever works on it stops before its next chunk.

    Another writer's commit in between is no reason to fail: the mark is made upon it.
    """
    for _ in range(tries):
        seen = store.latest()
        row = store.read("scan_runs", seen).filter((F.col("id") == run_id) & (F.col("status") == "running"))
        if row.isEmpty():
            return
        try:
            store.commit(changes={"scan_runs": row.withColumn("status", F.lit("cancelled"))}, seen=seen)
            return
        except Conflict:
            continue
    raise Conflict(f"run {run_id} could not be cancelled")


def work(store: Store, observed: DataFrame, run_id: int, now: Column, after_chunk: Callable[[int], None] | None = None) -> str:
    """Take the chunks of a run that wait, in order; each is one commit: its files, assets, moves, failures, counts and promotions.

    A run that is interrupted at any point goes on with the first chunk whose commit is missing, and
    ends with the same tables as an undisturbed one.  When all are done, files below the run's roots
    that it did not find are marked missing and the run is completed.  Between chunks the run's
    status is read: a cancelled one stops, and keeps what is committed.  A commit of another writer in
    between makes a chunk start again upon it.  Returns the status.
    """
    media = classified(observed)
    while True:
        seen = store.latest()
        run = store.read("scan_runs", seen).filter(F.col("id") == run_id).first()
        if run is None or run["status"] != "running":
            return run["status"] if run else "unknown"
        queue = store.read("scan_queue", seen).filter(F.col("scan_run_id") == run_id)
        chunk = queue.filter("stage = 'discovered'").agg(F.min("chunk")).first()[0]
        try:
            if chunk is None:
                _finish(store, seen, queue, run, now)
                return "completed"
            _one(store, seen, media, queue, run, int(chunk), now)
        except Conflict:
            continue
        store.maintain()
        if after_chunk is not None:
            after_chunk(int(chunk))


@owned
def _one(store: Store, seen: Commit, media: DataFrame, queue: DataFrame, run, chunk: int, now: Column) -> None:
    mine = materialize(queue.filter(F.col("chunk") == chunk))
    files = media.join(mine.select("path_key"), "path_key", "left_semi")
    out = scan(
        files, store.read("file_instances", seen), store.read("content_assets", seen), [], run["id"], now,
        seen=queue.select("path_key"),
    )
    counts = {f"{d}_count": run[f"{d}_count"] + out["counts"][f"{d}_count"] for d in DISPOSITIONS}
    changes = run_changes(out, run["id"], run["roots"], now, "running", counts)
    changes["scan_runs"] = run_row(store.spark, run["id"], run["roots"], now, "running", counts, F.lit(run["started_at"]))
    changes["scan_queue"] = mine.withColumn("stage", F.lit("promoted"))
    store.commit(changes=changes, seen=seen)
    release(mine)


@owned
def _finish(store: Store, seen: Commit, queue: DataFrame, run, now: Column) -> None:
    changes = {}
    if run["roots"]:
        instances = store.read("file_instances", seen)
        changes["file_instances"] = newly_missing(instances, queue.select("path_key"), run["roots"]).select(*(f.name for f in schema("file_instances")))
    counts = {f"{d}_count": run[f"{d}_count"] for d in DISPOSITIONS}
    changes["scan_runs"] = run_row(store.spark, run["id"], run["roots"], now, "completed", counts, F.lit(run["started_at"]))
    store.commit(changes=changes, seen=seen)


def scan_in_chunks(store: Store, observed: DataFrame, roots: list[str], now: Column, chunk_files: int = CHUNK_FILES, **options) -> tuple[int, str]:
    """A whole scan into the store: (run id, status).  See :func:`work`."""
    run_id = begin(store, observed, roots, now, chunk_files)
    return run_id, work(store, observed, run_id, now, **options)


def resume_run(store: Store, observed: DataFrame, now: Column, **options) -> tuple[int | None, str | None]:
    """Go on with the newest run that has chunks left; (None, None) if there is none."""
    found = resume_candidate(store.read("scan_runs"), store.read("scan_queue")).select("id").first()
    if found is None:
        return None, None
    return found["id"], work(store, observed, found["id"], now, **options)
