"""Ingest of a stream of manifest rows in micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from darkroom.operators.chunks import run_changes
from darkroom.operators.ingest import classified, scan
from darkroom.sources.scratch import owned
from darkroom.sources.store import Store


@owned
def apply_batch(store: Store, batch: DataFrame, epoch: int, now: Column) -> None:
    """One batch as a scan of no root: nothing is marked missing.  A batch seen before changes nothing.

    ``now`` is given, so that a batch that is replayed gives the same rows.
    """
    seen = store.latest()
    if not store.read("scan_runs", seen).filter(F.col("id") == epoch).isEmpty():
        return
    order = F.struct("modified_ms", "sha256")
    batch = classified(batch)
    last = batch.groupBy("path_key").agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    out = scan(last, store.read("file_instances", seen), store.read("content_assets", seen), [], epoch, now)
    store.commit(changes=run_changes(out, epoch, [], now, "completed", out["counts"]), seen=seen)
    store.maintain()


def start(stream: DataFrame, store: Store, checkpoint: str, clock: Callable[[int], datetime], once: bool = True) -> StreamingQuery:
    """Run the stream into the store; ``clock`` gives each batch its time; ``once`` reads what is there and stops."""
    writer = stream.writeStream.foreachBatch(lambda batch, epoch: apply_batch(store, batch, epoch, F.lit(clock(epoch))))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
