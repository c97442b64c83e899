"""Intermediate tables: who owns them, and that none is left."""

from __future__ import annotations

import gc
import os
import time

import pytest
from pyspark.sql import functions as F

from darkroom.plans import queries as plans
from darkroom.sources import scratch
from darkroom.sources.store import Store
from darkroom.streaming.ingest import apply_batch

SF = "/root/testdata/sf0.001"


def left(spark) -> list[str]:
    """Intermediate tables that are there when nothing refers to a result any more."""
    folder = scratch.shared_folder(spark)
    for _ in range(5):
        gc.collect()
        spark._jvm.System.gc()
        scratch.reap()
        found = sorted(os.listdir(folder))
        if not found:
            break
        time.sleep(0.2)
    return found


@pytest.fixture()
def bare(spark, tmp_path, monkeypatch):
    """A shared folder of the test's own."""
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    return spark


def test_tables_go_with_the_call_and_its_result(bare):
    seen = []

    @scratch.owned
    def inner(df):
        one, two = scratch.materialize(df), scratch.materialize(df.filter("id > 5"))
        seen.extend([one.written_at, two.written_at])
        return two.join(two.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))

    @scratch.owned
    def outer(df):
        found = inner(df)
        assert not os.path.exists(seen[0]) and os.path.exists(seen[1])
        return found.groupBy("id").count()

    out = outer(bare.range(10)).filter("id > 6")
    assert out.count() == 3
    gc.collect(), bare._jvm.System.gc(), scratch.reap()
    assert os.path.exists(seen[1]) and out.count() == 3
    del out
    assert left(bare) == []


def test_tables_of_a_failed_call_go(bare):
    @scratch.owned
    def failing():
        scratch.materialize(bare.range(5))
        raise ValueError("no")

    with pytest.raises(ValueError):
        failing()
    assert left(bare) == []


def test_broadcasts_go_when_no_function_waits(bare):
    held = []

    @scratch.owned
    def add(df, written):
        held.append(scratch.broadcast(bare, {"n": 7}))
        shared = held[-1]

        def run(batches):
            for b in batches:
                yield b.assign(id=b["id"] + shared.value["n"])

        out = df.mapInPandas(run, "id long")
        return scratch.materialize(out) if written else out

    assert sorted(r.id for r in add(bare.range(3), False).collect()) == [7, 8, 9]
    assert held[0]._jbroadcast.isValid()
    assert sorted(r.id for r in add(bare.range(3), True).collect()) == [7, 8, 9]
    assert not held[1]._jbroadcast.isValid()


def test_settings_hold_while_a_table_is_written(bare):
    before = {name: bare.conf.get(name, None) for name in scratch.WHILE_WRITING}
    with scratch._settings(bare):
        with scratch._settings(bare):
            pass
        assert all(bare.conf.get(name) == value for name, value in scratch.WHILE_WRITING.items())
    assert {name: bare.conf.get(name, None) for name in scratch.WHILE_WRITING} == before
    bare.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    scratch.release(scratch.materialize(bare.range(3)))
    assert bare.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m"
    bare.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", ["scan_dispositions", "rank_positions", "hamming_candidates", "greedy_cliques", "recompute_fates", "star_pairs"])
def test_queries_leave_nothing(bare, name):
    plans.queries()[name](bare, SF).collect()
    assert left(bare) == []


def test_micro_batches_leave_nothing(bare, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    store = Store(bare, str(folder), 2)
    ddl = "path string, size long, modified_ms long, volume_id string, file_id string, quick_fingerprint string, sha256 string"
    for epoch in range(4):
        batch = bare.createDataFrame([(f"r/f{epoch}.jpg", 1, epoch, "v", f"i{epoch}", "q", f"s{epoch}"), ("r/same.jpg", 1, epoch, "v", "i", "q", f"t{epoch}")], ddl)
        apply_batch(store, batch, epoch, F.lit("2024-05-01").cast("timestamp"))
        apply_batch(store, batch, epoch, F.lit("2024-05-01").cast("timestamp"))  # seen before
    assert store.read("file_instances").count() == 5 and store.read("scan_runs").count() == 4
    layers = os.listdir(folder / "file_instances")
    rows = sorted(bare.read.parquet(str(folder / "file_instances" / layer)).count() for layer in layers)
    assert rows == [2, 2, 2, 2]  # a batch writes its own files
    assert left(bare) == []
