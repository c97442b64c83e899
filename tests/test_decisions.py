"""Many decisions at once, and values at places without a sort."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from darkroom.operators import ingest, order, review
from darkroom.schema import schema

DECIDED = "seq long, group_id long, keep_ids array<long>, recycle_ids array<long>, note string"


def now():
    return F.lit("2024-05-01").cast("timestamp")


def library(spark, files, groups):
    """A state of ``files`` (id, quality) and ``groups`` (id, kind, members)."""
    empty = lambda t: spark.createDataFrame([], schema(t))
    fitted = lambda rows, ddl, t: ingest.fitted(spark.createDataFrame(rows, ddl), empty(t))
    return {
        "file_instances": fitted([(i, i, f"p{i:03}", True) for i, _ in files], "id long, content_asset_id long, current_path string, exists_flag boolean", "file_instances"),
        "content_assets": fitted([(i, q) for i, q in files], "id long, quality_score double", "content_assets"),
        "match_groups": fitted([(g, k, "pending") for g, k, _ in groups], "id long, kind string, status string", "match_groups"),
        "group_members": fitted([(g, i) for g, _, m in groups for i in m], "group_id long, file_instance_id long", "group_members"),
        "review_actions": fitted([(4, 99)], "id long, group_id long", "review_actions"),
    }


def one_by_one(files, groups, decisions):
    """The same in plain Python: live files, accepted decisions and rejected ones."""
    live = {i for i, _ in files}
    members = {g: set(m) for g, _, m in groups}
    accepted = []
    for seq, g, keep, recycle, _ in sorted(decisions):
        here = members.get(g, set()) & live
        ok = len(here) >= 2 and keep and recycle and not set(keep) & set(recycle) and set(keep) | set(recycle) == here
        if ok and len(set(keep)) == len(keep) and len(set(recycle)) == len(recycle):
            live -= set(recycle)
            accepted.append((seq, g))
    return live, accepted


def test_decisions_at_once_are_decisions_one_by_one(spark):
    rng = random.Random(4)
    files = [(i, float(rng.randint(0, 5))) for i in range(120)]
    groups = [(g, rng.choice(["exact", "similar"]), rng.sample(range(120), rng.randint(2, 5))) for g in range(1, 61)]
    decisions = []
    for seq in range(90):
        g, _, m = rng.choice(groups)
        m = [i for i in m if rng.random() > 0.04]
        cut = rng.randint(0, len(m))
        decisions.append((seq, g, m[:cut] + ([m[0]] if m and rng.random() < 0.05 else []), m[cut:], f"n{seq}"))
    decisions += [(200, 999, [1], [2], None)]
    live, accepted = one_by_one(files, groups, decisions)
    state = library(spark, files, groups)
    out = review.apply_decisions(state, spark.createDataFrame(decisions, DECIDED), now())
    done = {r.seq: r.error for r in out["outcomes"].collect()}
    assert len(done) == len(decisions) and sorted(s for s, e in done.items() if e is None) == [s for s, _ in accepted] and 5 < len(accepted) < 90
    assert done[200] == "group not found"
    assert {r.id for r in out["file_instances"].filter("exists_flag").collect()} == live
    assert {r.id for r in out["recycle_plan"].collect()} == {i for i, _ in files} - live
    actions = out["review_actions"].filter("id > 4").orderBy("id").collect()
    assert [(r.id, r.group_id) for r in actions] == [(5 + k, g) for k, (_, g) in enumerate(accepted)] and actions[0].created_at == datetime(2024, 5, 1)
    held: dict = {}
    for r in out["group_members"].collect():
        held.setdefault(r.group_id, set()).add(r.file_instance_id)
    applied = {g for _, g in accepted}
    want = {g: set(m) & live for g, _, m in groups if g in applied or len(set(m) & live) >= 2}
    assert {r.id for r in out["match_groups"].collect()} == set(want) and held == {g: m for g, m in want.items() if m}


def test_decisions_agree_with_single_application(spark):
    files, groups = [(i, 1.0) for i in range(1, 6)], [(1, "exact", [1, 2]), (2, "similar", [2, 3, 4]), (3, "exact", [4, 5])]
    decisions = [(1, 1, [1], [2], "a"), (2, 2, [3], [4], "b"), (3, 3, [4], [5], "c")]
    state = library(spark, files, groups)
    out = review.apply_decisions(state, spark.createDataFrame(decisions, DECIDED), now())
    single = state
    for k, (_, g, keep, recycle, note) in enumerate(decisions[:2]):
        single = review.apply_decision(single, g, keep, recycle, note, 5 + k, now())
    assert {r.seq: r.error for r in out["outcomes"].collect()} == {1: None, 2: None, 3: "group not found"}
    for name in ("file_instances", "match_groups", "group_members", "review_actions"):
        assert sorted(map(tuple, out[name].collect()), key=repr) == sorted(map(tuple, single[name].select(*out[name].columns).collect()), key=repr), name
    none = review.apply_decisions(state, spark.createDataFrame([(1, 1, [1], [], None)], DECIDED), now())
    assert none["outcomes"].first().error and none["match_groups"].count() == 3 and none["recycle_plan"].count() == 0
    assert review.apply_decisions(state, spark.createDataFrame([], DECIDED), now())["outcomes"].count() == 0


def test_values_at_places(spark):
    rng = np.random.default_rng(1)
    sets = {
        1: rng.normal(size=800), 2: np.zeros(50), 3: np.array([5.0]), 4: np.concatenate([np.full(400, 1.0), 2.0 ** -np.arange(300)]),
        5: np.array([-1.7e308, 1.7e308, 0.0, 1.0, 5e-324]), 6: rng.integers(0, 3, 200).astype(float),
    }
    rows = spark.createDataFrame([(s, float(v)) for s, vs in sets.items() for v in vs], "s long, v double")
    asked = [(s, f"p{k}", k) for s, vs in sets.items() for k in sorted({0, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs) + 5})] + [(9, "p0", 0)]
    got = {(r.s, r.name): r["at"] for r in order.values_at(rows, ["s"], "v", spark.createDataFrame(asked, "s long, name string, place long")).collect()}
    assert got == {(s, n): float(np.sort(sets[s])[k]) for s, n, k in asked if s in sets and k < len(sets[s])}
