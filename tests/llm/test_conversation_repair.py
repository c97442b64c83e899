"""Repairs against a search over all edits."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from darkroom.llm import conversation_repair as cr
from darkroom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, audit) by trying all edits of each row, with up to two insertions at every place."""
    best = (10**9, "")
    options = []
    for s in symbols:
        row = [("D", 2, "")]
        if s != cr.GONE:
            left = 5 * (s % 2)
            row += [("K", left, "sua-"[s // 2])] + [("R", 1 + left, x) for x in "ua"]
        options.append(row)
    inserts = [("", 0, ""), *(("I", 5, x) for x in "ua"), *(("II", 10, x + y) for x in "ua" for y in "ua")]
    for rows in itertools.product(*options):
        base = sum(r[1] for r in rows)
        if base > best[0]:
            continue
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + sum(m[1] for m in more)
            if cost > best[0]:
                continue
            roles = more[0][2] + "".join(r[2] + m[2] for r, m in zip(rows, more[1:]))
            if FORM.fullmatch(roles):
                best = min(best, (cost, more[0][0] + "".join(r[0] + m[0] for r, m in zip(rows, more[1:]))))
    return best


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_every_short_input_by_search(length):
    machine = cr.Automaton()
    for symbols in itertools.product(range(9), repeat=length):
        cost, path = machine.scan(bytes(symbols))
        assert (cost, machine.trace(bytes(symbols), path)) == cheapest(symbols), symbols


def plain(symbols):
    """The same by a plain recursion, least cost and then least text, for long inputs."""

    @functools.cache
    def go(i, state, inserted):
        found = []
        if i == len(symbols):
            if state in cr.ENDS:
                found.append((0, ""))
        else:
            for edit, cost, to in cr.Automaton.arcs(symbols[i], state):
                rest = go(i + 1, to, 0)
                found.append((cost + rest[0], edit + rest[1]))
        if inserted < 3:
            rest = go(i, cr.NEXT[cr.MADE[state]][state], inserted + 1)
            found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=(10**9, ""))

    return go(0, cr.START, 0)


def test_long_inputs_and_the_table():
    rng, machine = random.Random(2), cr.Automaton()
    for _ in range(300):
        symbols = bytes(rng.choices(range(9), weights=[2, 1, 6, 2, 6, 2, 1, 1, 2], k=rng.randint(4, 60)))
        cost, path = machine.scan(symbols)
        assert (cost, machine.trace(symbols, path)) == plain(symbols)
    assert len(machine.vectors) < 60 and len(machine.table) <= 9 * len(machine.vectors)
    symbols = bytes(rng.choices(range(9), k=200_000))
    cost, path = machine.scan(symbols)
    audit = machine.trace(symbols, path)
    assert len(audit.replace("I", "")) == len(symbols) and len(machine.vectors) < 60


def brute(rows):
    """Report and repaired turns of one conversation's rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        initial = role[:1]
        symbols.append(8 if fault in ("blank", "duplicate") else 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + (fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain(bytes(symbols))
    left, at, system = [], iter(rows), 0
    for edit in audit:
        row = next(at) if edit != "I" else None
        if edit == "D":
            continue
        made = ("user", "assistant")[(len(left) - system) % 2]
        if edit == "K":
            made = row[1]
            system += made[0] == "s"
        left.append(f"{made}:{row[2] if row else ''}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)


def test_conversations_by_brute_force(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    texts = ["Yes.", "No", "", " \n", None, "What?  ", "é!", "a\x0b", "\xa0", "Long. " * 40]
    rows = []
    for conv in [*range(150), None]:
        for _ in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)))
    rows += rows[:30]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("audit", "cost", "digest", "kept", "place", "of", "sha256"):
        frame = frame.withColumn(name, F.lit("x"))
    every = spark.createDataFrame([(900,), (0,)], "conv_id long")
    out = cr.repair_digests(frame, every.unionByName(frame.select("conv_id"))).collect()
    assert len(out) == 152
    for row in out:
        mine = [r[1:] for r in rows if r[0] == row.conv_id]
        assert tuple(row)[1:] == brute(mine), mine
    assert cr.repair_digests(frame.limit(0), frame.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "cut"), (1, 2, "user", "Go on."), (1, 3, "user", "So."), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = cr.reports(frame).persist()
    left = [tuple(r) for r in cr.repaired(frame, found).orderBy("conv_id", "place").collect()]
    by = {r.conv_id: r for r in found.collect()}
    assert by[2].audit == "D" and by[2].cost == 2
    assert [r[0] for r in left] == [1] * len(left) and FORM.fullmatch("".join(r[4][0] for r in left))
    assert by[1].cost == plain(bytes([2, 5, 2, 2]))[0]
    found.unpersist()


def test_very_long_texts_and_conversations(spark):
    rows = [(1, 0, "user", "x" * 4_000_000 + "."), (1, 1, "assistant", "y" * 4_000_000)] + [(2, i, "user", f"{i}.") for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r.conv_id: tuple(r)[1:] for r in cr.repair_digests(frame, frame).collect()}
    assert out[1] == brute([r[1:] for r in rows[:2]])
    assert out[2][5] == 1500 and len(out[2][6]) == 3000


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "No", "A! B. C?", None, " ", "2.", "No 3"]))
            for c in range(60) for t in [*range(rng.randint(1, 7)), *([None] if c % 9 == 0 else [])]]
    rows += [(None, 3, "user", "x."), (None, None, "user", "x.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(base.execute(cr.ORACLE).fetchall(), key=repr)
