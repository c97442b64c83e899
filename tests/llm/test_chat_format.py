"""Layouts, the reversible template and the loss mask."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from darkroom.llm import chat_format as cf

CASES = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None}], "id": 3}, "messages", [("user", "a"), ("tool", "")]),
    ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
    ({"messages": [{"role": "user"}]}, "messages", [("user", "")]),
    ({"messages": []}, "messages", []),
    ({"system": "s", "messages": []}, "messages", [("system", "s")]),
    ({"system": None, "messages": [{"role": None, "content": "a"}]}, "messages", [("", "a")]),
    ({"data": {"messages": [{"content": "a", "role": "user", "at": {"x": 1}}]}}, "nested messages", [("user", "a")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("system", "s"), ("user", "h"), ("assistant", "g")]),
    ({"dialogue": [{"speaker": "bot", "text": "h"}]}, "dialogue", [("assistant", "h")]),
    ({"turns": [{"role": "model", "text": "h"}]}, "turns", [("assistant", "h")]),
    ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": None, "response": "c", "system": "s"}, "prompt and response", [("system", "s"), ("user", ""), ("assistant", "c")]),
    ({"question": "q", "context": "x", "answer": 5}, "question and answer", [("user", "x\n\nq"), ("assistant", "5")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "response": "o", "a b": 1, "q:<z>": {"`": [[{"e": 1}]]}}, "instruction and response", [("user", "i"), ("assistant", "o")]),
    ({"prompt": {"x": 1}, "response": "r"}, None, None),
    ({"prompt": "p", "messages": []}, None, None),
    ({"messages": "text"}, None, None),
    ({"messages": [1, {"role": "user"}]}, None, None),
    ([1], None, None), ({}, None, None),
]


def paths(value, at=""):
    """The field paths of a JSON value, plainly."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        if not value:
            return {f"{at}[]"}
        if len({type(v) for v in value if v is not None}) > 1 and any(isinstance(v, (dict, list)) for v in value):
            return set()
        return {p for v in value for p in paths(v, f"{at}[]")} if isinstance(value[0], (dict, list)) else set()
    return {at} if at else set()


def test_layouts(spark):
    records = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(CASES)] + [(100, None), (101, "bad {"), (102, ""), (100, None)]
    frame = spark.createDataFrame(records, "id long, record string")
    for name in ("variant", "Paths", "layout", "turns", "a.b", "pieces", "heads", "formatted", "mask", "loss_text"):
        frame = frame.withColumn(name, F.lit("x"))
    rows = cf.read_back(cf.format_turns(cf.canonical_turns(frame))).collect()
    assert len(rows) == len(records)
    got = {r.id: r for r in rows}
    for i, (record, layout, turns) in enumerate(CASES):
        assert got[i].layout == layout, record
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns or turns == [], record
        if turns is not None:
            assert got[i].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert got[100].layout is got[101].turns is got[102].formatted is None


def test_paths_and_fingerprints(spark):
    records = [r for r, _, _ in CASES if isinstance(r, dict)] + [{"a": {"b": [{"c": 1, "d": {"e": None}}]}, "é x": [[{"u": 1.5}]], "k": True}]
    frame = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    found = frame.select(cf.field_paths(F.schema_of_variant(F.try_parse_json("record"))).alias("p")).collect()
    for record, row in zip(records, found):
        if "q:<z>" not in record:  # names are as the schema quotes them
            assert set(row.p) == paths(record), record
    one, two = (cf.fingerprint_of(p) for p in (["b", "a"], ["a", "b"]))
    assert one == two == hashlib.md5(b"a\nb").hexdigest()


def test_layouts_with_equal_fields_are_an_error(spark):
    frame = spark.createDataFrame([], "record string")
    twice = (cf.LAYOUTS[0], cf.Layout("other", cf.LAYOUTS[0].turns, cf.LAYOUTS[0].optional))
    with pytest.raises(ValueError):
        cf.canonical_turns(frame, layouts=twice)
    assert cf.format_turns(cf.canonical_turns(frame)).count() == 0


ODD = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<|im_end|>", "<|im_start|>", "|im_end|>", "\n", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "%", "%0A", "é😀", " ", "a", "\0"]


def test_texts_come_back(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(900)]
    groups = [[(rng.choice(["user", "assistant", "system", *texts[:9]]), t) for t in texts[i : i + rng.randint(0, 5)]] for i in range(0, 900, 3)]
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], f"id long, turns {cf.TURNS.replace(':', ': ')}")
    formatted = cf.format_turns(frame).select("id", "formatted", "mask")
    for row in cf.read_back(formatted).collect():
        turns = groups[row.id]
        assert [tuple(t) for t in row.turns] == turns
        assert row.loss_text == "".join(t for r, t in turns if r == "assistant")
        for (_, text), span in zip(turns, row.mask):
            inside = row.formatted[span.start : span.start + span.length]
            assert ("<|im_" in inside) is False and (inside == text or "\\" in inside)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join))
def test_escape_is_reversible_and_leaves_no_mark(text):
    import re

    t = cf.Template()
    escaped = re.sub(rf"([<\[])(\\*)({t.controls})", r"\1\\\2\3", text)
    assert re.sub(rf"([<\[])\\(\\*)({t.controls})", r"\1\2\3", escaped) == text
    assert not re.search(rf"[<\[]({t.controls})", escaped)


def test_running_sums(spark):
    frame = spark.createDataFrame([([],), ([5],), (list(range(1300)),)], "n array<bigint>")
    for row in frame.select("n", cf.before_each(F.col("n")).alias("s")).collect():
        assert row.s == [sum(row.n[:i]) for i in range(len(row.n))]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "n"),
            (2, 0, "assistant", "y" * 3_000_000 + "</s>"), (3, 0, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("x")).withColumn("turns", F.lit(1))
    out = cf.digests(cf.read_back(cf.format_turns(cf.canonical_turns(cf.records_of(frame))).select("conv_id", "formatted", "mask"))).collect()
    got = {r.conv_id: r for r in out}
    one = [("", "x"), ("user", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[1].n_turns == 5 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in one).encode()).hexdigest()
    assert got[1].loss_chars == 3 and got[1].loss_sha256 == hashlib.sha256(b"abb").hexdigest()
    assert got[2].loss_chars == 3_000_004 and got[None].n_turns == 1 and got[3].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert cf.digests(cf.read_back(cf.format_turns(cf.canonical_turns(cf.records_of(frame.limit(0)))))).count() == 0


def test_no_python_on_the_main_path(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = cf.digests(cf.read_back(cf.format_turns(cf.canonical_turns(cf.records_of(frame)))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
