"""Corpus queries leave no intermediate table."""

from __future__ import annotations

import gc
import os
import time

import pytest

import corpus_pipeline
from darkroom.llm import common, queries
from darkroom.sources import scratch

SF = "/root/testdata/sf0.001"


def left(spark, folder):
    """Intermediate tables that are there when nothing refers to a result any more."""
    for _ in range(5):
        gc.collect()
        spark._jvm.System.gc()
        scratch.reap()
        if not os.listdir(folder):
            return []
        time.sleep(0.2)
    return os.listdir(folder)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op6_embedding_dedup", "op7_substring_dedup", "op8_quality_rules", "op9_line_dedup", "op10_ngram_join",
                                  "op11_hard_negatives", "op13_conversation_repair", "pipeline"])
def test_queries_leave_nothing(spark, tmp_path, monkeypatch, name):
    for module in (scratch, common):
        monkeypatch.setattr(module, "shared_folder", lambda _: str(tmp_path))
    found = (queries.queries() | corpus_pipeline.queries())[name](spark, SF)
    assert found.count() > 0
    del found
    assert left(spark, tmp_path) == []
