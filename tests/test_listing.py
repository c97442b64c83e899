"""Pages of a clustered listing, and what is read for them."""

from __future__ import annotations

import random

import pytest

from darkroom.operators import classify

DDL = "instance_id long, quality double, rating int, current_path string, pixels long, ai_score double, last_seen_at long"


@pytest.mark.parametrize("sort", sorted(classify.SORTS))
def test_clustered_pages_are_those_of_the_whole_listing(spark, tmp_path, sort):
    rng = random.Random(7)
    some = lambda x: None if rng.random() < 0.2 else x
    rows = [(i, some(float(rng.randint(0, 4))), some(rng.randint(0, 5)), f"p{rng.random():.9f}", some(rng.randint(1, 9)), some(rng.randint(0, 3) / 4), i % 7) for i in range(230)]
    frame = spark.createDataFrame(rows, DDL)
    classify.cluster(frame, sort, str(tmp_path / "c"), rows_per_file=40)
    whole = [r.asDict() for r in frame.orderBy(*classify.order(sort)).collect()]
    for at, limit in ((-1, 10), (0, 10), (37, 15), (39, 10), (200, 15), (215, 30), (229, 5)):
        page = classify.clustered_page(spark, str(tmp_path / "c"), sort, whole[at] if at >= 0 else None, limit)
        assert [r.asDict() for r in page.collect()] == whole[at + 1 : at + 1 + limit]
        assert at == 229 or len(page.inputFiles()) <= 2
