"""Scenarios and properties of the library operators."""

from __future__ import annotations

import hashlib
import itertools
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.functions import encoder, hashing, imaging, paths
from darkroom.functions.vectors import from_bytes, ssim_bytes, to_bytes
from darkroom.operators import graph, ingest, jobs, learning, matching, order, ranking, ratings, review
from darkroom.schema import schema
from darkroom.sources import files
from darkroom.sources.store import Store
from darkroom.streaming.ingest import start


def test_path_functions(spark):
    rows = spark.createDataFrame([("A\\b\\Pic.JPG ",), ("x/.hidden",), ("x/none",), ("//?/C:/q.tar.gz",)], "p string")
    p = F.col("p")
    got = rows.select(paths.extension(p), paths.stem(p), paths.path_key(p), paths.directory(p), paths.display_path(p)).collect()
    assert [r[0] for r in got] == ["jpg", "", "", "gz"]
    assert [r[1] for r in got] == ["pic", ".hidden", "none", "q.tar"]
    assert got[0][2] == "a/b/pic.jpg"
    assert got[0][3] == "/b/"
    assert got[3][4] == "C:/q.tar.gz"


def test_hash_columns(spark):
    rows = spark.createDataFrame([("ffffffffffffffff", "ff00"), ("zz", "0f"), ("1", "")], "h string, x string")
    got = rows.select(hashing.from_hex16(F.col("h")), hashing.hex_to_bits(F.col("x"), 16)).collect()
    assert [r[0] for r in got] == [-1, 0, 1]
    assert got[0][1] == [1.0] * 8 + [0.0] * 8
    assert got[1][1] == [0.0] * 4 + [1.0] * 4 + [0.0] * 8


def test_quick_fingerprint_reads_slices(spark):
    base = bytes(range(256)) * 2048
    changed = bytearray(base)
    changed[-1] ^= 1
    between = bytearray(base)
    between[100_000] ^= 1  # in no slice
    rows = spark.createDataFrame([(1, bytearray(base)), (2, changed), (3, between)], "i int, c binary")
    got = {r.i: r.f for r in rows.select("i", hashing.quick_fingerprint(F.col("c")).alias("f")).collect()}
    assert got[1] != got[2] and got[1] == got[3]


def test_band_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12)
    rows = []
    for i in range(150):
        h = int(base[i % 12])
        for bit in rng.choice(63, size=rng.integers(0, 8), replace=False):
            h ^= 1 << int(bit)
        rows.append((i, h, int(base[i % 5])))
    frame = spark.createDataFrame(rows, "asset_id long, phash long, dhash long")
    got = {(r.a, r.b) for r in matching.hamming_join(frame).collect()}
    want = {
        (a[0], b[0]) for a, b in itertools.combinations(rows, 2)
        if bin(a[1] ^ b[1]).count("1") <= 8 and bin(a[2] ^ b[2]).count("1") <= 12
    }
    assert got == want and want
    classes = {r.asset_id: r.rep for r in matching.hash_classes(frame).collect()}
    equal = {(r[0], o[0]) for r in rows for o in rows if r[1:] == o[1:]}
    assert all((classes[a] == classes[b]) == ((a, b) in equal) for a in classes for b in classes)


def test_bands_meet_few_unrelated_hashes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 1 << 62)) * 2 + int(rng.integers(0, 2)), 0) for i in range(1500)]
    keys = spark.createDataFrame(rows, "rep long, phash long, dhash long").select(
        "rep", F.explode(matching.band_keys(F.col("phash"), 63, 8, 2)).alias("key")
    )
    assert keys.count() == 1500 * 66
    of_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert of_key < 1500 * 1499 / 2 / 1000  # of all pairs


def cliques(spark, edges, quality):
    pairs = spark.createDataFrame(edges, "a long, b long, similarity double")
    nodes = spark.createDataFrame(quality, "asset_id long, quality double")
    out: dict[int, set] = {}
    for r in matching.greedy_cliques(pairs, nodes).collect():
        out.setdefault(r.anchor_id, set()).add(r.asset_id)
    return sorted(map(sorted, out.values()))


def test_cliques(spark):
    assert cliques(spark, [(1, 2, 0.98), (2, 3, 0.99)], [(1, 9.0), (2, 5.0), (3, 1.0)]) == [[1, 2]]
    five = [(a, b, 0.98) for a, b in itertools.combinations(range(1, 6), 2)]
    assert cliques(spark, five, [(i, 10.0 - i) for i in range(1, 6)]) == [[1, 2, 3, 4]]
    assert cliques(spark, [(1, 2, 0.98), (1, 3, 0.98)], [(1, 9.0), (2, 1.0), (3, 5.0)]) == [[1, 2]]


def test_cliques_of_long_chains(spark):
    rng = np.random.default_rng(7)
    path = [int(x) for x in rng.permutation(600)]
    edges = [(min(p), max(p), round(0.96 + 0.001 * (i % 37), 3)) for i, p in enumerate(itertools.pairwise(path))]
    quality = [(i, float(x)) for i, x in enumerate(rng.permutation(600))]
    found = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long, s double")).collect()}
    assert found == dict.fromkeys(range(600), 0)
    links, used, want = {}, set(), []
    for a, b, s in edges:
        links.setdefault(a, {})[b] = links.setdefault(b, {})[a] = s
    for anchor in sorted(links, key=lambda v: (-quality[v][1], v)):
        free = [v for v in links[anchor] if v not in used]
        if anchor not in used and free:  # a path has no triangles, so a clique is a pair
            pair = {anchor, min(free, key=lambda v: (-links[anchor][v], v))}
            used |= pair
            want.append(sorted(pair))
    assert cliques(spark, edges, quality) == sorted(want)


def test_cliques_of_large_components_in_rounds(spark):
    rng = np.random.default_rng(17)
    pairs = {(int(min(p)), int(max(p))) for p in rng.integers(0, 24, (60, 2)) if p[0] != p[1]}
    edges = [(a, b, 0.97 + int(rng.integers(0, 4)) / 100) for a, b in sorted(pairs)]
    frame = spark.createDataFrame(edges, "a long, b long, similarity double")
    nodes = spark.createDataFrame([(i, float(rng.integers(0, 5))) for i in range(24)], "asset_id long, quality double")
    whole = rows(matching.greedy_cliques(frame, nodes), "anchor_id", "asset_id", "similarity")
    assert rows(matching.greedy_cliques(frame, nodes, held_edges=9), "anchor_id", "asset_id", "similarity") == whole and len(whole) > 8


def plain_cover(pairs, quality, most=4):
    """The cover by a plain loop over assets."""
    links, used, out = {}, set(), []
    for a, b, s in pairs:
        links.setdefault(a, {})[b] = s
        links.setdefault(b, {})[a] = s
    for anchor in sorted(links, key=lambda v: (-quality[v], v)):
        clique = [anchor]
        if anchor not in used:
            for v in sorted(links[anchor], key=lambda v: (-links[anchor][v], v)):
                if len(clique) < most and v not in used and all(v in links[c] for c in clique):
                    clique.append(v)
        if len(clique) > 1:
            used.update(clique)
            out += [(anchor, v, max(links[v][c] for c in clique if c != v)) for v in clique]
    return sorted(out)


@pytest.mark.parametrize("held", [12, 10_000])
def test_cliques_of_twins_are_those_of_all_pairs(spark, held):
    rng = np.random.default_rng(31)
    twin, quality, linked = {}, {}, {}
    for t in range(14):  # classes of up to nine twins, one of forty
        size = 40 if t == 3 else int(rng.integers(1, 10))
        for i in range(size):
            asset = 100 * i + t  # ids of the classes interleave
            twin[asset], quality[asset] = t, float(rng.integers(0, 4))
    for _ in range(26):
        a, b = sorted(int(x) for x in rng.choice(14, 2, replace=False))
        linked[a, b] = round(0.97 + int(rng.integers(0, 3)) / 100, 2)
    every = [(a, b, 1.0 if twin[a] == twin[b] else linked.get(tuple(sorted((twin[a], twin[b]))))) for a, b in itertools.combinations(sorted(twin), 2)]
    want = plain_cover([p for p in every if p[2] is not None], quality)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in linked.items()], "a long, b long, similarity double")
    nodes = spark.createDataFrame([(a, quality[a], t) for a, t in twin.items()], "asset_id long, quality double, twin long")
    got = matching.greedy_cliques(pairs, nodes, held_edges=held)
    assert sorted((r.anchor_id, r.asset_id, r.similarity) for r in got.collect()) == want and len(want) > 60


def test_a_falling_chain_needs_as_many_rounds_as_blocks(spark, monkeypatch):
    """Each anchor waits for the one before it, so nothing but the order of the chain can be followed."""
    n = 20_000
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.98).alias("similarity"))
    nodes = spark.range(n).select(F.col("id").alias("asset_id"), (n - F.col("id")).cast("double").alias("quality"))
    tasks = []
    monkeypatch.setattr(matching, "_cover_task", lambda most, real=matching._cover_task: tasks.append(1) or real(most))
    got = {(r.anchor_id, r.asset_id) for r in matching.greedy_cliques(pairs, nodes, held_edges=6_000).collect()}
    assert got == {(i, j) for i in range(0, n - 1, 2) for j in (i, i + 1)}
    assert len(tasks) <= 12


def test_twins_have_equal_pixels(spark):
    found = spark.createDataFrame(
        [(1, 5, 5, [0.5, 1.0]), (2, 5, 5, [0.5, 1.0]), (3, 5, 5, [0.5, 0.9]), (4, None, 5, [0.5, 1.0]), (5, None, 5, [0.5, 1.0])],
        "asset_id long, phash long, dhash long, buffer array<double>",
    )
    assert {r.asset_id: r.twin for r in matching.twin_classes(found).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_raw_pairs(spark):
    rows = spark.createDataFrame([("d/x.rw2",), ("d/x.jpg",), ("e/x.jpg",), ("d/x.mp4",)], "path string")
    ext = paths.extension(F.col("path"))
    key = F.concat_ws("|", F.lower(paths.parent(F.col("path"))), paths.stem(F.col("path")))
    got = {r.path: r.role for r in matching.raw_export_sets(rows, key, ext == "rw2", ext.isin("jpg", "png")).collect()}
    assert got == {"d/x.rw2": "protected_raw", "d/x.jpg": "paired_export", "d/x.mp4": "paired_export"}


def test_decision_rules(spark):
    cases = [
        ([1], [2], [1, 2], None), ([1, 1], [2], [1, 2], "duplicate keep id"), ([1], [2, 2], [1, 2], "duplicate recycle id"),
        ([], [1, 2], [1, 2], "at least one file must be kept"), ([1, 2], [], [1, 2], "at least one file must be recycled"),
        ([1], [1, 2], [1, 2], "a file is both kept and recycled"), ([1], [2, 9], [1, 2], "a file is not in the group"),
        ([1], [2], [1, 2, 3], "every file needs a decision"), ([1], [2], None, "group not found"),
    ]
    frame = spark.createDataFrame(cases, "k array<bigint>, r array<bigint>, m array<bigint>, want string")
    got = frame.select("want", review.decision_error(F.col("k"), F.col("r"), F.col("m")).alias("e")).collect()
    assert [r.e for r in got] == [r.want for r in got]


def test_prune(spark):
    groups = spark.createDataFrame([(1, "pending", 1), (2, "applied", 3)], "id long, status string, recommended_keep_instance_id long")
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "group_id long, file_instance_id long")
    instances = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, True), (3, "c", 2, False), (4, "d", 2, True)],
                                      "id long, current_path string, content_asset_id long, exists_flag boolean")
    assets = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, quality_score double")
    kept, left = review.prune(groups, members, instances, assets)
    assert [tuple(r) for r in kept.collect()] == [(2, "applied", 4)]
    assert [tuple(r) for r in left.collect()] == [(2, 4)]


def test_rating_log(spark):
    log = spark.createDataFrame([(7, 2, "n", 1, None), (7, 5, None, 2, None)], schema("rating_events"))
    once = ratings.undo(log, F.current_timestamp())
    assert [r.rating for r in ratings.current(once).collect()] == [2]
    first = spark.createDataFrame([(7, 3, None, 1, None)], schema("rating_events"))
    assert ratings.current(ratings.undo(first, F.current_timestamp())).collect() == []
    with pytest.raises(Exception, match="rating must be 0 to 5"):
        ratings.set_rating(log, log.withColumn("rating", F.lit(6))).collect()


def ranks(spark, n):
    frame = spark.createDataFrame([(1, i, float(100 - i)) for i in range(n)], "set_id long, asset_id long, score double")
    return ranking.ranked(frame).orderBy("rank_position").collect()


def test_rank_buckets(spark):
    assert [(r.rank_bucket, r.score_gap, r.percentile) for r in ranks(spark, 1)] == [("back", 0.0, 100.0)]
    assert [r.rank_bucket for r in ranks(spark, 5)] == ["top", "mid", "mid", "back", "back"]


def test_ranks_across_partitions(spark):
    """Places, gaps and cuts of a set that is spread over range partitions, with ties, against plain Python."""
    rng = np.random.default_rng(4)
    rows = [(s, i, float(rng.integers(0, 60)) / 4) for s, n in ((1, 400), (2, 3), (3, 37)) for i in range(n)]
    got = {(r.set_id, r.asset_id): r for r in ranking.ranked(spark.createDataFrame(rows, "set_id long, asset_id long, score double")).collect()}
    assert len(got) == len(rows)
    for set_id in (1, 2, 3):
        order = sorted((-score, asset) for s, asset, score in rows if s == set_id)
        scores, n = [-x for x, _ in order], len(order)
        gaps = [min([abs(scores[k] - scores[j]) for j in (k - 1, k + 1) if 0 <= j < n], default=0.0) if 0 < k < n - 1 else None for k in range(n)]
        for k, (_, asset) in enumerate(order):
            near = [abs(scores[k] - scores[j]) for j in (k - 1, k + 1) if 0 <= j < n]
            assert got[set_id, asset].rank_position == k + 1 and got[set_id, asset].n == n
            if gaps[k] is not None:
                assert got[set_id, asset].score_gap == min(near)
        by_gap = sorted(r.score_gap for (s, _), r in got.items() if s == set_id)
        cuts = [by_gap[int((n - 1) * q + 0.5)] for q in (0.35, 0.70)]
        for (s, _), r in got.items():
            if s == set_id:
                assert r.uncertainty_bucket == ("high" if r.score_gap <= cuts[0] else "medium" if r.score_gap <= cuts[1] else "low")


def test_star_pairs(spark):
    best = spark.createDataFrame([(1, 5), (2, 3), (3, 1), (4, 1)], "asset_id long, rating int")
    got = sorted((r.better_id, r.worse_id, r.weight) for r in ranking.star_pairs(best).collect())
    assert got == [(1, 2, 0.2), (1, 3, 0.4), (1, 4, 0.4), (2, 3, 0.2), (2, 4, 0.2)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _normal(x):
    length = float(np.sqrt((x * x).sum()))
    return x / length if length > 1e-6 else x


def test_heads_equal_plain_loops(tmp_path):
    """Weights of the batch trainers against loops over samples that sum gradients and divide by their number."""
    rng = np.random.default_rng(1)
    x, rating = rng.normal(size=(9, 30)), rng.integers(0, 6, 9).astype(float)
    y = [(min(max(r, 1), 5) - 1) / 4 for r in rating]
    head, found = learning.LinearHead.train(x, rating, epochs=7)
    w, bias = np.zeros(30), 0.5
    for _ in range(7):
        dw, db = np.zeros(30), 0.0
        for row, want in zip(x, y):
            error = _sigmoid(w @ row + bias) - want
            dw += error * row
            db += error
        w, bias = w - 0.01 * (dw / 9 + 0.001 * w), bias - 0.01 * db / 9
    assert np.allclose(head.weights, w) and abs(head.bias - bias) < 1e-12 and found["sample_count"] == 9
    mlp, found = learning.MlpHead.train(x, rating, epochs=7)
    ref = learning.MlpHead.new(30)
    assert ref.w1.shape == (8, 30) and abs(ref.w1[0, 1] - np.sin(2 * 0.618034) * np.sqrt(2 / 30) * 0.35) < 1e-12
    assert abs(ref.w2[3] - np.sin((8 * 30 + 4) * 0.618034) * np.sqrt(2 / 8) * 0.35) < 1e-12
    for _ in range(7):
        g1, gb1, g2, gb2 = np.zeros_like(ref.w1), np.zeros(8), np.zeros(8), 0.0
        for row, want in zip(map(_normal, x), y):
            pre = ref.w1 @ row + ref.b1
            h = np.maximum(pre, 0)
            error = min(max(_sigmoid(ref.w2 @ h + ref.b2) - want, -1), 1)
            g2 += error * h
            gb2 += error
            for j in range(8):
                if pre[j] > 0:
                    g1[j] += error * ref.w2[j] * row
                    gb1[j] += error * ref.w2[j]
        ref.w1, ref.b1 = ref.w1 - 0.03 * (g1 / 9 + 0.0005 * ref.w1), ref.b1 - 0.03 * gb1 / 9
        ref.w2, ref.b2 = ref.w2 - 0.03 * (g2 / 9 + 0.0005 * ref.w2), ref.b2 - 0.03 * gb2 / 9
    assert np.allclose(mlp.w1, ref.w1) and np.allclose(mlp.w2, ref.w2) and abs(mlp.b2 - ref.b2) < 1e-12
    assert abs(found["mse"] - np.mean((ref.score(x) - y) ** 2)) < 1e-12
    for kind, model in ((learning.LinearHead, head), (learning.MlpHead, mlp)):
        model.save(tmp_path / "head.json")
        assert np.allclose(kind.load(tmp_path / "head.json").score(x), model.score(x))
        with pytest.raises(ValueError, match="no training samples"):
            kind.train(x[:0], rating[:0])
    far, _ = learning.MlpHead.train(np.eye(4), np.array([5.0, 4, 1, 2]))
    assert far.score(np.eye(4))[0] > far.score(np.eye(4))[2]


def test_pairwise_net_equals_plain_loop(tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(8, 40)), rng.normal(size=(8, 40))
    weight, tie = rng.uniform(0.2, 1, 8), np.arange(8) % 3 == 0
    net, ref = ranking.PairwiseNet.new(40), ranking.PairwiseNet.new(40)
    assert abs(ref.w1[0, 1] - np.sin((97 + 2) * 0.618034) * np.sqrt(2 / 40) * 0.28) < 1e-12
    assert abs(ref.w2[3] - np.sin((193 + 16 * 40 + 4) * 0.618034) * np.sqrt(2 / 16) * 0.25) < 1e-12
    found = net.train(a, b, weight, tie, epochs=6)
    for _ in range(6):
        g1, gb, g2 = np.zeros_like(ref.w1), np.zeros_like(ref.b1), np.zeros_like(ref.w2)
        for x, z, w, t in zip(map(_normal, a), map(_normal, b), weight, tie):
            diff = float(np.maximum(ref.w1 @ x + ref.b1, 0) @ ref.w2 - np.maximum(ref.w1 @ z + ref.b1, 0) @ ref.w2)
            pull = diff * w if t else (_sigmoid(diff) - 1) * w
            for row, side in ((x, pull), (z, -pull)):
                pre = ref.w1 @ row + ref.b1
                g2 += side * np.maximum(pre, 0)
                for j in range(len(pre)):
                    if pre[j] > 0:
                        g1[j] += side * ref.w2[j] * row
                        gb[j] += side * ref.w2[j]
        ref.w1, ref.b1 = ref.w1 - 0.02 * (g1 / 8 + 0.0004 * ref.w1), ref.b1 - 0.02 * gb / 8
        ref.w2 = ref.w2 - 0.02 * (g2 / 8 + 0.0004 * ref.w2)
    assert np.allclose(net.w1, ref.w1) and np.allclose(net.b1, ref.b1) and np.allclose(net.w2, ref.w2)
    gap = ref.score(a) - ref.score(b)
    assert abs(found["tie_loss"] - np.mean((0.5 * gap**2 * weight)[tie])) < 1e-12
    assert found["preference_pair_count"] == 5 and found["tie_pair_count"] == 3 and not found["weak_only"]
    assert abs(found["preference_accuracy"] - (gap[~tie] > 0).mean()) < 1e-12
    net.save(tmp_path / "net.json")
    assert np.allclose(ranking.PairwiseNet.load(tmp_path / "net.json").score(a), net.score(a))
    with pytest.raises(ValueError, match="no ranking samples"):
        net.train(a[:0], b[:0], weight[:0], tie[:0])


def ramp(height, width, seed):
    index = np.arange(height * width).reshape(height, width)
    return (seed + index % 255) % 256


def write_jpeg(spark, path, grey):
    """A colour JPEG of greys by the JVM's own writer."""
    jvm = spark._jvm
    (path.parent / "source.png").write_bytes(imaging.encode_png(np.repeat(grey[:, :, None], 3, axis=2)))
    source = jvm.java.io.File(str(path.parent / "source.png"))
    assert jvm.javax.imageio.ImageIO.write(jvm.javax.imageio.ImageIO.read(source), "jpg", jvm.java.io.File(str(path)))
    (path.parent / "source.png").unlink()


def test_image_features(spark, tmp_path):
    for name, grey in (("a", ramp(60, 80, 10)), ("b", ramp(60, 80, 10)), ("c", ramp(50, 50, 90))):
        (tmp_path / f"{name}.png").write_bytes(imaging.encode_png(grey))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "bad.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_bytes(b"no picture")
    rows = {r.path.rsplit("/", 1)[1]: r for r in imaging.features(files.pictures(spark, [str(tmp_path)])).collect()}
    assert set(rows) == {"a.png", "b.png", "c.png", "bad.png"} and rows["bad.png"].error and rows["bad.png"].phash is None
    assert rows["bad.png"].sha256 == hashlib.sha256(b"no image").hexdigest()
    assert rows["a.png"].phash == rows["b.png"].phash and (rows["a.png"].width, rows["a.png"].height) == (80, 60)
    assert rows["a.png"].phash >= 0 and 0 <= rows["a.png"].quality_score <= 100
    pair = spark.createDataFrame([(rows["a.png"].buffer, rows["b.png"].buffer)], "x binary, y binary")
    assert pair.select(ssim_bytes("x", "y")).first()[0] == pytest.approx(1.0) and len(rows["a.png"].buffer) == 128 * 128


def test_pictures_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    colour, grey = rng.integers(0, 256, (5, 7, 3)), rng.integers(0, 256, (4, 6))
    (tmp_path / "colour.png").write_bytes(imaging.encode_png(colour))
    (tmp_path / "grey.PNG").write_bytes(imaging.encode_png(grey))
    found = {r.path.rsplit("/", 1)[1]: imaging.colours(r.image.asDict()) for r in files.pictures(spark, [str(tmp_path)]).collect()}
    assert (found["colour.png"] == colour).all() and (imaging.luma8(found["grey.PNG"]) == grey).all()


def test_hashes_compare_eight_bit_pixels():
    """Flat areas have no edges, and a picture a pixel larger hashes alike."""
    for value in (0, 17, 128, 255):
        for shape in ((32, 32), (300, 400), (301, 401), (97, 1013)):
            flat = np.full(shape, float(value))
            assert imaging.difference_hash(flat) == 0 and imaging.perceptual_hash(flat) == 0

    def square(height, width):
        out = np.full((height, width), 255.0)
        out[height // 4 : height // 2, width // 4 : width // 2] = 20
        return out

    def screen(height, width):  # a bar, a border and text-like stripes on a flat page
        out = np.full((height, width), 240.0)
        out[: height // 10] = 40
        out[:, : width // 50] = 90
        out[height // 3 : height // 2 : 4, width // 8 : width // 2] = 60
        return out

    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for draw, near in ((square, 0), (screen, 2)):
        hashes = [(imaging.difference_hash(draw(h, w)), imaging.perceptual_hash(draw(h, w))) for h, w in ((300, 400), (301, 401), (600, 800))]
        assert all(apart(hashes[0][0], d) <= near and apart(hashes[0][1], p) <= near + 2 for d, p in hashes[1:])
    assert imaging.luma8(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]]])).tolist() == [[54, 182, 18, 9]]


def test_jpeg_and_thumbnails(spark, tmp_path):
    y, x = np.mgrid[0:41, 0:467]
    grey = np.clip(128 + 70 * np.sin(x / 9) + 40 * np.cos(y / 7), 0, 255)
    write_jpeg(spark, tmp_path / "a.jpg", grey)
    (tmp_path / "b.png").write_bytes(imaging.encode_png(grey))
    found = imaging.features(files.pictures(spark, [str(tmp_path)]))
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert bin(got["a.jpg"].phash ^ got["b.png"].phash).count("1") <= 6 and got["a.jpg"].width == 467
    folder = tmp_path / "thumbs"
    folder.mkdir()
    for where in (str(folder), f"file://{folder}"):
        named = {r.sha256: r.thumbnail_path for r in imaging.thumbnail_files(found, where).collect()}
    assert sorted(p.name for p in folder.iterdir()) == sorted(f"{s}.png" for s in named) and len(named) == 2
    small = files.pictures(spark, [str(folder)]).collect()
    assert all((r.image.height, r.image.width) == (34, 384) for r in small)


def test_encoder(spark, tmp_path):
    y, x = np.mgrid[0:30, 0:50]
    grey = np.clip(100 + 3 * x, 0, 255)
    write_jpeg(spark, tmp_path / "a.jpg", grey)
    (tmp_path / "b.png").write_bytes(imaging.encode_png(grey))
    (tmp_path / "c.jpg").write_bytes(b"no image")
    shown = encoder.encoder_input(np.repeat(grey[:, :, None].astype(float), 3, axis=2))
    assert shown.shape == (3, 224, 224) and shown.dtype == np.float32
    want = (resized := imaging.resize(grey.astype(float), 224, 224) / 255)[10, 20]
    assert abs(shown[1, 10, 20] - (want - 0.4578275) / 0.26130258) < 1e-5 and resized.max() <= 1
    found = encoder.embeddings(files.pictures(spark, [str(tmp_path)]), "m", lambda path: lambda batch: batch.reshape(len(batch), 3, -1).mean(axis=2) + len(path), 2)
    got = [r for r in found.collect()]
    assert sum(r.error is not None for r in got) == 1 and all((r.embedding is None) == (r.error is not None) for r in got)
    one, two = (np.array(r.embedding) for r in got if r.embedding)
    assert abs(one @ one - 1) < 1e-5 and one @ two > 0.999


def test_scan_states(spark, tmp_path):
    """New files, a rescan without changes, a same-volume move, a disappearance."""
    manifest = lambda rows: spark.createDataFrame(
        [(p, 10, 1, "V", i, s, s) for p, i, s in rows],
        "path string, size long, modified_ms long, volume_id string, file_id string, quick_fingerprint string, sha256 string",
    )
    empty = lambda t: spark.createDataFrame([], schema(t))
    now = F.to_timestamp(F.lit("2026-01-01"))
    counts = lambda out: tuple(ingest.run_counters(out["files"]).first())
    first = manifest([("r/a.jpg", "1", "s1"), ("r/b.jpg", "2", "s1"), ("r/c.png", "3", "s2"), ("r/d.zip", "4", "s3")])
    one = ingest.scan(first, empty("file_instances"), empty("content_assets"), ["r"], 1, now)
    assert counts(one) == (3, 0, 0)
    assert [tuple(r) for r in one["unknown_formats"].collect()] == [("zip", 1, "r/d.zip")]
    state = {k: one[k].persist() for k in ("file_instances", "content_assets")}
    assert state["content_assets"].count() == 2
    two = ingest.scan(first, state["file_instances"], state["content_assets"], ["r"], 2, now)
    assert counts(two) == (0, 0, 3)
    moved = manifest([("r/a.jpg", "1", "s1"), ("r/new/c.png", "3", "s2")])
    three = ingest.scan(moved, state["file_instances"], state["content_assets"], ["r"], 3, now)
    assert counts(three) == (0, 1, 1)
    assert [(r.old_path, r.new_path, r.change_type) for r in three["path_history"].collect()] == [("r/c.png", "r/new/c.png", "same_volume_move")]
    live = {r.path_key: r.exists_flag for r in three["file_instances"].collect()}
    assert live == {"r/a.jpg": True, "r/b.jpg": False, "r/new/c.png": True}


def test_ambiguous_relocation(spark):
    instances = spark.createDataFrame([(1, 9, "old/a", "old/a"), (2, 9, "old/b", "old/b")], "id long, content_asset_id long, current_path string, path_key string")
    resolved = spark.createDataFrame([("new/a", 9)], "path_key string, asset_id long")
    assert ingest.cross_volume_moves(resolved, instances, resolved).count() == 0
    assert ingest.cross_volume_moves(resolved, instances.filter("id = 1"), resolved).count() == 1


def test_store_and_stream(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "store"
    rows = [("r/a.jpg", 10, 1, "V", "1", "s1", "s1"), ("r/b.jpg", 10, 1, "V", "2", "s2", "s2")]
    ddl = "path string, size long, modified_ms long, volume_id string, file_id string, quick_fingerprint string, sha256 string"
    keyed = spark.createDataFrame(rows, ddl).withColumn("path_key", F.col("path"))
    keyed.write.parquet(str(source))
    store = Store(spark, str(folder))
    stream = spark.readStream.schema(keyed.schema).parquet(str(source))
    for _ in range(2):  # a second run finds nothing new
        start(stream, store, str(tmp_path / "check"), lambda epoch: datetime(2026, 1, 1 + epoch)).awaitTermination()
    assert sorted(r.path_key for r in store.read("file_instances").collect()) == ["r/a.jpg", "r/b.jpg"]
    assert [(r.new_count, r.started_at) for r in store.read("scan_runs").collect()] == [(2, datetime(2026, 1, 1))]


# what has no SQL: state in, state out

NOW = "2026-02-03 04:05:06"


def now():
    return F.to_timestamp(F.lit(NOW))


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)


def test_placed_numbers_all_and_groups(spark):
    frame = spark.createDataFrame([(i % 3, (i * 37) % 101) for i in range(101)], "g long, x long").repartition(5)
    assert rows(order.placed(frame, [], [F.col("x")], "at"), "x", "at") == sorted(((i, i) for i in range(101)), key=repr)
    got = rows(order.placed(frame, ["g"], [F.desc("x")], "at"), "g", "x", "at")
    for g in range(3):
        of_g = sorted(((x, at) for h, x, at in got if h == g), reverse=True)
        assert [at for _, at in of_g] == list(range(len(of_g)))


def test_job_log(spark):
    log = spark.createDataFrame([], schema("ai_jobs"))
    log = jobs.create(jobs.create(log, "train", now()), "download", now())
    log = jobs.update(log, 1, "running", 2, 9, "half", now())
    assert rows(log, "id", "job_type", "status", "done", "total", "message", F.col("started_at").isNotNull(), F.col("finished_at").isNotNull()) == [
        (1, "train", "running", 2, 9, "half", True, False), (2, "download", "pending", 0, 0, None, False, False),
    ]
    log = jobs.update(log, 1, "completed", 9, 9, None, now())
    assert rows(log.filter("id = 1"), "status", F.col("started_at").isNotNull(), F.col("finished_at").isNotNull()) == [("completed", True, True)]
    assert [r.id for r in jobs.newest(log, 1).collect()] == [2]
    assert [r.id for r in jobs.latest(log, "train").collect()] == [1] and [r.id for r in jobs.latest(log, only_open=True).collect()] == [2]
    assert rows(jobs.heal(log, "download", False, now()), "id", "status") == [(1, "completed"), (2, "failed")]
    assert rows(jobs.heal(log, "download", True, now()), "id", "status") == [(1, "completed"), (2, "pending")]


def test_votes(spark):
    votes = spark.createDataFrame([], schema("ai_preference_votes"))
    sets = spark.createDataFrame([(1, "one", None, None), (2, "two", None, None)], "id long, name string, created_at timestamp, updated_at timestamp")
    votes, sets = ranking.submit_vote(votes, sets, {"set_id": 2, "left_id": 7, "right_id": 8, "choice": "tie"}, now())
    votes, sets = ranking.submit_vote(votes, sets, {"set_id": 2, "left_id": 7, "right_id": 9, "choice": "skip"}, now())
    assert rows(votes, "id", "set_id", "left_id", "right_id", "choice", "weight") == [(1, 2, 7, 8, "tie", 1.0), (2, 2, 7, 9, "skip", 1.0)]
    assert rows(sets, "id", F.col("updated_at").isNotNull()) == [(1, False), (2, True)]
    with pytest.raises(ValueError, match="invalid preference choice"):
        ranking.submit_vote(votes, sets, {"set_id": 2, "left_id": 7, "right_id": 9, "choice": "both"}, now())
    empty = spark.createDataFrame([], "id long, active boolean")
    assert ranking.overview(sets, votes, 12, empty)["model_status"] == "untrained"
    assert ranking.overview(sets, votes, 3, empty)["model_status"] == "insufficient_data"
    assert ranking.overview(sets, votes, 3, spark.createDataFrame([(4, True)], empty.schema))["model_status"] == "ready"


def test_sets(spark):
    listing = spark.createDataFrame([(1, 5.0), (2, 9.0), (1, 7.0), (3, 1.0)], "asset_id long, q double")
    assert rows(ranking.create_set(listing, [F.desc("q")], 4), "set_id", "asset_id", "position") == [(4, 1, 1), (4, 2, 0), (4, 3, 2)]
    chosen = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "asset_id long, position long")
    assert rows(ranking.create_set(listing, [F.desc("q")], 4, chosen), "asset_id", "position") == [(1, 1), (3, 0)]
    sets = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 2))], "id long, created_at timestamp")
    items = spark.createDataFrame([(1, 5), (1, 6)], "set_id long, asset_id long")
    votes = spark.createDataFrame([(1,), (1,), (1,)], "set_id long")
    rankings = spark.createDataFrame([(1, datetime(2026, 3, 1))], "set_id long, ranked_at timestamp")
    assert [(r.set_id, r.n_items, r.n_votes) for r in ranking.list_sets(sets, items, votes, rankings).collect()] == [(1, 2, 3), (2, 0, 0)]
    left = ranking.delete_set(1, {"ai_sets": sets, "ai_set_items": items})
    assert rows(left["ai_sets"], "id") == [(2,)] and left["ai_set_items"].count() == 0


def test_ranked_items_show_live_images(spark):
    records = spark.createDataFrame(
        [(1, 10, "gone", False, "image"), (2, 10, "film", True, "video"), (3, 10, "b", True, "image"), (4, 10, "c", True, "image"), (5, 11, "d", True, "image")],
        "instance_id long, asset_id long, current_path string, exists_flag boolean, file_class string",
    )
    rated = spark.createDataFrame([(3, 2, 1), (4, 5, 2)], "instance_id long, rating int, event_id long")
    ranks_ = spark.createDataFrame([(1, 10, 2, "top"), (1, 11, 1, "mid"), (1, 12, 3, "mid")], "set_id long, asset_id long, rank_position long, rank_bucket string")
    assert [(r.asset_id, r.instance_id, r.rating) for r in ranking.ranked_items(ranks_, records, rated).collect()] == [(11, 5, None), (10, 3, 5), (12, None, None)]
    assert [r.asset_id for r in ranking.ranked_items(ranks_, records, rated, "mid").collect()] == [11, 12]


def test_train_and_rank(spark):
    vectors = [(i, [float(x) for x in np.eye(6)[i]]) for i in range(6)]
    embeddings = spark.createDataFrame(vectors, "asset_id long, embedding array<double>")
    votes = spark.createDataFrame([(0, 1, "left", 1.0), (2, 3, "right", 1.0), (4, 5, "tie", 0.1), (0, 5, "skip", 1.0)], "left_id long, right_id long, choice string, weight double")
    best = spark.createDataFrame([(0, 5), (1, 1)], "asset_id long, rating int")
    items = spark.createDataFrame([(1, i) for i in range(6)], "set_id long, asset_id long")
    net, found, ranks_ = ranking.train_and_rank(embeddings, votes, best, items)
    assert found["preference_pair_count"] == 3 and found["tie_pair_count"] == 1 and found["preference_accuracy"] == 1.0
    place = {r.asset_id: r.rank_position for r in ranks_.collect()}
    assert place[0] < place[1] and place[3] < place[2]
    kept = spark.createDataFrame([(1, 1, 9, 0.5, 1), (2, 1, 9, 0.5, 1), (1, 2, 9, 0.5, 1)], "set_id long, model_run_id long, asset_id long, score double, rank_position long")
    kept = kept.withColumn("ranked_at", now())
    out = ranking.replace_rankings(kept, ranks_, 1, now())
    assert out.groupBy("set_id", "model_run_id").count().count() == 3 and out.count() == 6 + 2
    with pytest.raises(ValueError, match="no ranking samples"):
        ranking.train_and_rank(embeddings, votes.limit(0), best.limit(0), items)


def test_training_in_tasks_is_training_on_all_rows(spark):
    rng = np.random.default_rng(6)
    x, rating = rng.normal(size=(90, 6)), rng.integers(1, 6, 90)
    embeddings = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, [1.0])], "asset_id long, embedding array<double>")
    rated = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rating)] + [(500, 3), (501, 5)], "asset_id long, rating int")
    samples = learning.samples_of(embeddings.repartition(3), rated)
    for kind in (learning.LinearHead, learning.MlpHead):
        (one, found), (two, want) = kind.fit(samples, epochs=9), kind.train(x, rating, epochs=9)
        assert np.allclose(one.score(x), two.score(x), atol=1e-12) and found == pytest.approx(want)
        with pytest.raises(ValueError):
            kind.fit(samples.limit(0))
    a, b, weight, tie = x[:40], x[40:80], rng.random(40), rng.random(40) < 0.3
    pairs = [([float(v) for v in p], [float(v) for v in q], float(w), bool(t)) for p, q, w, t in zip(a, b, weight, tie)]
    net, found = ranking.PairwiseNet.fit(spark.createDataFrame(pairs, "x array<double>, y array<double>, weight double, tie boolean").repartition(3), epochs=9)
    plain = ranking.PairwiseNet.new(6)
    assert found == pytest.approx(plain.train(a, b, weight, tie, epochs=9)) and np.allclose(net.score(x), plain.score(x), atol=1e-12)


def test_logged_pipeline(spark, tmp_path):
    empty = lambda t: spark.createDataFrame([], schema(t))
    state = {t: empty(t) for t in ("image_embeddings", "ai_models", "ai_predictions", "ai_jobs")}
    assets = spark.createDataFrame([(i, float(i)) for i in range(1, 8)], "asset_id long, q double")
    rated = spark.createDataFrame([(1, 5), (2, 1), (3, 4), (9, 3)], "asset_id long, rating int")
    encode, saved = F.array(F.col("q"), F.lit(1.0)), []

    def save(head):
        head.save(tmp_path / "head.json")
        saved.append(head)
        return str(tmp_path / "head.json")

    few = learning.run_full_pipeline(state, assets, rated.limit(2), encode, "stub", "1", now(), save)
    assert rows(few["ai_jobs"], "id", "status") == [(1, "completed")] and "2 rated" in few["ai_jobs"].first().message and few["ai_models"].count() == 0
    assert few["image_embeddings"].count() == 7
    out = learning.run_full_pipeline(few, assets, rated, encode, "stub", "1", now(), save)
    assert rows(out["ai_jobs"], "id", "status", "done") == [(1, "completed", 0), (2, "completed", 7)] and len(saved) == 1
    assert rows(out["ai_models"], "id", "active", "head_type") == [(1, True, "mlp")] and out["image_embeddings"].count() == 7
    scores = {r.content_asset_id: r.ai_score for r in out["ai_predictions"].collect()}
    head = learning.MlpHead.load(tmp_path / "head.json")
    assert all(abs(scores[i] - head.score(np.array([[float(i), 1.0]]))[0]) < 1e-6 for i in range(1, 8))
    failed = learning.run_full_pipeline(out, assets, rated, F.raise_error(F.lit("no encoder")).cast("array<double>"), "clip", "2", now(), save)
    assert failed["ai_jobs"].orderBy(F.desc("id")).first().status == "failed" and failed["ai_models"].count() == 1


def test_learning_state(spark, tmp_path):
    embeddings = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 7)], "asset_id long, embedding array<double>")
    rated = spark.createDataFrame([(1, 5), (2, 1), (3, 0), (4, 3)], "asset_id long, rating int")
    ids, x, y = learning.training_set(embeddings, rated)
    assert sorted(ids) == [1, 2, 4] and len(x) == len(y) == 3 and len(learning.training_set(embeddings, rated, 2)[0]) == 2
    none = spark.createDataFrame([], "asset_id long, ai_score double, ai_confidence double, ai_bucket string, delete_candidate boolean")
    old = spark.createDataFrame([(1, 0.5, 0.0, "maybe", False)], none.schema)
    head, out = learning.full_pipeline(embeddings, rated, old)
    assert head is not None and out.count() == 6 and rows(out.filter("asset_id = 1"), "ai_score") == [(0.5,)]
    assert learning.full_pipeline(embeddings, rated.limit(0), old)[0] is None
    linear = learning.predict_missing(embeddings, old, learning.LinearHead(np.array([0.1, -0.2]), 0.3))
    want = {i: 1 / (1 + np.exp(-(0.1 * i - 0.2 + 0.3))) for i in range(2, 7)}
    assert all(abs(r.ai_score - want[r.asset_id]) < 1e-12 for r in linear.filter("asset_id > 1").collect())
    left, deleted = learning.clear_predictions(out)
    assert left.count() == 0 and deleted.first()[0] == 6
    models = spark.createDataFrame([(1, True), (2, False)], "id long, active boolean")
    models = learning.activate(models, spark.createDataFrame([(3,)], "id long"))
    assert rows(models) == [(1, False), (2, False), (3, True)] and rows(learning.active_model(models), "id") == [(3,)]
    assert learning.active_encoder(None) == "stub"
    (tmp_path / "m.onnx").write_text("")
    assert learning.active_encoder(str(tmp_path / "m.onnx")) == "clip_vitb32"
    assets = spark.createDataFrame([(1,), (2,)], "asset_id long")
    have = spark.createDataFrame([(1, "stub", "1", [9.0]), (2, "stub", "0", [8.0])], schema("image_embeddings"))
    assert rows(learning.missing_embeddings(assets, have, "stub", "1")) == [(2,)]
    encode = F.array(F.col("asset_id").cast("float"))
    assert rows(learning.extract(assets, have, encode, "stub", "1")) == [(1, "stub", "1", [9.0]), (2, "stub", "0", [8.0]), (2, "stub", "1", [2.0])]
    assert rows(learning.extract(assets, have, encode, "stub", "1", False).filter("encoder_version = '1'"), "embedding") == [([1.0],), ([2.0],)]


def test_learning_status(spark):
    instances = spark.createDataFrame([(1, True, "image"), (2, False, "image"), (3, True, "video")], "id long, exists_flag boolean, file_class string")
    rated = spark.createDataFrame([(1, 0), (2, 4), (3, 5), (9, 5)], "file_instance_id long, rating int")
    have = spark.createDataFrame([(1, "stub", "1", [1.0]), (2, "stub", "0", [1.0])], schema("image_embeddings"))
    found = spark.createDataFrame([(1, 3), (2, 3), (1, 2)], "asset_id long, model_id long")
    models = spark.createDataFrame([(2, True), (3, True), (4, False)], "id long, active boolean")
    log = spark.createDataFrame([(1, "running"), (2, "failed")], "id long, status string")
    got = learning.status(instances.select("id"), have, rated, instances, found, models, log, "stub", "1").first().asDict()
    assert got == {"n_assets": 3, "n_embeddings": 1, "n_rated": 2, "n_rated_images": 1, "n_predictions": 2, "active_model_id": 3, "running_job_id": 1, "latest_job_id": 2}


def test_recycle_rated(spark):
    empty = lambda t: spark.createDataFrame([], schema(t))
    instances = ingest.fitted(spark.createDataFrame([(1, 5, "a", True, "image"), (2, 5, "b", True, "image"), (3, 6, "v", True, "video")],
                              "id long, content_asset_id long, current_path string, exists_flag boolean, file_class string"), empty("file_instances"))
    groups = ingest.fitted(spark.createDataFrame([(1, "exact:5", "exact", "pending")], "id long, anchor string, kind string, status string"), empty("match_groups"))
    members = ingest.fitted(spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "group_id long, file_instance_id long, content_asset_id long"), empty("group_members"))
    assets = ingest.fitted(spark.createDataFrame([(5,), (6,)], "id long"), empty("content_assets"))
    state = {"file_instances": instances, "rating_events": empty("rating_events"), "match_groups": groups, "group_members": members, "content_assets": assets}
    out = ratings.recycle_rated(state, 1, now())
    assert rows(out["file_instances"], "id", "exists_flag", F.col("last_seen_at").isNotNull()) == [(1, False, True), (2, True, False), (3, True, False)]
    assert rows(ratings.current(out["rating_events"]), "file_instance_id", "rating") == [(1, 0)]
    assert out["match_groups"].count() == 0 and out["group_members"].count() == 0 and rows(out["recycle_plan"]) == [(1, "a")]
    for gone in (3, 9):
        with pytest.raises(ValueError, match="not found"):
            ratings.recycle_rated(out, gone, now())
    with pytest.raises(ValueError, match="not found"):
        ratings.recycle_rated(out, 1, now())


def test_review_reads(spark):
    groups = spark.createDataFrame([(1, "exact", "pending", 2, 10), (2, "similar", "applied", None, 20)],
                                   "id long, kind string, status string, recommended_keep_instance_id long, updated_at long")
    members = spark.createDataFrame([(1, 1, 5, 1.0, "duplicate"), (1, 2, 5, 1.0, "recommended_keep"), (2, 1, 5, 0.9, "duplicate")],
                                    "group_id long, file_instance_id long, content_asset_id long, similarity double, role string")
    instances = spark.createDataFrame([(1, "a", True, 5), (2, "b", True, 5)], "id long, current_path string, exists_flag boolean, content_asset_id long")
    listed = review.list_groups(groups, members, instances=instances).collect()
    assert [(r.id, r.n_members, r.recommended_path) for r in listed] == [(2, 1, None), (1, 2, "b")]
    assets = spark.createDataFrame([(5, 7.0, 3, 4)], "id long, quality_score double, width int, height int")
    rated = spark.createDataFrame([(2, 4)], "file_instance_id long, rating int")
    assert [(r.current_path, r.rating) for r in review.group_detail(1, members, instances, assets, rated).collect()] == [("a", None), ("b", 4)]
    assert rows(review.default_recycle(members.withColumn("kind", F.lit("exact"))), "group_id", "file_instance_id") == [(1, 1), (2, 1)]
    assert review.default_recycle(members.withColumn("kind", F.lit("raw_jpeg_set"))).count() == 0
    actions = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "id long, created_at long")
    assert [r.id for r in review.list_actions(actions).collect()] == [3, 2, 1]
    moves = spark.createDataFrame([(1, "x", "y", 1), (1, "y", "z", 2), (9, "q", "r", 3)], "file_instance_id long, old_path string, new_path string, detected_at long")
    assert [r.new_path for r in review.lookup_history(moves, instances, 5).collect()] == ["z", "y"]


def test_apply_decision(spark):
    empty = lambda t: spark.createDataFrame([], schema(t))
    fitted = lambda data, ddl, t: ingest.fitted(spark.createDataFrame(data, ddl), empty(t))
    state = {
        "file_instances": fitted([(1, 5, "a", True), (2, 5, "b", True), (3, 6, "c", True)], "id long, content_asset_id long, current_path string, exists_flag boolean", "file_instances"),
        "match_groups": fitted([(1, "exact", "pending"), (2, "similar", "pending")], "id long, kind string, status string", "match_groups"),
        "group_members": fitted([(1, 1), (1, 2), (2, 2), (2, 3)], "group_id long, file_instance_id long", "group_members"),
        "content_assets": fitted([(5,), (6,)], "id long", "content_assets"),
        "review_actions": empty("review_actions"),
    }
    out = review.apply_decision(state, 1, [1], [2], "why", 7, now())
    assert rows(out["match_groups"], "id", "status", "recommended_keep_instance_id") == [(1, "applied", 1)]
    assert rows(out["group_members"], "group_id", "file_instance_id") == [(1, 1)]
    assert rows(out["review_actions"], "id", "group_id", "keep_ids", "recycle_ids", "note") == [(7, 1, [1], [2], "why")]
    assert rows(out["recycle_plan"]) == [(2, "b")] and rows(out["file_instances"], "id", "exists_flag") == [(1, True), (2, False), (3, True)]
    with pytest.raises(ValueError, match="a file is not in the group"):
        review.apply_decision(state, 1, [1], [3], None, 8, now())


RECORD = "instance_id long, asset_id long, current_path string, quality double, width int, height int, phash long"


def test_representatives_and_pairs(spark):
    records = spark.createDataFrame([(1, 5, "b", 3.0, 1, 1, None), (2, 5, "a", 2.0, 1, 1, 9), (3, 5, "0", 2.0, 1, 1, 8), (4, 6, "c", None, 1, 1, 7)], RECORD)
    assert rows(matching.representatives(records, ["phash"]), "instance_id") == [(3,), (4,)]
    found = spark.createDataFrame([(9, 9), (9, 11), (9, 2), (4, 4), (4, 5)], "anchor_id long, asset_id long")
    assert rows(matching.similar_anchor(found), "anchor_id", "anchor", "n_members") == [(4, "similar:4-5", 2), (9, "similar:2-9-11", 3)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a long, b long")
    cached = spark.createDataFrame([(1, 2, 0.98), (4, 5, 0.99)], "a long, b long, similarity double")
    todo, reused = matching.incremental_pairs(pairs, spark.createDataFrame([(3,)], "asset_id long"), cached)
    assert rows(todo) == [(1, 3), (2, 3)] and rows(reused) == [(1, 2, 0.98), (4, 5, 0.99)]


def test_recompute(spark):
    """Drafts against groups: new, replaced, archived, kept and dropped ones; an incremental run keeps what it did not touch."""
    records = spark.createDataFrame([(1, 5, "r/a.jpg", 3.0, 10, 10, 1), (2, 5, "r/b.jpg", 4.0, 10, 10, 1), (3, 6, "r/c.jpg", 1.0, 10, 10, 1),
                                     (4, 6, "s/c.jpg", 1.0, 10, 10, 1), (5, 7, "r/d.jpg", 2.0, 10, 10, 1)], RECORD)
    cliques_ = spark.createDataFrame([(5, 5, 0.98), (5, 7, 0.98)], "anchor_id long, asset_id long, similarity double")
    drafts = matching.exact_drafts(records).unionByName(matching.similar_drafts(cliques_, records))
    assert rows(drafts.filter("kind = 'similar'"), "anchor", "instance_id", "role") == [
        ("similar:5-7", 1, "duplicate"), ("similar:5-7", 2, "recommended_keep"), ("similar:5-7", 5, "duplicate")
    ]
    groups = spark.createDataFrame(
        [(1, "exact:5", "exact", "approved", 9), (2, "exact:6", "exact", "applied", 9), (3, "exact:8", "exact", "applied", 9),
         (4, "exact:9", "exact", "pending", 9), (5, "similar:1-2", "similar", "pending", 9), (6, "similar:3-7", "similar", "skipped", 9)],
        "id long, anchor string, kind string, status string, recommended_keep_instance_id long",
    )
    members = spark.createDataFrame([(i, 100 + i, a, 0.5, "old") for i, a in ((1, 5), (2, 6), (3, 8), (4, 9), (5, 1), (6, 7))],
                                    "group_id long, file_instance_id long, content_asset_id long, similarity double, role string")
    out, held = matching.recompute(drafts, groups, members, None, "t1")
    assert rows(out) == [
        (1, "exact:5", "exact", "approved", 2), (2, "exact:6#applied:2:t1", "exact", "applied", 9), (3, "exact:8", "exact", "applied", 9),
        (7, "exact:6", "exact", "pending", 3), (8, "similar:5-7", "similar", "pending", 2),
    ]
    assert rows(held, "group_id", "file_instance_id", "role") == [
        (1, 1, "duplicate"), (1, 2, "recommended_keep"), (2, 102, "old"), (3, 103, "old"), (7, 3, "recommended_keep"), (7, 4, "duplicate"),
        (8, 1, "duplicate"), (8, 2, "recommended_keep"), (8, 5, "duplicate"),
    ]
    new = spark.createDataFrame([(7,)], "asset_id long")
    out, held = matching.recompute(drafts, groups, members, new, "t1")
    assert rows(out, "id") == [(1,), (2,), (3,), (5,), (7,), (8,)] and (5, 105) in rows(held, "group_id", "file_instance_id")


def test_resume_and_cancel(spark):
    empty = lambda t: spark.createDataFrame([], schema(t))
    ddl = "path string, size long, modified_ms long, volume_id string, file_id string, quick_fingerprint string, sha256 string"
    seen = spark.createDataFrame([(f"r/{n}.jpg", 1, 1, "V", n, n, n) for n in "abc"], ddl)
    runs = ingest.fitted(spark.createDataFrame([(1, "running"), (2, "running"), (3, "completed")], "id long, status string"), empty("scan_runs"))
    queue = ingest.enqueue(ingest.classified(seen.filter("path != 'r/c.jpg'")), 2)
    queue = ingest.promote(queue, spark.createDataFrame([(2, "r/a.jpg")], "scan_run_id long, path_key string"))
    assert rows(queue, "path_key", "stage") == [("r/a.jpg", "promoted"), ("r/b.jpg", "discovered")]
    assert rows(ingest.resume_candidate(runs, queue), "id") == [(2,)]
    run_id, out, after, left = ingest.resume(seen, empty("file_instances"), empty("content_assets"), runs, queue, now())
    assert run_id == 2 and rows(out["files"], "path_key", "disposition") == [("r/b.jpg", "new")]
    assert rows(after, "id", "status") == [(1, "running"), (2, "completed"), (3, "completed")]
    assert rows(left, "stage") == [("promoted",), ("promoted",)]
    assert ingest.resume(seen, empty("file_instances"), empty("content_assets"), after, left, now())[0] is None
    stopped = ingest.cancel(spark, 2, runs)
    assert rows(stopped, "id", "status") == [(1, "running"), (2, "cancelled"), (3, "completed")]
    assert ingest.resume_candidate(stopped, queue).count() == 0
    groups = []
    context = spark.sparkContext
    with ingest.grouped(spark, 77):
        groups.append(context.getLocalProperty("spark.jobGroup.id"))
    ingest.scan(seen, empty("file_instances"), empty("content_assets"), ["r"], 77, now())
    assert groups == [ingest.job_group(77)] and context.getLocalProperty("spark.jobGroup.id") is None  # later jobs are not the run's


def test_known_content_takes_the_fast_path(spark):
    ddl = "path string, size long, modified_ms long, volume_id string, file_id string, quick_fingerprint string, sha256 string"
    assets = ingest.fitted(spark.createDataFrame([(9, "s", 1, "q", 2), (10, "t", 1, "q", 1)], "id long, sha256 string, file_size long, quick_fingerprint string, analysis_version int"),
                           spark.createDataFrame([], schema("content_assets")))
    seen = spark.createDataFrame([("r/a.jpg", 1, 1, "V", "1", "q", "s"), ("r/b.jpg", 1, 1, "V", "2", "q", "t"), ("r/c.jpg", 1, 1, "V", "3", "q", "u")], ddl)
    out = ingest.scan(seen, spark.createDataFrame([], schema("file_instances")), assets, ["r"], 1, now())
    assert rows(out["files"], "path_key", "asset_id", "disposition") == [("r/a.jpg", 9, "new"), ("r/b.jpg", 10, "new"), ("r/c.jpg", 11, "new")]
    assert rows(out["content_assets"], "id", "analysis_version") == [(10, 2), (11, 2), (9, 2)]


def test_only_changed_files_are_read(spark, tmp_path):
    for name, body in (("a.jpg", b"one"), ("b.jpg", b"two"), ("c.txt", b"three")):
        (tmp_path / name).write_bytes(body)
    roots = ingest.checked_roots([str(tmp_path), f" {tmp_path} ", ""])
    assert roots == [str(tmp_path)]
    for bad in ([str(tmp_path / "none")], [str(tmp_path / "a.jpg")], []):
        with pytest.raises(ValueError):
            ingest.checked_roots(bad)
    whole = files.manifest(spark, roots)
    assert whole.filter("sha256 IS NULL").count() == 0
    known = whole.select("path_key", F.col("size").alias("file_size"), "modified_ms", F.lit(True).alias("exists_flag"), F.lit(2).alias("analysis_version"))
    known = spark.createDataFrame(known.collect(), known.schema)
    assert files.manifest(spark, roots, instances=known).filter("sha256 IS NOT NULL").count() == 0
    (tmp_path / "b.jpg").write_bytes(b"two, changed")
    again = files.manifest(spark, roots, instances=known)
    assert again.count() == 3 and [r.path.rsplit("/", 1)[1] for r in again.filter("sha256 IS NOT NULL").collect()] == ["b.jpg"]


def test_store_rewrites_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ddl = "scan_run_id long, extension string, n long, example_path string"
    store.commit({"unknown_formats": spark.createDataFrame([(1, "zip", 1, "a"), (2, "zip", 2, "b")], ddl)})
    store.rewrite_partition("unknown_formats", spark.createDataFrame([(2, "rar", 5, "c"), (3, "7z", 1, "d")], ddl), "scan_run_id")
    assert rows(store.read("unknown_formats"), "scan_run_id", "extension") == [(1, "zip"), (2, "rar"), (3, "7z")]


def test_text_and_json(spark):
    frame = spark.createDataFrame([("Holiday in ROME", "[3, 1]"), ("work", None)], "p string, ids string")
    assert [r.p for r in frame.filter(paths.text_filter("rome", F.col("p"))).collect()] == ["Holiday in ROME"]
    got = [r[0] for r in frame.select(paths.ids_from_json(F.col("ids"))).collect()]
    assert got == [[3, 1], []]
    back = frame.select(paths.ids_to_json(paths.ids_from_json(F.col("ids")))).collect()
    assert [r[0] for r in back] == ["[3,1]", "[]"]
    vectors = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    packed = vectors.select("v", to_bytes("v").alias("b")).select("v", "b", from_bytes("b").alias("w")).collect()
    assert bytes(packed[0].b) == struct.pack("<2f", 1.5, -2.0) and all(r.v == r.w for r in packed)
