"""Preference ranking: sets, pairs to vote on, training samples, and ranks with uncertainty."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.operators.learning import logistic, start_weights, unit
from darkroom.operators.order import placed, values_at
from darkroom.operators.ratings import latest_per_asset
from darkroom.operators.training import descend, summed
from darkroom.sources.scratch import materialize, owned, release

GAPS = (1, 2, 4, 8, 16, 32)
CHOICES = ("left", "right", "tie", "skip")


@owned
def ranked(scores: DataFrame) -> DataFrame:
    """Ranks of (set_id, asset_id, score): rank_position, percentile, score_gap, rank_bucket, uncertainty_bucket.

    The gap is to the nearer neighbour in score.  Buckets: percentile at most 20 top, at least 80
    back.  The low gaps are uncertain: cut-offs are the nearest-rank 0.35 and 0.70 quantiles of the
    set's gaps, found by counting (see :func:`darkroom.operators.order.values_at`).  Ties go by asset.  Places are dealt by range, so a set of any size is spread over tasks.
    """
    by_score = [F.desc("score"), F.col("asset_id")]
    rows = materialize(placed(scores.select("set_id", "asset_id", "score"), ["set_id"], by_score, "at"))
    sizes = materialize(rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")))
    above = rows.select("set_id", (F.col("at") + 1).alias("at"), F.col("score").alias("above"))
    below = rows.select("set_id", (F.col("at") - 1).alias("at"), F.col("score").alias("below"))
    out = rows.join(above, ["set_id", "at"], "left").join(below, ["set_id", "at"], "left").join(sizes, "set_id")
    gap = F.least(F.col("above") - F.col("score"), F.col("score") - F.col("below"))
    out = out.withColumn("score_gap", F.coalesce(gap, F.lit(0.0))).drop("above", "below")
    out = materialize(out)
    of = lambda name, q: sizes.select("set_id", F.lit(name).alias("name"), F.floor((F.col("n") - 1) * q + 0.5).cast("long").alias("place"))
    found = values_at(out, ["set_id"], "score_gap", of("low", 0.35).unionAll(of("high", 0.70)))
    picked = lambda name: F.max(F.when(F.col("name") == name, F.col("at"))).alias(name)
    cuts = materialize(found.groupBy("set_id").agg(picked("low"), picked("high")))
    out = out.join(cuts, "set_id")
    out = out.withColumn("rank_position", F.col("at") + 1).withColumn("percentile", F.col("rank_position") * 100.0 / F.col("n"))
    bucket = F.when(F.col("percentile") <= 20, "top").when(F.col("percentile") >= 80, "back").otherwise("mid")
    uncertain = F.when(F.col("score_gap") <= F.col("low"), "high").when(F.col("score_gap") <= F.col("high"), "medium").otherwise("low")
    return out.withColumn("rank_bucket", bucket).withColumn("uncertainty_bucket", uncertain).drop("at", "low", "high")


def bucket_counts(rankings: DataFrame) -> DataFrame:
    """Per set: n_items, n_top, n_back, n_uncertain_high, n_uncertain_medium."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return rankings.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        is_("rank_bucket", "top").alias("n_top"),
        is_("rank_bucket", "back").alias("n_back"),
        is_("uncertainty_bucket", "high").alias("n_uncertain_high"),
        is_("uncertainty_bucket", "medium").alias("n_uncertain_medium"),
    )


def create_set(rows: DataFrame, order: list, set_id: int, chosen: DataFrame | None = None) -> DataFrame:
    """(set_id, asset_id, position): the distinct assets of a listing in its order, from 0.

    ``chosen`` (asset_id, position), if given and not empty, is an explicit selection and counts
    instead of the listing; an asset chosen twice keeps its first place.
    """
    if chosen is not None and not chosen.isEmpty():
        place = chosen.groupBy("asset_id").agg(F.min("position").alias("_n"))
    else:
        place = placed(rows, [], order, "_n").groupBy("asset_id").agg(F.min("_n").alias("_n"))
    out = placed(place, [], [F.col("_n"), F.col("asset_id")], "position")
    return out.select(F.lit(set_id).cast("long").alias("set_id"), "asset_id", "position")


def list_sets(sets: DataFrame, items: DataFrame, votes: DataFrame, rankings: DataFrame) -> DataFrame:
    """Sets with item and vote counts and the last ranking, most recently used first."""
    n = items.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_items"))
    v = votes.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_votes"))
    r = rankings.groupBy("set_id").agg(F.max("ranked_at").alias("last_ranked_at"))
    out = sets.withColumnRenamed("id", "set_id").join(n, "set_id", "left").join(v, "set_id", "left").join(r, "set_id", "left")
    out = out.fillna(0, ["n_items", "n_votes"])
    return out.orderBy(F.coalesce("last_ranked_at", "created_at").desc(), F.desc("set_id"))


def neighbour_pairs(items: DataFrame, gaps: tuple[int, ...] = GAPS) -> DataFrame:
    """Pairs (set_id, left_id, right_id, gap, idx) of items (set_id, asset_id, idx) ``gap`` places apart."""
    left = items.select("set_id", F.col("asset_id").alias("left_id"), "idx", F.explode(F.array(*map(F.lit, gaps))).alias("gap"))
    right = items.select("set_id", F.col("asset_id").alias("right_id"), F.col("idx").alias("_to"))
    met = left.withColumn("_to", F.col("idx") + F.col("gap")).join(right, ["set_id", "_to"])
    return met.select("set_id", "left_id", "right_id", "gap", "idx")


def preference_tasks(items: DataFrame, votes: DataFrame, count: int) -> DataFrame:
    """The first pairs to vote on: near ones first, without those seen, skipped ones included."""
    seen = votes.select("set_id", F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).distinct()
    pairs = neighbour_pairs(items).withColumn("a", F.least("left_id", "right_id")).withColumn("b", F.greatest("left_id", "right_id"))
    fresh = pairs.join(seen, ["set_id", "a", "b"], "left_anti").drop("a", "b")
    ranks = items.select("set_id", F.col("asset_id").alias("left_id"), (F.col("ranked") if "ranked" in items.columns else F.lit(False)).alias("ranked"))
    source = F.when(F.col("ranked"), "ranking_refine").otherwise("cold_start")
    out = fresh.join(ranks, ["set_id", "left_id"]).withColumn("source", source).drop("ranked")
    return out.orderBy("gap", "idx", "set_id").limit(max(count, 1))


def submit_vote(votes: DataFrame, sets: DataFrame, vote: dict, now: Column) -> tuple[DataFrame, DataFrame]:
    """Votes with ``vote`` (set_id, left_id, right_id, choice) of weight 1, and sets with its set used ``now``.

    Raises ValueError for a choice that is none of the four.
    """
    if vote["choice"] not in CHOICES:
        raise ValueError("invalid preference choice")
    new = votes.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", *(F.lit(vote[c]).cast("long").alias(c) for c in ("set_id", "left_id", "right_id")),
        F.lit(vote["choice"]).alias("choice"), F.lit(1.0).alias("weight"), now.alias("created_at"),
    )
    used = F.when(F.col("id") == vote["set_id"], now).otherwise(F.col("updated_at"))
    return votes.unionByName(new), sets.withColumn("updated_at", used)


def vote_samples(votes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(better_id, worse_id, weight, tie) of votes on two embedded assets; skips drop out; ties weigh at least 0.4."""
    have = embeddings.select("asset_id")
    good = votes.filter("choice IN ('left', 'right', 'tie')")
    good = good.join(have.withColumnRenamed("asset_id", "left_id"), "left_id", "left_semi")
    good = good.join(have.withColumnRenamed("asset_id", "right_id"), "right_id", "left_semi")
    right = F.col("choice") == "right"
    tie = F.col("choice") == "tie"
    return good.select(
        F.when(right, F.col("right_id")).otherwise(F.col("left_id")).alias("better_id"),
        F.when(right, F.col("left_id")).otherwise(F.col("right_id")).alias("worse_id"),
        F.when(tie, F.greatest("weight", F.lit(0.4))).otherwise(F.col("weight")).alias("weight"),
        tie.alias("tie"),
    )


@owned
def star_pairs(best: DataFrame) -> DataFrame:
    """(better_id, worse_id, weight) of assets (asset_id, rating) at least two stars apart.

    The asset at place i of its level meets, of each lower level, those at places i and i + 1,
    cyclically; a level of one gives one.
    """
    at_level = materialize(placed(best, ["rating"], [F.col("asset_id")], "idx"))
    sizes = best.groupBy("rating").agg(F.count(F.lit(1)).alias("size"))  # one row per level
    high = at_level.filter("rating >= 2").select(F.col("asset_id").alias("better_id"), F.col("rating").alias("high"), "idx")
    low_level = sizes.select(F.col("rating").alias("low"), "size")
    steps = F.explode(F.sequence(F.lit(0), F.least(F.lit(2), F.col("size")).cast("int") - 1))
    picks = high.join(F.broadcast(low_level), F.col("low") <= F.col("high") - 2).withColumn("k", steps)
    picks = picks.withColumn("at", F.pmod(F.col("idx") + F.col("k"), F.col("size")))
    low = at_level.select(F.col("asset_id").alias("worse_id"), F.col("rating").alias("low"), F.col("idx").alias("at"))
    weight = F.least(F.lit(0.5), F.greatest(F.lit(0.2), 0.2 + 0.1 * (F.col("high") - F.col("low") - 2)))
    return picks.join(low, ["low", "at"]).select("better_id", "worse_id", F.round(weight, 6).alias("weight"))


def model_status(active: bool, votes: int, rated: int) -> str:
    if active:
        return "ready"
    return "untrained" if votes >= 4 or rated >= 12 else "insufficient_data"


def delete_set(set_id: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the rows of a set."""
    return {name: t.filter(F.col("id" if name == "ai_sets" else "set_id") != set_id) for name, t in tables.items()}


def ranked_items(rankings: DataFrame, records: DataFrame, ratings: DataFrame, bucket: str | None = None) -> DataFrame:
    """Ranked assets with their live image of the least id and its rating; no bucket means all.

    ``records`` has instance_id, asset_id, current_path, exists_flag and file_class.
    """
    if bucket is not None:
        rankings = rankings.filter(F.col("rank_bucket") == bucket)
    out = rankings.join(set_photos(rankings.select("asset_id").distinct(), records, ratings), "asset_id", "left")
    return out.orderBy("set_id", "rank_position")


def set_photos(assets: DataFrame, records: DataFrame, ratings: DataFrame) -> DataFrame:
    """(asset_id, instance_id, current_path, rating): each asset's live image of the least id and its latest rating."""
    live = records.filter("exists_flag AND file_class = 'image'").join(assets, "asset_id", "left_semi")
    files = live.groupBy("asset_id").agg(F.min_by(F.struct("instance_id", "current_path"), "instance_id").alias("f"))
    shown = files.select("asset_id", "f.instance_id", "f.current_path")
    return shown.join(latest_per_asset(ratings, records), "asset_id", "left")


def overview(sets: DataFrame, votes: DataFrame, rated_images: int, runs: DataFrame) -> dict:
    """Counts of sets and votes, the active run's id and the state of the ranking model."""
    n_sets, n_votes = (t.agg(F.count(F.lit(1))).first()[0] for t in (sets, votes))
    active = runs.filter("active").agg(F.max("id")).first()[0]
    state = model_status(active is not None, n_votes, rated_images)
    return {"set_count": n_sets, "vote_count": n_votes, "rated_count": rated_images, "active_run_id": active, "model_status": state}


@dataclass
class PairwiseNet:
    """Score of a unit vector by one hidden ReLU layer, trained on preferences and ties."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def new(cls, dimension: int) -> PairwiseNet:
        hidden = int(np.clip(dimension // 16, 16, 64))
        one, two = start_weights(hidden, dimension, (0.28, 0.25), (97, 193))  # fixed values
        return cls(one, np.zeros(hidden), two, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1.T + self.b1, 0) @ self.w2 + self.b2

    def terms(self, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Sums over preferences and ties that a step needs."""
        a, b, tie = unit(better), unit(worse), tie.astype(bool)
        pre_a, pre_b = a @ self.w1.T + self.b1, b @ self.w1.T + self.b1
        apart = np.maximum(pre_a, 0) - np.maximum(pre_b, 0)
        gap = apart @ self.w2
        pull = weight * np.where(tie, gap, logistic(gap) - 1)
        back_a, back_b = (pull[:, None] * self.w2 * (pre > 0) for pre in (pre_a, pre_b))
        return np.concatenate([(back_a.T @ a - back_b.T @ b).ravel(), (back_a - back_b).sum(axis=0), pull @ apart])

    def stepped(self, total: np.ndarray, n: int, rate: float = 0.02, decay: float = 0.0004) -> PairwiseNet:
        one, two, three = np.split(total / n, np.cumsum([self.w1.size, self.b1.size]))
        w1 = self.w1 - rate * (one.reshape(self.w1.shape) + decay * self.w1)
        return PairwiseNet(w1, self.b1 - rate * two, self.w2 - rate * (three + decay * self.w2), self.b2)

    def losses(self, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Sums of the loss of preferences and of ties, preferences met, preferences and ties."""
        gap, tie = self.score(better) - self.score(worse), tie.astype(bool)
        pairwise, squared = (np.log1p(np.exp(-gap)) * weight)[~tie].sum(), (0.5 * gap**2 * weight)[tie].sum()
        return np.array([pairwise, squared, (gap[~tie] > 0).sum(), (~tie).sum(), tie.sum()], dtype=np.float64)

    def train(self, better: np.ndarray, worse: np.ndarray, weight: np.ndarray, tie: np.ndarray, epochs: int = 90) -> dict[str, float]:
        """Gradient descent on the mean over all samples of the weighted logistic loss on score differences
        of preferences and half the squared difference of ties; returns the metrics of the two."""
        if not len(better):
            raise ValueError("no ranking samples")
        net = self
        for _ in range(epochs):
            net = net.stepped(net.terms(better, worse, weight, tie), len(better))
        self.w1, self.b1, self.w2 = net.w1, net.b1, net.w2
        return measured(self.losses(better, worse, weight, tie))

    @classmethod
    def fit(cls, samples: DataFrame, epochs: int = 90) -> tuple[PairwiseNet, dict[str, float]]:
        """:meth:`train` on ``samples`` (x, y, weight, tie: vectors of the better and the worse), whose sums are taken in tasks."""
        size = samples.agg(F.max(F.size("x"))).first()[0]
        if not size:
            raise ValueError("no ranking samples")
        rows = samples.filter((F.size("x") == size) & (F.size("y") == size)).select("x", "y", "weight", F.col("tie").cast("double").alias("tie"))
        net = descend(rows, cls.new(size), lambda net, *columns: net.terms(*columns), lambda net, total, n: net.stepped(total, n), epochs)
        return net, measured(summed(rows, net, lambda net, *columns: net.losses(*columns)))

    def save(self, path: Path) -> None:
        path.write_text(json.dumps({k: np.asarray(v).tolist() for k, v in self.__dict__.items()}, indent=2))

    @classmethod
    def load(cls, path: Path) -> PairwiseNet:
        held = json.loads(path.read_text())
        return cls(*(np.array(held[k]) for k in ("w1", "b1", "w2")), held["b2"])


def measured(sums: np.ndarray) -> dict[str, float]:
    """The metrics of :meth:`PairwiseNet.losses`."""
    pairwise, squared, met, some, ties = sums
    return {
        "pairwise_loss": float(pairwise / max(1, some)),
        "tie_loss": float(squared / max(1, ties)),
        "preference_pair_count": int(some),
        "tie_pair_count": int(ties),
        "preference_accuracy": float(met / max(1, some)),
        "weak_only": bool(some == 0),
    }


def rank_set(embeddings: DataFrame, items: DataFrame, net: PairwiseNet) -> DataFrame:
    """Ranks of a set's items by the net's scores."""
    shared = embeddings.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(vectors.to_numpy()).astype(float))) if len(vectors) else pd.Series(dtype=float)

    return ranked(items.join(embeddings, "asset_id").select("set_id", "asset_id", score("embedding").alias("score")))


def replace_rankings(rankings: DataFrame, new: DataFrame, run_id: int, now: Column) -> DataFrame:
    """``rankings`` with the rows of run ``run_id`` for the sets of ``new`` replaced by ``new``."""
    fresh = new.withColumn("model_run_id", F.lit(run_id).cast("long")).withColumn("ranked_at", now)
    gone = new.select("set_id").distinct().withColumn("model_run_id", F.lit(run_id).cast("long"))
    return rankings.join(gone, ["set_id", "model_run_id"], "left_anti").unionByName(fresh.select(*rankings.columns))


def train_and_rank(embeddings: DataFrame, votes: DataFrame, best: DataFrame, items: DataFrame):
    """Train on all votes and star pairs and rank the sets; (net, metrics, ranks)."""
    pairs = vote_samples(votes, embeddings).unionByName(star_pairs(best).withColumn("tie", F.lit(False)))
    vector = F.col("embedding").cast("array<double>")
    one = embeddings.select(F.col("asset_id").alias("better_id"), vector.alias("x"))
    two = embeddings.select(F.col("asset_id").alias("worse_id"), vector.alias("y"))
    samples = materialize(pairs.join(one, "better_id").join(two, "worse_id").select("x", "y", "weight", "tie"))
    net, found = PairwiseNet.fit(samples)
    release(samples)
    return net, found, rank_set(embeddings, items, net)
