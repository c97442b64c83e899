"""Aesthetic models on embeddings: training by sums over tasks, scoring as columns or Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions.vectors import clamp, dot, sigmoid
from darkroom.operators import jobs
from darkroom.operators.training import descend, summed
from darkroom.sources.scratch import materialize, owned, release

#: Encoders by what there is to load, and the least number of ratings to train on.
ENCODER, STUB_ENCODER = "clip_vitb32", "stub"
LEAST_RATED = 3


def active_encoder(model_file: str | None) -> str:
    """The encoder whose file there is, else the stub."""
    return ENCODER if model_file and Path(model_file).exists() else STUB_ENCODER


def ai_bucket(score: Column) -> Column:
    return F.when(score < 0.33, "low").when(score < 0.67, "maybe").otherwise("high")


def delete_candidate(score: Column, confidence: Column) -> Column:
    return (score < 0.2) & (confidence > 0.6)


def target(rating: np.ndarray) -> np.ndarray:
    """Ratings 1 to 5 as 0 to 1."""
    return (np.clip(rating, 1, 5) - 1) / 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; rows of next to no length stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm > 1e-6, x / np.maximum(norm, 1e-6), x)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class LinearHead:
    weights: np.ndarray
    bias: float = 0.5

    def terms(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over rows that a step needs."""
        error = self.score(x) - y
        return np.concatenate([error @ x, [error.sum()]])

    def stepped(self, total: np.ndarray, n: int, rate: float = 0.01, decay: float = 0.001) -> LinearHead:
        return LinearHead(self.weights - rate * (total[:-1] / n + decay * self.weights), self.bias - rate * float(total[-1] / n))

    @classmethod
    def train(cls, x: np.ndarray, rating: np.ndarray, epochs: int = 500):
        """Gradient descent on the mean over all samples; returns the head and its metrics."""
        return _trained(cls(np.zeros(x.shape[1] if len(x) else 0)), x, rating, epochs)

    @classmethod
    def fit(cls, samples: DataFrame, epochs: int = 500):
        """:meth:`train` on ``samples`` (see :func:`samples_of`), whose sums are taken in tasks."""
        return _fitted(lambda size: cls(np.zeros(size)), samples, epochs)

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(x @ self.weights + self.bias)

    def column(self, embedding: Column) -> Column:
        """The score as a native column."""
        return sigmoid(dot(embedding, F.lit([float(w) for w in self.weights])) + F.lit(float(self.bias)))

    def save(self, path: Path) -> None:
        path.write_text(json.dumps({"weights": self.weights.tolist(), "bias": self.bias}, indent=2))

    @classmethod
    def load(cls, path: Path) -> LinearHead:
        held = json.loads(path.read_text())
        return cls(np.array(held["weights"]), held["bias"])


def initial(shape: tuple[int, ...], scale: float, before: int = 0) -> np.ndarray:
    """Reproducible start weights: sines of multiples of the golden section, from number ``before`` on."""
    n = int(np.prod(shape))
    return (np.sin((np.arange(before, before + n) + 1) * 0.618034) * scale).reshape(shape)


def start_weights(hidden: int, dimension: int, scales: tuple[float, float], before: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Both layers of a net with one output; the second goes on behind the first, scales shrink with the number of inputs."""
    one = initial((hidden, dimension), np.sqrt(2 / max(1, dimension)) * scales[0], before[0])
    return one, initial((hidden,), np.sqrt(2 / max(1, hidden)) * scales[1], hidden * dimension + before[1])


@dataclass
class MlpHead:
    """One hidden layer with ReLU on the unit vector, and a sigmoid output."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def new(cls, dimension: int) -> MlpHead:
        hidden = int(np.clip(dimension // 24, 8, 32))
        one, two = start_weights(hidden, dimension, (0.35, 0.35))  # fixed values
        return cls(one, np.zeros(hidden), two, 0.0)

    def terms(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over rows that a step needs; errors are clamped to -1 to 1."""
        rows = unit(x)
        pre = rows @ self.w1.T + self.b1
        h = np.maximum(pre, 0)
        error = np.clip(logistic(h @ self.w2 + self.b2) - y, -1, 1)
        back = error[:, None] * self.w2 * (pre > 0)
        return np.concatenate([(back.T @ rows).ravel(), back.sum(axis=0), error @ h, [error.sum()]])

    def stepped(self, total: np.ndarray, n: int, rate: float = 0.03, decay: float = 0.0005) -> MlpHead:
        one, two, three = np.split(total[:-1] / n, np.cumsum([self.w1.size, self.b1.size]))
        w1 = self.w1 - rate * (one.reshape(self.w1.shape) + decay * self.w1)
        return MlpHead(w1, self.b1 - rate * two, self.w2 - rate * (three + decay * self.w2), self.b2 - rate * float(total[-1] / n))

    @classmethod
    def train(cls, x: np.ndarray, rating: np.ndarray, epochs: int = 140):
        """Gradient descent on the mean over all samples."""
        return _trained(cls.new(x.shape[1] if len(x) else 1), x, rating, epochs)

    @classmethod
    def fit(cls, samples: DataFrame, epochs: int = 140):
        """:meth:`train` on ``samples`` (see :func:`samples_of`), whose sums are taken in tasks."""
        return _fitted(cls.new, samples, epochs)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1.T + self.b1, 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.hidden(x) @ self.w2 + self.b2)

    def confidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(2 * np.abs(self.score(x) - 0.5) + 0.15 * np.abs(self.hidden(x)).mean(axis=1), 0, 1)

    def save(self, path: Path) -> None:
        held = {"w1": self.w1.tolist(), "b1": self.b1.tolist(), "w2": self.w2.tolist(), "b2": float(self.b2)}
        path.write_text(json.dumps(held, indent=2))

    @classmethod
    def load(cls, path: Path) -> MlpHead:
        held = json.loads(path.read_text())
        return cls(*(np.array(held[k]) for k in ("w1", "b1", "w2")), held["b2"])


def _trained(head, x: np.ndarray, rating: np.ndarray, epochs: int):
    if not len(x):
        raise ValueError("no training samples")
    y = target(rating)
    for _ in range(epochs):
        head = head.stepped(head.terms(x, y), len(x))
    return head, metrics(head.score(x), y)


@owned
def _fitted(new: Callable[[int], LinearHead | MlpHead], samples: DataFrame, epochs: int):
    size = samples.agg(F.max(F.size("x"))).first()[0]
    if not size:
        raise ValueError("no training samples")
    rows = samples.filter(F.size("x") == size).select("x", "y")
    head = descend(rows, new(size), lambda head, x, y: head.terms(x, y), lambda head, total, n: head.stepped(total, n), epochs)

    def apart(head, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        error = head.score(x) - y
        return np.array([(error**2).sum(), np.abs(error).sum(), len(y)], dtype=np.float64)

    squares, absolute, n = summed(rows, head, apart)
    return head, {"mse": float(squares / n), "mae": float(absolute / n), "sample_count": int(n)}


def samples_of(embeddings: DataFrame, ratings: DataFrame) -> DataFrame:
    """(x, y): vector and target of all assets with a rating above 0.  Vectors of another than the greatest length are not fitted."""
    joined = embeddings.join(ratings.filter("rating > 0"), "asset_id")
    return joined.select(F.col("embedding").cast("array<double>").alias("x"), ((clamp(F.col("rating").cast("double"), 1, 5) - 1) / 4).alias("y"))


def metrics(score: np.ndarray, want: np.ndarray) -> dict[str, float]:
    return {
        "mse": float(np.mean((score - want) ** 2)),
        "mae": float(np.mean(np.abs(score - want))),
        "sample_count": len(want),
    }


def missing_embeddings(assets: DataFrame, embeddings: DataFrame, encoder: str, version: str) -> DataFrame:
    """Assets without an embedding of this encoder."""
    have = embeddings.filter((F.col("encoder_name") == encoder) & (F.col("encoder_version") == version))
    return assets.join(have.select(F.col("content_asset_id").alias("asset_id")), "asset_id", "left_anti")


def extract(assets: DataFrame, embeddings: DataFrame, encode: Column, encoder: str, version: str, only_missing: bool = True) -> DataFrame:
    """Embeddings with those of ``assets`` by ``encode``: of all of them, or of those that have none yet."""
    todo = missing_embeddings(assets, embeddings, encoder, version) if only_missing else assets
    new = todo.select(
        F.col("asset_id").alias("content_asset_id"), F.lit(encoder).alias("encoder_name"), F.lit(version).alias("encoder_version"),
        encode.cast("array<float>").alias("embedding"),
    )
    keys = ["content_asset_id", "encoder_name", "encoder_version"]
    return embeddings.join(new.select(*keys), keys, "left_anti").unionByName(new)


def training_set(embeddings: DataFrame, ratings: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and ratings (above 0) of the rated assets; of more than ``most`` those of the least id hash."""
    joined = embeddings.join(ratings.filter("rating > 0"), "asset_id").select("asset_id", "embedding", "rating")
    rows = joined.orderBy(F.xxhash64("asset_id"), "asset_id").limit(most).collect()  # a bounded sample
    x = np.array([r.embedding for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return np.array([r.asset_id for r in rows]), x, np.array([r.rating for r in rows], dtype=np.float64)


def predict_linear(embeddings: DataFrame, head: LinearHead) -> DataFrame:
    """asset_id, ai_score, ai_confidence, ai_bucket, delete_candidate, all native columns."""
    scored = embeddings.select("asset_id", head.column(F.col("embedding")).alias("ai_score"))
    scored = scored.withColumn("ai_confidence", 2 * F.abs(F.col("ai_score") - 0.5))
    return with_bucket(scored)


def predict_mlp(embeddings: DataFrame, head: MlpHead) -> DataFrame:
    """As :func:`predict_linear`; rows of another dimension drop out."""
    shared = embeddings.sparkSession.sparkContext.broadcast(head)  # of fixed size
    dimension = head.w1.shape[1]

    def run(batches):
        for batch in batches:
            if len(batch):
                x = np.stack(batch.embedding.to_numpy()).astype(np.float64)
                model = shared.value
                yield pd.DataFrame({"asset_id": batch.asset_id, "ai_score": model.score(x), "ai_confidence": model.confidence(x)})

    usable = embeddings.filter(F.size("embedding") == dimension).select("asset_id", "embedding")
    return with_bucket(usable.mapInPandas(run, "asset_id long, ai_score double, ai_confidence double"))


def with_bucket(scored: DataFrame) -> DataFrame:
    return scored.withColumn("ai_bucket", ai_bucket(F.col("ai_score"))).withColumn(
        "delete_candidate", delete_candidate(F.col("ai_score"), F.col("ai_confidence"))
    )


def predict_missing(embeddings: DataFrame, predictions: DataFrame, head: MlpHead | LinearHead) -> DataFrame:
    """Predictions with those of assets that had none."""
    todo = embeddings.join(predictions.select("asset_id"), "asset_id", "left_anti")
    found = predict_mlp(todo, head) if isinstance(head, MlpHead) else predict_linear(todo, head)
    return predictions.unionByName(found.select(*predictions.columns))


def clear_predictions(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No predictions, and how many there were as one row (deleted)."""
    return predictions.limit(0), predictions.agg(F.count(F.lit(1)).alias("deleted"))


def activate(models: DataFrame, new: DataFrame) -> DataFrame:
    """Registry in which only ``new`` is active."""
    return models.withColumn("active", F.lit(False)).unionByName(new.withColumn("active", F.lit(True)))


def active_model(models: DataFrame) -> DataFrame:
    """The active model of the greatest id; no row if none is active."""
    return models.filter("active").orderBy(F.desc("id")).limit(1)


def full_pipeline(embeddings: DataFrame, ratings: DataFrame, predictions: DataFrame, least: int = LEAST_RATED):
    """Train on all that is rated, if that is enough, and score what is not scored; (head or None, predictions)."""
    samples = materialize(samples_of(embeddings, ratings))
    if samples.count() < least:
        return None, predictions
    head, _ = MlpHead.fit(samples)
    release(samples)
    return head, predict_missing(embeddings, predictions, head)


@owned
def run_full_pipeline(
    state: dict[str, DataFrame], assets: DataFrame, ratings: DataFrame, encode: Column, encoder: str, version: str, now: Column,
    save: Callable[[MlpHead], str], least: int = LEAST_RATED,
) -> dict[str, DataFrame]:
    """State (image_embeddings, ai_models, ai_predictions, ai_jobs) after one logged run of extraction, training and prediction.

    ``assets`` (asset_id and what ``encode`` reads) without an embedding get one; a head is trained
    on all assets of ``ratings`` (asset_id, rating), saved by ``save``, which returns its path, and made active; assets without
    its prediction get one.  With fewer than ``least`` rated assets the model that is active stays, but scores
    nothing new.  The job ends as completed, with the number of predictions, or as failed, with the
    reason, and then nothing but the log has changed.
    """
    log = materialize(jobs.create(state["ai_jobs"], "full_pipeline", now))
    job_id = log.agg(F.max("id")).first()[0]
    log = jobs.update(log, job_id, "running", 0, 0, None, now)
    try:
        embeddings = materialize(extract(assets, state["image_embeddings"], encode, encoder, version))
        own = embeddings.filter((F.col("encoder_name") == encoder) & (F.col("encoder_version") == version))
        own = own.select(F.col("content_asset_id").alias("asset_id"), "embedding")
        samples = materialize(samples_of(own, ratings))
        rated = samples.count()
        out = state | {"image_embeddings": embeddings}
        if rated < least:
            note = f"{rated} rated assets, {least} needed: not trained"
            return out | {"ai_jobs": materialize(jobs.update(log, job_id, "completed", 0, 0, note, now))}
        head, _ = MlpHead.fit(samples)
        top = state["ai_models"].agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
        new = own.sparkSession.range(1).select(
            F.lit(top).cast("long").alias("id"), F.lit("mlp").alias("head_type"), F.lit(True).alias("active"), now.alias("created_at"), F.lit(save(head)).alias("path")
        )
        found = materialize(predict_mlp(own, head))  # the model is new, so nothing has its prediction
        columns = state["ai_predictions"].columns
        named = found.withColumnRenamed("asset_id", "content_asset_id").withColumns({"model_id": F.lit(top).cast("long"), "predicted_at": now})
        scored = found.count()
        return out | {
            "ai_models": materialize(activate(state["ai_models"], new.select(*state["ai_models"].columns))),
            "ai_predictions": state["ai_predictions"].unionByName(named.select(*columns)),
            "ai_jobs": materialize(jobs.update(log, job_id, "completed", scored, scored, None, now)),
        }
    except Exception as error:  # whatever it was, the log says so
        return state | {"ai_jobs": materialize(jobs.update(log, job_id, "failed", 0, 0, str(error)[:500], now))}


def rated_counts(ratings: DataFrame, instances: DataFrame) -> DataFrame:
    """One row: n_rated, ratings above 0 of known files, and n_rated_images, any ratings of live images."""
    files = instances.select(F.col("id").alias("file_instance_id"), "exists_flag", "file_class")
    live = F.col("exists_flag") & (F.col("file_class") == "image")
    return ratings.join(files, "file_instance_id").agg(
        F.count_if(F.col("rating") > 0).alias("n_rated"), F.count_if(live).alias("n_rated_images")
    )


def status(
    assets: DataFrame, embeddings: DataFrame, ratings: DataFrame, instances: DataFrame, predictions: DataFrame, models: DataFrame,
    jobs: DataFrame, encoder: str, version: str,
) -> DataFrame:
    """One row: n_assets, n_embeddings of the encoder, n_rated, n_rated_images, n_predictions of the active
    model, active_model_id, running_job_id (the newest pending or running one), latest_job_id."""
    own = (F.col("encoder_name") == encoder) & (F.col("encoder_version") == version)
    active = active_model(models).select(F.col("id").alias("model_id"))
    parts = [
        embeddings.agg(F.count_if(own).alias("n_embeddings")),
        rated_counts(ratings, instances),
        predictions.join(F.broadcast(active), "model_id").agg(F.count(F.lit(1)).alias("n_predictions")),
        active.agg(F.max("model_id").alias("active_model_id")),
        jobs.agg(F.max(F.when(F.col("status").isin("pending", "running"), F.col("id"))).alias("running_job_id"), F.max("id").alias("latest_job_id")),
    ]
    out = assets.agg(F.count(F.lit(1)).alias("n_assets"))
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
