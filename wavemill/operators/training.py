"""Boundary predictors learned from signals, and synthetic signals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boundary import from_weights


def boundary_pairs(df: DataFrame, context: int = 10, target: int = 15) -> DataFrame:
    """``series_id, t, context, target``: each full window of neighbours, split at its context's end."""
    w = W.partitionBy("series_id").orderBy("t")
    ahead = F.collect_list("value").over(w.rowsBetween(0, context + target - 1))
    return df.withColumn("ahead", ahead).where(F.size("ahead") == context + target).select(
        "series_id", "t", F.slice("ahead", 1, context).alias("context"), F.slice("ahead", context + 1, target).alias("target")
    )


@dataclass(frozen=True)
class BoundaryModel:
    """A linear predictor: ``weights[j]`` makes the j-th sample ahead from the context.

    Features are the context's samples but the last, each less the last, and a constant; the
    prediction is less the last sample too. With weights of zero it predicts the last sample.
    """

    weights: tuple[tuple[float, ...], ...]

    @property
    def context(self) -> int:
        return len(self.weights[0])

    def rows(self, spark: SparkSession) -> DataFrame:
        """``target, feature, weight``: the model as a table."""
        flat = [(j, i, w) for j, own in enumerate(self.weights) for i, w in enumerate(own)]
        return spark.createDataFrame(flat, "target int, feature int, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows(spark).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoundaryModel:
        """Reads what :meth:`save` has written: as many rows as there are weights."""
        held = {(r.target, r.feature): r.weight for r in spark.read.parquet(path).collect()}
        many, features = (1 + max(k[a] for k in held) for a in (0, 1))
        return cls(tuple(tuple(held[j, i] for i in range(features)) for j in range(many)))


def normal_equations(pairs: DataFrame, context: int = 10, target: int = 15) -> DataFrame:
    """``i, j, value``: sums over all pairs of feature ``i`` times feature ``j``, or times target ``j - context``.

    Each task adds up its own pairs, so that ``context * (context + target)`` sums a task are shuffled.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((context, context + target))
        for b in batches:
            c, y = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for k, n in enumerate((context, target)))
            last = c[:, -1:]
            x = np.concatenate([c[:, :-1] - last, np.ones_like(last)], axis=1)
            total += x.T @ np.concatenate([x, y - last], axis=1)
        i, j = np.indices(total.shape)
        # Arrow keeps NaN apart from null, which a sum would pass over
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])

    parts = pairs.select("context", "target").mapInArrow(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit_boundary(pairs: DataFrame, context: int = 10, target: int = 15, ridge: float = 0.0) -> BoundaryModel:
    """The least-squares predictor of pairs ``context, target`` (of :func:`boundary_pairs`).

    Only the sums of the normal equations come to the driver. Features that do not vary get the smallest weights.
    """
    sums = np.zeros((context, context + target))
    for r in normal_equations(pairs, context, target).collect():
        sums[r.i, r.j] = r.value
    left, right = sums[:, :context] + ridge * np.eye(context), sums[:, context:]
    if not np.isfinite(sums).all():
        raise ValueError("contexts and targets have to be finite")
    solved = np.linalg.lstsq(left, right, rcond=None)[0]
    return BoundaryModel(tuple(tuple(float(w) for w in row) for row in solved.T))


def prediction_errors(pairs: DataFrame, model: BoundaryModel, by: Column) -> DataFrame:
    """``part, pairs, mse_model, mse_last``: squared errors of the model, and of the last sample repeated, for each value of ``by``."""
    weights = [list(w) for w in model.weights]
    guess = from_weights(F.col("context"), weights)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / F.size(a)
    own = F.zip_with("target", guess, lambda y, g: y - g)
    last = F.transform("target", lambda y: y - F.element_at("context", -1))
    return pairs.groupBy(by.alias("part")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(mean(own)).alias("mse_model"), F.avg(mean(last)).alias("mse_last"))


def synthetic(spark: SparkSession, kind: str, n: int = 500, rate: float = 500.0, seed: int = 0, noise: float = 0.0) -> DataFrame:
    """One long-frame signal: tone, two_tone, chirp, am, fm, burst or mix; noise depends on the seed and sample only."""
    t = F.col("t") / rate
    tau = 2 * math.pi
    burst = F.exp(-F.pow((t - n / rate / 2) * 20, 2))
    shapes = {
        "tone": F.sin(tau * 10 * t),
        "two_tone": F.sin(tau * 10 * t) + 0.5 * F.sin(tau * 50 * t),
        "chirp": F.sin(tau * (5 * t + 20 * t * t)),
        "am": (1 + 0.5 * F.sin(tau * 2 * t)) * F.sin(tau * 25 * t),
        "fm": F.sin(tau * 25 * t + 3 * F.sin(tau * 2 * t)),
        "burst": burst * F.sin(tau * 40 * t),
        "mix": F.sin(tau * 5 * t) + 0.3 * F.sin(tau * 40 * t) + burst,
    }
    if kind not in shapes:
        raise ValueError(f"unknown signal {kind!r}; known: {sorted(shapes)}")
    # two hashes of seed and sample make a normal deviate
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("t")), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = F.sqrt(-2 * F.ln(unit(0))) * F.cos(tau * unit(1))
    return spark.range(n).select(F.lit(0).cast("long").alias("series_id"), F.col("id").cast("int").alias("t")).withColumn(
        "value", shapes[kind] + noise * normal
    )
