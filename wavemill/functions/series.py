"""Analytics of long signal frames as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _along(keys: tuple[str, ...]) -> W:
    return W.partitionBy(*keys).orderBy("t")


def local_extrema(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, t, kind, value``: interior maxima and minima.

    A plateau counts once, at its middle (rounded down), if it is strictly higher or lower
    than both neighbours. Plateaus that touch an end do not count.
    """
    w = _along(keys)
    before = F.lag("value").over(w)
    run = F.sum(F.when(before.isNull() | (before != F.col("value")), 1).otherwise(0)).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    runs = df.withColumn("run", run).groupBy(*keys, "run").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.first("value").alias("value")
    )
    r = W.partitionBy(*keys).orderBy("run")
    left, right = F.lag("value").over(r), F.lead("value").over(r)
    kind = F.when((F.col("value") > left) & (F.col("value") > right), "max").when(
        (F.col("value") < left) & (F.col("value") < right), "min"
    )
    return (
        runs.withColumn("kind", kind)
        .where("kind is not null")
        .select(*keys, F.expr("(a + b) div 2").cast("int").alias("t"), "kind", "value")
    )


def shape(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Per series: length, zero crossings (zero counts as positive), energy, mean and population deviation."""
    before = F.lag("value").over(_along(keys))
    flip = F.when(before.isNotNull() & ((before >= 0) != (F.col("value") >= 0)), 1).otherwise(0)
    return (
        df.withColumn("flip", flip)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("flip").cast("long").alias("zero_crossings"),
            F.sum(F.col("value") * F.col("value")).alias("energy"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
    )


def intermittency(
    df: DataFrame, keys: tuple[str, ...] = ("series_id",), cv_threshold: float = 0.4, min_intervals: int = 5
) -> DataFrame:
    """Per series: number of extrema, variation of their spacing and whether it marks intermittency.

    Series with fewer than ``min_intervals + 1`` extrema are not intermittent.
    """
    spacing = F.col("t") - F.lag("t").over(_along(keys))
    stats = (
        local_extrema(df, keys)
        .withColumn("spacing", spacing)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_extrema"),
            F.avg("spacing").alias("mean_spacing"),
            F.stddev_pop("spacing").alias("std_spacing"),
        )
    )
    all_series = df.select(*keys).distinct()
    cv = F.when(F.col("mean_spacing") > 0, F.col("std_spacing") / F.col("mean_spacing"))
    return (
        all_series.join(stats, list(keys), "left")
        .withColumn("n_extrema", F.coalesce("n_extrema", F.lit(0)).cast("long"))
        .withColumn("cv", cv)
        .select(
            *keys,
            "n_extrema",
            "cv",
            F.coalesce((F.col("n_extrema") >= min_intervals + 1) & (F.col("cv") > cv_threshold), F.lit(False)).alias(
                "intermittent"
            ),
        )
    )


def stationarity(df: DataFrame, keys: tuple[str, ...] = ("series_id",), threshold: float = 0.7) -> DataFrame:
    """Per series a score in (0, 1] from the variance of rolling variances, and the predictor it advises.

    The window is a quarter of the series, 5 to 50 samples; windows start at 0 to n - w - 1.
    Short series (under 10) score 0.5, constant ones 1.
    """
    w = W.partitionBy(*keys)
    running = _along(keys).rowsBetween(W.unboundedPreceding, -1)
    sized = df.withColumns(
        {
            "n": F.count(F.lit(1)).over(w),
            "mean": F.avg("value").over(w),
            "var": F.var_pop("value").over(w),
        }
    ).withColumns(
        {
            "width": F.greatest(F.lit(5), F.least(F.lit(50), F.expr("n div 4"))).cast("int"),
            "c": F.col("value") - F.col("mean"),
        }
    )
    sums = sized.withColumns(
        {
            "s1": F.coalesce(F.sum("c").over(running), F.lit(0.0)),
            "s2": F.coalesce(F.sum(F.col("c") * F.col("c")).over(running), F.lit(0.0)),
        }
    )
    ends = sums.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("t").alias("e_t"), F.col("s1").alias("e1"), F.col("s2").alias("e2"))
    on = F.col("t") + F.col("width") == F.col("e_t")
    for k in keys:
        on = on & (F.col(k) == F.col(f"e_{k}"))
    m = (F.col("e1") - F.col("s1")) / F.col("width")
    rolled = sums.join(ends, on).select(*keys, ((F.col("e2") - F.col("s2")) / F.col("width") - m * m).alias("v"))
    spread = rolled.groupBy(*keys).agg(F.var_pop("v").alias("spread"))
    score = (
        F.when(F.col("n") < 10, F.lit(0.5))
        .when(F.col("var") < 1e-10, F.lit(1.0))
        .otherwise(1.0 / (1.0 + F.coalesce("spread", F.lit(0.0)) / (F.col("var") * F.col("var") + 1e-10)))
    )
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.var_pop("value").alias("var"))
        .join(spread, list(keys), "left")
        .withColumn("score", score)
        .select(*keys, "n", "score", F.when(F.col("score") > threshold, "ar").otherwise("last_value").alias("predictor"))
    )


def algorithm_advice(score: Column) -> Column:
    """The decomposition that a stationarity score advises."""
    return F.when(score > 0.8, "emd").when(score >= 0.5, "eemd").otherwise("ceemdan")


def last_samples(df: DataFrame, capacity: int) -> DataFrame:
    """A ring buffer's view: the last ``capacity`` samples of each series, ``place`` 0 being the oldest of them."""
    if capacity < 1:
        raise ValueError("a buffer holds at least one sample")
    back = F.row_number().over(W.partitionBy("series_id").orderBy(F.col("t").desc()))
    n = F.count(F.lit(1)).over(W.partitionBy("series_id"))
    return (
        df.withColumns({"back": back, "n": n})
        .where(F.col("back") <= capacity)
        .select("series_id", (F.least("n", F.lit(capacity)) - F.col("back")).cast("int").alias("place"), "t", "value")
    )
