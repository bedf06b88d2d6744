"""Entropy and complexity of signals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spectral import power_spectrum, spectral_entropy


def permutation_entropy(df: DataFrame, m: int = 3, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, entropy, normalized`` of the orders of ``m`` neighbours; equal values keep their order."""
    w = W.partitionBy(*keys).orderBy("t")
    values = F.array(*[F.struct(F.lead("value", i).over(w).alias("v"), F.lit(i).alias("i")) for i in range(m)])
    pattern = F.array_join(F.transform(F.array_sort("w"), lambda p: p["i"].cast("string")), ",")
    counts = (
        df.withColumns({"w": values, "last": F.lead("value", m - 1).over(w)})
        .where("last is not null")
        .groupBy(*keys, pattern.alias("pattern"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    p = F.col("c") / F.col("total")
    entropy = counts.withColumn("total", F.sum("c").over(W.partitionBy(*keys))).groupBy(*keys).agg(
        F.sum(-p * F.ln(p)).alias("entropy")
    )
    top = math.log(math.factorial(m))
    return df.select(*keys).distinct().join(entropy, list(keys), "left").select(
        *keys,
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.least(F.lit(1.0), F.coalesce("entropy", F.lit(0.0)) / top).alias("normalized"),
    )


#: Candidate pairs that are compared at once.
_PAIRS = 1 << 20
#: Templates that a strip of a long series is meant to hold.
_STRIP = 4096


def _near(x: dict[str, np.ndarray], y: dict[str, np.ndarray] | None, limit: float, m: int) -> tuple[int, int]:
    """Pairs of templates within ``limits`` in ``m`` samples, and in one more: of ``x`` with ``y``, or of ``x`` among themselves.

    Both are sorted by their last sample of the ``m``; only those near in it are compared.
    """
    other = x if y is None else y
    key, wide = f"v{m - 1}", limit * (1 + 1e-9)
    lo = np.searchsorted(other[key], x[key] - wide) if y is not None else np.arange(len(x[key])) + 1
    hi = np.searchsorted(other[key], x[key] + wide, side="right")
    upto = np.cumsum(np.maximum(hi - lo, 0))
    b = a = 0
    for s in range(0, int(upto[-1]) if len(upto) else 0, _PAIRS):
        at = np.arange(s, min(s + _PAIRS, int(upto[-1])))
        i = np.searchsorted(upto, at, side="right")
        j = hi[i] - (upto[i] - at)
        close = np.ones(len(at), bool)
        for k in range(m):
            close &= np.abs(x[f"v{k}"][i] - other[f"v{k}"][j]) <= limit
        i, j = i[close], j[close]
        weight = x["c"][i] * other["c"][j]
        b += int(weight.sum())
        a += int(weight[np.abs(x["next"][i] - other["next"][j]) <= limit].sum())  # a missing one is NaN
    return b, a


def sample_entropy(df: DataFrame, m: int = 2, r: float = 0.2, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, entropy``: of pairs of templates within ``r`` deviations for m samples, the share that stays so for one more.

    Equal templates become one with a count. Templates are dealt out by series and strip of their
    first sample, and meet those of their own strip and of the next one. A strip is as wide as the
    limit, or so wide that it has some :data:`_STRIP` of evenly spread templates; so a long series is
    many tasks, and only templates that are near in the last sample as well are compared.
    """
    own = W.partitionBy(*keys)
    along = own.orderBy("t")
    ahead = {f"v{k}": F.lead("value", k).over(along) for k in range(m)}
    spread = {"limit": F.lit(r) * F.stddev_pop("value").over(own), "low": F.min("value").over(own)}
    spread["width"] = F.greatest(spread["limit"] * (1 + 1e-9), (F.max("value").over(own) - spread["low"]) * _STRIP / F.count(F.lit(1)).over(own))
    rows = df.withColumns(ahead | spread | {"next": F.lead("value", m).over(along), "more": F.lead("value", m + 1).over(along)})
    rows = rows.where(F.col("next").isNotNull() & ~F.isnan("limit"))
    names = [f"v{k}" for k in range(m)]
    rows = rows.withColumn("next", F.when(F.col("more").isNotNull(), F.col("next")))
    counted = rows.groupBy(*keys, "limit", "low", "width", *names, "next").agg(F.count(F.lit(1)).alias("c"))
    strip = F.when(F.col("width") > 0, F.floor((F.col("v0") - F.col("low")) / F.col("width"))).otherwise(F.lit(0)).cast("long")
    # role 1: what the strip before compares with
    roles = F.when(F.col("strip") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt_ = counted.withColumn("strip", strip).withColumn("role", F.explode(roles))
    dealt_ = dealt_.withColumn("strip", F.col("strip") - F.col("role"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", b long, a long"

    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(names[-1])
        role = table["role"].to_numpy()
        columns = {n: table[n].to_numpy() for n in [*names, "c"]} | {"next": pc.fill_null(table["next"], float("nan")).to_numpy()}
        limit = table["limit"][0].as_py()
        here, there = ({n: v[role == k] for n, v in columns.items()} for k in (0, 1))
        same = here["c"] * (here["c"] - 1) // 2
        b, a = _near(here, None, limit, m)
        b2, a2 = _near(here, there, limit, m)
        known = ~np.isnan(here["next"])
        out = {k: pa.array([v.as_py()], table.schema.field(k).type) for k, v in zip(keys, key)}
        return pa.table(out | {"b": [b + b2 + int(same.sum())], "a": [a + a2 + int(same[known].sum())]})

    sums = dealt_.groupBy(*keys, "strip").applyInArrow(pairs, schema).groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    value = F.when((F.col("a") > 0) & (F.col("b") > 0), -F.ln(F.col("a") / F.col("b"))).otherwise(F.lit(0.0))
    return df.select(*keys).distinct().join(sums, list(keys), "left").select(*keys, value.alias("entropy"))


#: Entropies by name, each from a frame and its keys to ``keys, entropy``. More may be added.
METRICS = {
    "spectral": lambda df, keys: spectral_entropy(power_spectrum(df, keys, one_sided=False), None, keys),
    "permutation": lambda df, keys: permutation_entropy(df, 3, keys).select(*keys, "entropy"),
    "sample": lambda df, keys: sample_entropy(df, 2, 0.2, keys),
}


def entropy_by_name(df: DataFrame, name: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown entropy {name!r}; known: {sorted(METRICS)}")
    return METRICS[name](df, keys)


def entropy_report(modes: DataFrame) -> DataFrame:
    """Per series: means of the modes' entropies, the score of these means and whether the complexity is high."""
    per = complexity(modes)
    means = per.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("modes"), *[F.avg(c).alias(c) for c in ("spectral", "permutation", "sample")]
    )
    score = (F.col("spectral") + F.col("permutation") + F.least(F.col("sample") / 2, F.lit(1.0))) / 3
    return means.select("*", score.alias("score"), (F.col("spectral") > 0.7).alias("high_complexity"))


def complexity(df: DataFrame, keys: tuple[str, ...] = ("series_id", "component")) -> DataFrame:
    """Per component: normalised spectral and permutation entropy, sample entropy and their mean score."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spectral = spectral_entropy(power_spectrum(df, keys, one_sided=False), n, keys).select(*keys, F.col("normalized").alias("spectral"))
    order = permutation_entropy(df, 3, keys).select(*keys, F.col("normalized").alias("permutation"))
    sample = sample_entropy(df, 2, 0.2, keys).withColumnRenamed("entropy", "sample")
    score = (F.col("spectral") + F.col("permutation") + F.least(F.col("sample") / 2, F.lit(1.0))) / 3
    return spectral.join(order, list(keys)).join(sample, list(keys)).select(
        *keys, "spectral", "permutation", "sample", score.alias("score"), (F.col("spectral") > 0.7).alias("high_complexity")
    )
