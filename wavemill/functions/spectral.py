"""Spectra and instantaneous frequency. The transforms pass Arrow batches, the rest is windows and bins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..sources.frames import packed


def _transform(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], f) -> DataFrame:
    """``keys, i, columns``: arrays that ``f`` makes of each packed signal, side by side."""
    rows = packed(df, keys)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema += "".join(f", {c} array<double>" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            made = [f(np.asarray(x, float)) for x in batch["x"]]
            for i, c in enumerate(columns):
                out[c] = [m[i] for m in made]
            yield out

    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return rows.mapInPandas(run, schema).select(*keys, F.posexplode(zipped).alias("i", "z")).select(*keys, "i", *[f"z.{c}" for c in columns])


def analytic_signal(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, t, re, im`` over the length padded to a power of two."""

    def f(x):
        a = K.analytic(x)
        return a.real, a.imag

    return _transform(df, keys, ("re", "im"), f).withColumnRenamed("i", "t")


def instantaneous(
    df: DataFrame, keys: tuple[str, ...] = ("series_id",), sample_rate: float = 1.0, difference: str = "central"
) -> DataFrame:
    """``keys, t, amp, phase, freq``: modulus, unwrapped angle and its difference of an analytic signal.

    The difference is central with one-sided ends, or ``"forward"`` with the last one repeated.
    """
    if difference not in ("central", "forward"):
        raise ValueError("difference is central or forward")
    w = W.partitionBy(*keys).orderBy("t")
    angle = F.atan2("im", "re")
    turns = F.round((F.col("angle") - F.lag("angle").over(w)) / (2 * math.pi))
    phase = F.col("angle") - 2 * math.pi * F.sum(F.coalesce(F.col("turns"), F.lit(0.0))).over(
        w.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before, after = F.lag("phase").over(w), F.lead("phase").over(w)
    step = (
        F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2)
        .when(after.isNotNull(), after - F.col("phase"))
        .when(before.isNotNull(), F.col("phase") - before)
        .otherwise(0.0)
    )
    if difference == "forward":
        step = F.coalesce(after - F.col("phase"), F.col("phase") - before, F.lit(0.0))
    return (
        df.withColumns({"amp": F.hypot("re", "im"), "angle": angle})
        .withColumn("turns", turns)
        .withColumn("phase", phase)
        .withColumn("freq", step * sample_rate / (2 * math.pi))
        .select(*keys, "t", "amp", "phase", "freq")
    )


def marginal_log(inst: DataFrame, bins: int = 1024, low: float = 1e-3, high: float = 1e3) -> DataFrame:
    """``series_id, bin, energy`` over logarithmic bins of positive frequencies."""
    place = F.floor((F.log10("freq") - math.log10(low)) / (math.log10(high) - math.log10(low)) * bins).cast("int")
    return (
        inst.where(F.col("freq") > 0)
        .withColumn("bin", place)
        .where((F.col("bin") >= 0) & (F.col("bin") < bins))
        .groupBy("series_id", "bin")
        .agg(F.sum(F.col("amp") * F.col("amp")).alias("energy"))
    )


def marginal_linear(inst: DataFrame, bins: int = 256) -> DataFrame:
    """``series_id, bin, energy``: linear bins between a series' least (0 or more) and largest frequency, per sample."""
    w = W.partitionBy("series_id")
    ranged = inst.withColumns(
        {"lo": F.greatest(F.min("freq").over(w), F.lit(0.0)), "hi": F.max("freq").over(w), "n": F.count(F.lit(1)).over(w)}
    )
    place = F.least(F.floor((F.col("freq") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return (
        ranged.where((F.col("hi") > F.col("lo")) & (F.col("freq") >= F.col("lo")))
        .withColumn("bin", place)
        .groupBy("series_id", "bin")
        .agg((F.sum(F.col("amp") * F.col("amp")) / F.max("n")).alias("energy"))
    )


def marginal_nyquist(inst: DataFrame, bins: int = 64, sample_rate: float = 1.0) -> DataFrame:
    """``series_id, bin, energy``: linear bins from 0 to half the sample rate, per sample."""
    n = F.count(F.lit(1)).over(W.partitionBy("series_id"))
    place = F.floor(F.col("freq") / (sample_rate / 2) * bins).cast("int")
    return (
        inst.withColumn("n", n)
        .where((F.col("freq") >= 0) & (F.col("freq") < sample_rate / 2))
        .withColumn("bin", place)
        .groupBy("series_id", "bin")
        .agg((F.sum(F.col("amp") * F.col("amp")) / F.max("n")).alias("energy"))
    )


def power_spectrum(df: DataFrame, keys: tuple[str, ...] = ("series_id",), one_sided: bool = True) -> DataFrame:
    """``keys, bin, power`` over the length padded to a power of two."""

    def f(x):
        n = 1 << max(0, len(x) - 1).bit_length()
        p = np.abs(np.fft.fft(x, n)) ** 2
        return (p[: n // 2 + 1] if one_sided else p,)

    return _transform(df, keys, ("power",), f).withColumnRenamed("i", "bin")


def dft_magnitude(df: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, bin, magnitude`` of the transform without padding: bins below half the length, by the length."""
    f = lambda x: (np.abs(np.fft.fft(x))[: len(x) // 2] / max(1, len(x)),)
    return _transform(df, keys, ("magnitude",), f).withColumnRenamed("i", "bin")


def hilbert_imf(modes: DataFrame, sample_rate: float = 1.0, bins: int = 256) -> tuple[DataFrame, DataFrame]:
    """Amplitude, phase and frequency of each component at each sample, and the marginal spectrum of them all."""
    if sample_rate <= 0:
        raise ValueError("the sample rate is positive")
    keys = ("series_id", "component")
    inst = instantaneous(analytic_signal(modes, keys), keys, sample_rate, "forward")
    return inst, marginal_nyquist(inst, bins, sample_rate)


def spectral_entropy(spectra: DataFrame, n: DataFrame | None = None, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``keys, entropy`` of two-sided spectra; with ``keys, n`` also ``normalized`` by the logarithm of n, at most 1."""
    total = F.sum("power").over(W.partitionBy(*keys))
    p = F.col("power") / F.col("total")
    out = (
        spectra.withColumn("total", total)
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(F.when((F.col("total") > 1e-10) & (p > 1e-10), -p * F.ln(p))), F.lit(0.0)).alias("entropy"))
    )
    if n is None:
        return out
    norm: Column = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col("entropy") / F.ln("n"))).otherwise(0.0)
    return out.join(n, list(keys)).select(*keys, "entropy", norm.alias("normalized"))


def sliding_windows(df: DataFrame, width: int, overlap: float = 0.5) -> DataFrame:
    """``series_id, start, t, value``: full windows only, each from 0; the stride is the part that does not overlap."""
    stride = max(1, math.ceil(width * (1 - overlap)))
    n = F.count(F.lit(1)).over(W.partitionBy("series_id"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - (width - 1)) / stride)) * stride
    last = F.least(F.floor(F.col("t") / stride) * stride, F.floor((F.col("n") - width) / stride) * stride)
    starts = F.when((F.col("n") >= width) & (last >= first), F.sequence(first.cast("int"), last.cast("int"), F.lit(stride)))
    return (
        df.withColumn("n", n)
        .select("series_id", "t", "value", F.explode(starts).alias("start"))
        .select("series_id", "start", (F.col("t") - F.col("start")).alias("t"), "value")
    )
