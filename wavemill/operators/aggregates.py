"""Entropies as aggregates for SQL: ``SELECT series_id, sample_entropy(t, value) FROM signals GROUP BY series_id``.

A group's samples pass to one call, in order of their first argument. For series that are larger
than a task there are the jobs of :mod:`wavemill.functions.entropy`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from . import kernels as K

#: Aggregates by name, each of a signal's samples. More may be added before :func:`register`.
AGGREGATES: dict[str, Callable[[np.ndarray], float]] = {
    "sample_entropy": K.sample_entropy,
    "permutation_entropy": K.permutation_entropy,
    "signal_entropy": K.spectral_entropy,
}


def _aggregate(f: Callable[[np.ndarray], float]):
    def value(t: pd.Series, x: pd.Series) -> float:
        return f(x.to_numpy(float)[np.argsort(t.to_numpy(), kind="stable")])

    return pandas_udf(value, "double")


def register(spark: SparkSession) -> None:
    """Makes the aggregates known to the session's SQL."""
    for name, f in AGGREGATES.items():
        spark.udf.register(name, _aggregate(f))
