"""Extrema on images and volumes by neighbour joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extrema(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Cells strictly above or below all neighbours; cells on a border have fewer neighbours and do not count.

    Each cell sends its value to its neighbours and a cell's inbox is summed by partial
    aggregation, so no join is needed.
    """
    moves = [m for m in product((-1, 0, 1), repeat=len(axes))]
    sent = df.select(
        *keys, *axes, "value", F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"m{i}") for i, v in enumerate(m)]) for m in moves])).alias("m")
    )
    own = F.lit(True)
    for i in range(len(axes)):
        own = own & (F.col(f"m.m{i}") == 0)
    inbox = sent.select(
        *keys,
        *[(F.col(a) + F.col(f"m.m{i}")).alias(a) for i, a in enumerate(axes)],
        F.when(own, F.col("value")).alias("own"),
        F.when(~own, F.col("value")).alias("other"),
    )
    met = inbox.groupBy(*keys, *axes).agg(
        F.max("own").alias("value"), F.max("other").alias("hi"), F.min("other").alias("lo"), F.count("other").alias("n")
    )
    kind = F.when(F.col("value") > F.col("hi"), "max").when(F.col("value") < F.col("lo"), "min")
    return met.where(F.col("n") == len(moves) - 1).withColumn("kind", kind).where("kind is not null").select(*keys, *axes, "kind", "value")


def extrema_2d(df: DataFrame) -> DataFrame:
    """``image_id, row, col, kind, value`` over 8 neighbours."""
    return _extrema(df, ["image_id"], ["row", "col"])


def extrema_3d(df: DataFrame) -> DataFrame:
    """``volume_id, z, y, x, kind, value`` over 26 neighbours."""
    return _extrema(df, ["volume_id"], ["z", "y", "x"])
