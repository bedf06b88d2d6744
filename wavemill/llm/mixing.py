"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the documents are put in key
order by ranges of the key, a distributed prefix sum of sizes runs along that order, and
the mix takes whole epochs first and then the order's head up to the source's budget. No
task ever holds a whole source: ranges of the key are the unit of work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialise, word_count

#: Hex digits of the key that name a range hold so many rows of one source at most, about.
ROWS_PER_RANGE = 20_000


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share all words
    by weight; a target stops at ``cap`` times its source and the excess goes to the others
    by weight. That is ``target = min(cap * size, level * weight)`` with one common level,
    found over the sources ordered by the level at which each is full. Rows here are
    sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"),
    )
    full = cap * F.col("source_size") / F.col("weight")
    order = W.orderBy("full", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    levels = (
        per.withColumn("weight", weight)
        .withColumn("full", full)
        .withColumn(
            "level",
            (
                F.sum("source_size").over(W.partitionBy())
                - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
            )
            / F.sum("weight").over(rest),
        )
        .withColumn("place", F.row_number().over(order))
        .withColumn("fits", F.when(F.col("level") <= F.col("full"), F.col("place")))
        .withColumn("first", F.min("fits").over(W.partitionBy()))
        .withColumn("at", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.least(
        (cap * F.col("source_size")).cast("double"), F.col("at") * F.col("weight")
    )
    return levels.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights=(1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Adds to each row what the mix takes of it.

    Returns ``doc_id, source, size, source_size, target, taken``. ``taken`` counts words,
    repeats included: whole epochs of the source, then the head of the key order up to the
    source's exact budget (the document on the cut gives the words that are left).

    Nulls: a null text has size 0; a null source is a source of its own and comes last; null
    ids share one key. Ties in the key (equal ids) are ordered by size. Repeated rows stand side
    by side, and of those on a cut one can get more than the other; the rows of the result are
    the same on every run. A source without words has target 0. An empty table gives no rows. Other
    columns of ``docs`` are not read. Of a very long text only the number of words travels.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        ,
        "mix",
    )
    targets = source_targets(sized.select("source", "size"), weights, cap)
    digits = max(1, min(8, math.ceil(math.log(max(sized.count(), 1) / ROWS_PER_RANGE * 16, 16))))
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    along = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("source", "range")
        .agg(F.sum("size").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(along), F.lit(0)))
        .select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), "base")
    )
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    placed = ranged.withColumn(
        "inside",
        F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    budgets = targets.select(
        F.col("source").alias("t_source"),
        "source_size",
        "target",
        F.floor("target").cast("long").alias("budget"),
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    left = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("base") - F.col("inside")
    return (
        placed.join(bases, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
        .join(budgets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("epochs", epochs)
        .withColumn(
            "taken",
            (
                F.col("epochs") * F.col("size")
                + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
            ).cast("long"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a document taken n times comes n times.

    Documents stay whole: the one on a source's cut comes once more if any of its words are
    taken, so a source exceeds its budget by less than one document. Documents without
    words are not taken, null texts among them; a null source is one of its own. Rows of equal
    id, source and size are interchangeable and get the same number of copies. An empty table
    gives no rows. A very long text is a row that is copied whole.
    """
    size, times, d_id, d_source, d_size = fresh(docs, "size", "times", "d_id", "d_source", "d_size")
    taken = (
        mix(docs, weights, cap, seed)
        .where("taken > 0")
        .groupBy(F.col("doc_id").alias(d_id), F.col("source").alias(d_source), F.col("size").alias(d_size))
        .agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    )
    return (
        docs.withColumn(size, word_count(F.col("text")))
        .join(
            taken,
            F.col("doc_id").eqNullSafe(F.col(d_id))
            & F.col("source").eqNullSafe(F.col(d_source))
            & (F.col(size) == F.col(d_size)),
        )
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*[docs[c] for c in docs.columns])
    )
