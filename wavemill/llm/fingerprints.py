"""Document fingerprints: weighted SimHash and permuted block tables. No Python on the data."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, materialise
from .simhash import likeness, vote, words


def _terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Pairs of neighbouring words with their hash and weight, the code points of the pair.

    The last word stands alone. Long words are rare ones, so they weigh more.
    """
    a, b = F.col("t.a"), F.col("t.b")
    return (
        df.select(*keys, words(F.col(text)).alias("w"))
        .select(*keys, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("t"))
        .select(
            *keys,
            F.xxhash64(a, b).alias("h"),
            (F.char_length(a) + F.coalesce(F.char_length(b), F.lit(0))).cast("long").alias("n"),
        )
    )


def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, fp`` of every row. Equal texts get equal fingerprints; a text without words gets 0."""
    return vote(_terms(df, keys, text), keys, "h", "n")


def block_tables(n_blocks: int, radius: int) -> list[tuple[int, int]]:
    """Masks and numbers of the permuted tables for 64 bits.

    Two fingerprints that differ in at most ``radius`` bits agree on at least
    ``n_blocks - radius`` of the blocks, so on all bits of at least one mask.
    """
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n_blocks)]
    masks = [sum(c) for c in combinations(blocks, n_blocks - radius)]
    return [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(masks)]


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = 3, n_blocks: int = 5) -> DataFrame:
    """All pairs ``q_fp, fp`` of a query and a fingerprint at most ``radius`` bits apart.

    Both inputs hold distinct longs (``q_fp``, ``fp``). Each table keeps the bits of its
    blocks and joins on them; a pair that several tables find is kept by the first of
    them, which the bits tell by themselves, so nothing is collected to remove repeats.
    """
    tables = block_tables(n_blocks, radius)

    def indexed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("i"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in tables]
        return df.select(name, F.explode(F.array(*keys)).alias("e")).select(
            name, F.col("e.i").alias(f"{name}_i"), F.col("e.k").alias(f"{name}_k")
        )

    q, f = indexed(queries, "q_fp"), indexed(fps, "fp")
    differ = F.col("q_fp").bitwiseXOR(F.col("fp"))
    first: Column = F.lit(len(tables))
    for i, m in reversed(tables):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)).otherwise(first)
    return q.join(
        f,
        (F.col("q_fp_i") == F.col("fp_i"))
        & (F.col("q_fp_k") == F.col("fp_k"))
        & (F.bit_count(differ) <= radius)
        & (first == F.col("fp_i")),
    ).select("q_fp", "fp")


def predecessors(ids: DataFrame, parts: int) -> DataFrame:
    """Adds ``prev_d, prev_n`` of the next smaller ``d`` to distinct ``d, n``; the first follows the last.

    Ranges of ids are sorted in parallel; only one row per range meets in one place.
    """
    spread = materialise(
        ids.repartitionByRange(parts, "d").withColumn("part", F.spark_partition_id()), "order"
    )
    inside = W.partitionBy("part").orderBy("d")
    lasts = spread.groupBy("part").agg(F.max(F.struct("d", "n")).alias("last"))
    every = W.orderBy("part")
    edges = lasts.select(
        F.col("part").alias("e_part"),
        F.coalesce(
            F.lag("last").over(every),
            F.last("last").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("edge"),
    )
    before = F.lag(F.struct("d", "n")).over(inside)
    return (
        spread.withColumn("before", before)
        .join(edges, F.col("part") == F.col("e_part"))
        .withColumn("before", F.coalesce("before", "edge"))
        .drop("part", "e_part", "edge")
        .withColumns({"prev_d": F.col("before.d"), "prev_n": F.col("before.n")})
        .drop("before")
    )


def edited_fingerprints(
    docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", query_every: int = 50
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last quarter of code points (floor) replaced by the first as
    many of the next document's, in ascending id order; the first follows the last. Returns
    ``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, n_near``;
    ``n_near`` is given for ids divisible by ``query_every`` and counts the other documents
    whose fingerprint is at most ``radius`` bits away, found by the block tables.

    A null text is empty; texts without words have fingerprint 0. A null id is read as the
    smallest id of all and returned as null. Rows of one id share their next document, the
    next larger id (of whose rows the one with the smallest text hash is taken); a table of
    one id follows itself. Repeated rows get equal values. An empty table gives no rows.
    Other columns of ``docs`` are not read. A very long text is split into words by one task,
    which holds the array of its words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # lengths are taken after the shuffle, so that both uses of the shuffled texts are one
    rows = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_id = rows.groupBy("d").agg(F.max(F.char_length("text")).alias("n"), F.min("th").alias("rep"))
    order = materialise(predecessors(per_id, parts), "pred").select(
        F.col("d").alias("o_d"), "rep", "prev_d", "prev_n"
    )
    heads = (
        rows.join(order, F.col("d") == F.col("o_d"))
        .where(F.col("th").bitwiseXOR(F.col("rep")) == 0)  # no join key, so texts are dealt by id alone
        .select(
            F.col("prev_d").alias("h_d"),
            F.substr("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"),
        )
        .dropDuplicates(["h_d"])
    )
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = rows.join(heads, F.col("d") == F.col("h_d")).select(
        "d",
        "th",
        "text",
        F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("head", F.lit(1), quarter)).alias("edited"),
    )
    both = edited.select(
        "d",
        "th",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")),
            )
        ).alias("x"),
    ).select("d", "th", "x.which", "x.text")
    fps = (
        fingerprint(both, ["d", "th", "which"], "text")
        .groupBy(F.col("d").alias("f_d"), F.col("th").alias("f_th"))
        .agg(
            F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
            F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"),
        )
    )
    digest = edited.select("d", "th", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    found = materialise(
        digest.join(fps, (F.col("d") == F.col("f_d")) & (F.col("th") == F.col("f_th"))).drop("f_d", "f_th"), "fps"
    )
    following = (
        found.join(order, (F.col("d") == F.col("o_d")) & (F.col("th") == F.col("rep")))
        .select(F.col("prev_d").alias("n_d"), F.col("fp").alias("next_fp"))
        .dropDuplicates(["n_d"])
    )
    classes = found.groupBy("fp").agg(F.count(F.lit(1)).alias("members"))
    is_query = (F.col("d") % query_every == 0) & (F.col("d") != NO_ID)
    near = (
        within_radius(found.where(is_query).select(F.col("fp").alias("q_fp")).distinct(), classes.select("fp"), radius)
        .join(classes.select(F.col("fp").alias("m_fp"), "members"), F.col("fp") == F.col("m_fp"))
        .groupBy("q_fp")
        .agg(F.sum("members").alias("members"))
    )
    return (
        found.join(following, F.col("d") == F.col("n_d"))
        .join(near, F.col("fp") == F.col("q_fp"), "left")
        .select(
            F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            "fp",
            "edited_fp",
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
            F.when(is_query, F.col("members") - 1).alias("n_near"),
        )
    )
