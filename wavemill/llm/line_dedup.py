"""Line dedup: lines found in many documents go, except in the last document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, ascii_lower, fresh, materialise, strip_spaces

MIN_CHARS = 20
MIN_DOCS = 3
#: A key with more than one in so many of the common lines is dealt out by salts. No more keys
#: than this can have such a share, which bounds what is broadcast.
HOT_SHARES = 1000


def _without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``: the slices of lines between them, joined."""
    at = F.array_sort(gone)

    def kept(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + 1))
        ends = F.concat(at, F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # the array of one element binds the lines, so that they are split once
    return F.transform(F.array(F.split(text, "\n", -1)), kept)[0]


def drop_common_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with common lines gone from the text, and ``n_lines``, ``n_dropped`` (long).

    A line's key is the line stripped of white space at both ends, A-Z lower-cased; keys
    shorter than ``min_chars`` code points never count. A key found in ``min_docs`` or more
    documents loses all its lines, except in the document of the largest id that holds it.

    Keys travel as two 64-bit hashes. Equal keys of one document are merged before the
    shuffle and documents are counted with map-side partial sums, so a line that a third of
    all documents share costs no task more than its partial counts; on the way back such a
    key is salted by its share of all lines.

    A null or empty text is one empty line and comes back as it was (null stays null). A null
    id counts as one document with the smallest id. Rows of equal id are one document; rows
    that repeat as a whole are treated alike. An empty table gives no rows. Columns named n_lines or
    n_dropped are replaced. A very long text is split into lines by one task; its lines travel
    as hashes, and a document's places of dropped lines meet in one row.
    """
    d, th, pos, line, k1, k2, gone, g_d, g_th = fresh(docs, "d", "th", "pos", "line", "k1", "k2", "gone", "g_d", "g_th")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.drop("n_lines", "n_dropped").withColumns(
        {d: F.coalesce(F.col(id_col), F.lit(NO_ID)), th: F.xxhash64(text)}
    )
    key = ascii_lower(strip_spaces(F.col(line)))
    lines = (
        row.select(d, th, F.posexplode(F.split(text, "\n", -1)).alias(pos, line))
        .where(F.char_length(line) >= min_chars)
        .withColumn(line, key)
        .where(F.char_length(line) >= min_chars)
        .select(d, th, pos, F.xxhash64(line).alias(k1), F.xxhash64(F.lit("second"), line).alias(k2))
    )
    common = materialise(
        lines.groupBy(k1, k2, d)
        .agg(F.lit(1).alias("one"))
        .groupBy(k1, k2)
        .agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("last"))
        .where(F.col("n") >= min_docs)
        .select(F.col(k1).alias("c1"), F.col(k2).alias("c2"), "n", "last"),
        "lines",
    )
    # a key's salts follow its share of all; keys with more than one are HOT_SHARES at most
    total = common.agg(F.sum("n")).first()[0] or 1
    shares = F.ceil(F.col("n") * HOT_SHARES / F.lit(total)).cast("int")
    hot = common.where(shares > 1).select(F.col("c1").alias("h1"), F.col("c2").alias("h2"), shares.alias("shares"))
    salted = common.select("c1", "c2", "last", F.explode(F.sequence(F.lit(0), shares - 1)).alias("c_salt"))
    spread = lines.join(F.broadcast(hot), (F.col(k1) == F.col("h1")) & (F.col(k2) == F.col("h2")), "left").select(
        d, th, pos, k1, k2, F.coalesce(F.pmod(F.xxhash64(d), F.col("shares")), F.lit(0)).cast("int").alias("salt")
    )
    drops = (
        spread.join(salted, (F.col(k1) == F.col("c1")) & (F.col(k2) == F.col("c2")) & (F.col("salt") == F.col("c_salt")))
        .where(F.col(d) < F.col("last"))
        .groupBy(F.col(d).alias(g_d), F.col(th).alias(g_th))
        .agg(F.collect_set(pos).alias(gone))
    )
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return (
        row.join(drops, (F.col(d) == F.col(g_d)) & (F.col(th) == F.col(g_th)), "left")
        .withColumn("n_lines", F.size(F.split(text, "\n", -1)).cast("long"))
        .withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
        .withColumn(
            text_col,
            F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without_lines(F.col(text_col), F.col(gone))),
        )
        .select(*keep, "n_lines", "n_dropped")
    )
