"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir

__all__ = ["materialise", "shared_dir", "release", "ascii_lower", "strip_spaces", "word_count", "fresh"]

#: The white space of every contract here: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Stands for a null id, and so comes before every other id.
NO_ID = -(2**63)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def release(spark: SparkSession) -> None:
    """Deletes what ``materialise`` has written; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/wavemill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def strip_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def word_count(c: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as no text."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD_RE)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with ``df``'s, ignoring case as Spark does."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
