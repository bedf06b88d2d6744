"""A training corpus from raw documents: filter, dedup, mix and pack, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes it as
Parquet to the shared folder and reads it back for the next one. All stages but the last
return the columns of documents.

An empty table passes through all stages as an empty one. A text is handled whole by one task in
each stage, however long: a task of toxicity, near dedup and packing holds its words, of line
dedup its lines; extra columns of any name go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import line_dedup, mixing, near_dup, packing, toxicity
from wavemill.llm.common import materialise
from wavemill.llm.queries import tokenizer_path


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; labels of the learning folds teach the score.

    A null or empty text has no telling word and so the score of such texts. Repeated rows go or
    stay together, as do rows of a null id with the same text.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def _drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go, but for the last document that holds them; lengths follow.

    A null text is one empty line; a null id comes before all others. Rows of one id count as
    one document, and all of them keep the lines if theirs is the largest id.
    """
    done = line_dedup.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(kind))
    return done.select(*docs.columns)


def _one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    A null id is the smallest; rows of equal id are told apart by their text's hash, and of rows
    that repeat as a whole one stays. Texts without words, null ones among them, are one group.
    """
    return near_dup.one_of_each(docs)


def _mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document taken twice comes twice.

    Documents without words (null texts among them) are not taken. A null source is a source of
    its own. Rows of equal id, source and size get the same number of copies.
    """
    return mixing.mixed_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 4096 ids.

    A null text is the end id alone; repeated rows are packed each for themselves.
    """
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", _drop_toxic),
    ("line_dedup", _drop_common_lines),
    ("near_dedup", _one_of_each_group),
    ("mixing", _mix_sources),
    ("packing", _pack),
]

#: The learned and the iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
