"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is missing, a session whose tasks run in this process gets a new folder. On a
    cluster a local folder would be another one on each machine, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wavemill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def write_table(df: DataFrame, tag: str, **options) -> str:
    """Writes ``df`` as Parquet to the shared folder and returns its path. ``options`` are the writer's, with ``_`` for dots."""
    path = f"{shared_dir(df.sparkSession)}/wavemill/{tag}-{uuid.uuid4().hex}"
    df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    return path


def materialise(df: DataFrame, tag: str, **options) -> DataFrame:
    """As :func:`write_table`, read back, which cuts the lineage of ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag, **options))
