"""Decomposition jobs that a specification names: where the table lies, what to do, where the result goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import frames, remote

FORMATS = ("parquet", "csv", "json", "orc")
#: A source may also be URLs of a server (apart by spaces), each with one signal as a commented CSV.
SOURCES = (*FORMATS, "http")


@dataclass(frozen=True)
class JobSpec:
    """``source`` and ``sink`` are paths that Spark reads and writes; ``order`` sorts a series' samples."""

    source: str
    series: str
    order: tuple[str, ...]
    value: str
    format: str = "parquet"
    sink: str | None = None
    sink_format: str = "parquet"

    def __post_init__(self):
        for f, known in ((self.format, SOURCES), (self.sink_format, FORMATS)):
            if f not in known:
                raise ValueError(f"unknown format {f!r}; known: {known}")


def read_job(spark: SparkSession, spec: JobSpec) -> DataFrame:
    """The long frame of the job's table. A CSV has a header and may have ``#`` comments.

    Over ``http`` the series are the files' names, and the first of ``order`` is the time column.
    """
    if spec.format == "http":
        remote.register(spark)
        return spark.read.format("signal").options(urls=spec.source, time=spec.order[0], value=spec.value).load()
    reader = spark.read.format(spec.format)
    if spec.format == "csv":
        reader = reader.options(header=True, comment="#", inferSchema=True)
    return frames.from_table(reader.load(spec.source), spec.series, list(spec.order), spec.value)


def write_job(result: DataFrame, spec: JobSpec) -> None:
    """Writes the result to the sink, which must not be there yet."""
    if spec.sink is None:
        raise ValueError("the job names no sink")
    result.write.format(spec.sink_format).options(**({"header": True} if spec.sink_format == "csv" else {})).save(spec.sink)
