"""A Spark data source for signals that a server gives out as commented CSV files, one a partition.

``spark.read.format("signal").option("urls", "http://host/a.csv http://host/b.csv").load()`` after
:func:`register`. A file is read by one task, line by line, and sorted there by its time column.
"""

from __future__ import annotations

import csv
import io
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "series_id string, t int, value double"
#: Seconds that a server has to answer.
PATIENCE = 60


@dataclass
class OneUrl(InputPartition):
    url: str


def series_name(url: str) -> str:
    """The last part of a URL's path without its ending."""
    return urllib.parse.unquote(urllib.parse.urlsplit(url).path).rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


class SignalReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [*options.get("urls", "").split(), *([options["path"]] if "path" in options else [])]
        self.time, self.value = options.get("time", "time"), options.get("value", "value")
        for u in self.urls:
            if urllib.parse.urlsplit(u).scheme not in ("http", "https"):
                raise ValueError(f"not a URL of a server: {u!r}")
        if len({series_name(u) for u in self.urls}) < len(self.urls):
            raise ValueError("two URLs name the same series")

    def partitions(self) -> list[OneUrl]:
        return [OneUrl(u) for u in self.urls]

    def read(self, partition: OneUrl) -> Iterator[pa.RecordBatch]:
        with urllib.request.urlopen(partition.url, timeout=PATIENCE) as answer:
            lines = (line for line in io.TextIOWrapper(answer, "utf-8") if line.strip() and not line.startswith("#"))
            rows = [(float(r[self.time]), float(r[self.value]) if r[self.value] else None) for r in csv.DictReader(lines)]
        rows.sort(key=lambda r: r[0])
        columns = [pa.array([series_name(partition.url)] * len(rows), pa.string()), pa.array(np.arange(len(rows)), pa.int32()), pa.array([v for _, v in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["series_id", "t", "value"])


class SignalSource(DataSource):
    """Options: ``urls`` (apart by spaces) or a path, and the names of the ``time`` and ``value`` columns."""

    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SignalReader:
        return SignalReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalSource)
