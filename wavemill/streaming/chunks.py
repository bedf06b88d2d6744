"""Streams of samples: windows, sessions, repeats and chunk-wise decomposition with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import batched
from ..operators import kernels as K
from ..sources.shared import shared_dir


def as_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Time as TIMESTAMP (watermarks refuse local time) and late data bounded by ``delay``."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_means(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``event_type, start, n, mean`` of tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy("event_type", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(
        "event_type", F.col("w.start").alias("start"), "n", "mean"
    )


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """``user_id, start, n, total`` of sessions that end after ``gap`` without events."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select("user_id", F.col("w.start").alias("start"), "n", "total")


def without_repeats(events: DataFrame) -> DataFrame:
    """Each event id once, as far as the watermark reaches."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


_CHUNK = "series_id long, chunk long, x array<double>"
#: A rest of a series with fewer samples is not decomposed; it is a residue as it is.
LEAST = 10
_STATE = "chunk long, ts array<long>, ids array<long>, x array<double>"


def advice(x: np.ndarray) -> str:
    """The decomposition that the chunk's stationarity advises (the chunk is always sifted)."""
    w = max(5, min(50, len(x) // 4))
    v = np.lib.stride_tricks.sliding_window_view(x, w)[:-1].var(1) if len(x) > w else np.zeros(1)
    score = 1.0 if x.var() < 1e-10 else 1 / (1 + v.var() / (x.var() ** 2 + 1e-10))
    return "emd" if score > 0.8 else "eemd" if score >= 0.5 else "ceemdan"


def padded(x: np.ndarray) -> np.ndarray:
    """A chunk with forecasts joined on at both ends."""
    pad = min(max(len(x) // 4, 10), 64)
    return np.concatenate([K.forecast(x[::-1], pad)[::-1], x, K.forecast(x, pad)])


def decompose_chunks(xs: list[np.ndarray], config: K.EmdConfig) -> list[list[np.ndarray]]:
    """Modes and residue of each chunk, sifted with forecasts at both ends; chunks of one length side by side. One that fails is its own residue."""
    out: list = [[x] for x in xs]
    for n in {len(x) for x in xs if len(x) >= LEAST}:
        own = [i for i, x in enumerate(xs) if len(x) == n]
        for some in batched.turns(n, len(own)):
            long = np.array([padded(xs[i]) for i in own[some]])
            pad = (long.shape[1] - n) // 2
            modes, rest, codes = batched.emd(long, config)
            parts: list = [[] for _ in codes]
            for at, mode in modes:
                for j, m in zip(at, mode):
                    parts[j].append(m[pad : pad + n])
            for i, p, r, code in zip(own[some], parts, rest, codes):
                if code == "ok":
                    out[i] = [*p, r[pad : pad + n]]
    return out


def decomposed(waiting: DataFrame, config: K.EmdConfig) -> DataFrame:
    """The samples' rows of chunks ``x``, after the columns beside it: ``component, t, value, algorithm``.

    A rest of under ``LEAST`` samples is its own residue.
    """
    keep = [c for c in waiting.columns if c != "x"]
    schema = ", ".join(f"{c} {waiting.schema[c].dataType.simpleString()}" for c in keep) + ", parts array<array<double>>, algorithm string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xs = [np.asarray(x, float) for x in b["x"]]
            said = [advice(x) if len(x) >= LEAST else "residue" for x in xs]
            yield b[keep].assign(parts=decompose_chunks(xs, config), algorithm=said)

    parts = waiting.mapInPandas(run, schema).select(*keep, "algorithm", F.posexplode("parts").alias("component", "part"))
    samples = parts.select(*keep, (F.col("component") + 1).alias("component"), F.posexplode("part").alias("t", "value"), "algorithm")
    return samples


def decompose_stream(events: DataFrame, chunk_size: int = 32, config: K.EmdConfig = K.EmdConfig(validate=False)) -> DataFrame:
    """``series_id, chunk, component, t, value, algorithm`` of each full chunk of a user's samples.

    ``events`` are ``series_id, ts, event_id, value``. Samples wait in the group's state, in
    order of time, until a chunk is full; each chunk is decomposed once. The state holds less
    than one chunk between triggers. A stream has no end, so the rest of a series waits on:
    :func:`decompose_bounded` decomposes it too.
    """
    if chunk_size < LEAST:
        raise ValueError("a chunk has at least 10 samples")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, ts, ids, x = state.get if state.exists else (0, [], [], [])
        rows = list(zip(ts, ids, x))
        for b in batches:
            rows += list(zip(b["ts"].astype("int64").tolist(), b["event_id"].tolist(), b["value"].tolist()))
        rows.sort()
        full = len(rows) // chunk_size
        values = np.array([r[2] for r in rows[: full * chunk_size]], float).reshape(full, chunk_size)
        rows = rows[full * chunk_size :]
        state.update((chunk + full, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        if full:
            yield pd.DataFrame({"series_id": key[0], "chunk": np.arange(chunk, chunk + full), "x": list(values)})

    made = events.groupBy("series_id").applyInPandasWithState(step, _CHUNK, _STATE, "append", GroupStateTimeout.NoTimeout)
    return decomposed(made, config)


def decompose_bounded(events: DataFrame, chunk_size: int = 32, config: K.EmdConfig = K.EmdConfig(validate=False)) -> DataFrame:
    """:func:`decompose_stream` of all that is there now, with the rest of each series as a last, short chunk.

    The rests are what the groups' state holds when the input has ended. Rests under ``LEAST``
    samples are passed through as component 1, with ``residue`` as algorithm.
    """
    name = f"bounded_{uuid.uuid4().hex}"
    full = run_once(decompose_stream(events, chunk_size, config), name)
    state = events.sparkSession.read.format("statestore").load(folder_of(events, name, "progress"))
    rests = state.select("key.series_id", "value.groupState.*").where(F.size("x") > 0).select("series_id", "chunk", "x")

    return full.unionByName(decomposed(rests, config))


def folder_of(df: DataFrame, name: str, part: str) -> str:
    return f"{shared_dir(df.sparkSession)}/streams/{name}/{part}"


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there now into Parquet files and reads them back.

    Rows, progress and state go to the folder that ``spark.checkpoint.dir`` names; no row
    passes through the driver. A complete result replaces the one before.
    """
    rows = folder_of(stream, name, "rows")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder_of(stream, name, "progress"))
    if mode == "append":
        writer = writer.format("parquet").option("path", rows)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
