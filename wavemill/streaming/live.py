"""Live streams with state by key: samples in the order of their time, final markers, idle timers.

Rows of a series may come in any order within the watermark's delay. They wait in a list state
until the watermark has passed their time, or until a row marked ``final`` says that no earlier
ones follow; then they are handed on in order of time and id, so results do not depend on how
rows fall into triggers. A final row ends a run of its series: what is left is flushed and the
state starts anew. A series without rows for ``idle`` of event time is ended in the same way.
State is read and written once a trigger and series; what is held is bounded by the delay and by
what the processor keeps (less than a chunk, or a few numbers).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import kernels as K
from . import chunks

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PENDING = "ts bigint, id bigint, value double, final boolean"


class Ring:
    """The last samples of a series, ``capacity`` at most; 0 is the oldest."""

    def __init__(self, capacity: int, held=()):
        if capacity < 1:
            raise ValueError("a buffer holds at least one sample")
        self.capacity, self.held = capacity, list(held)[-capacity:]

    def push(self, *values: float) -> None:
        self.held = (self.held + list(values))[-self.capacity :]

    def get(self, i: int) -> float | None:
        return self.held[i] if 0 <= i < len(self.held) else None

    def clear(self) -> None:
        self.held = []

    def __len__(self) -> int:
        return len(self.held)

    @property
    def full(self) -> bool:
        return len(self.held) == self.capacity


class InOrder(StatefulProcessor):
    """Hands on a series' samples in order. ``begin``, ``push`` and ``flush`` work on a core that is kept as one row of ``core``."""

    core = "run bigint"

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def begin(self, run: int) -> tuple:
        return (run,)

    def push(self, key, core: tuple, values: np.ndarray) -> tuple[tuple, list[pd.DataFrame]]:
        raise NotImplementedError

    def flush(self, key, core: tuple) -> list[pd.DataFrame]:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.kept = handle.getValueState("core", self.core)
        self.seen = handle.getValueState("seen", "ms bigint")

    def close(self) -> None:
        pass

    def _advance(self, key, waiting: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        finals = [r[0] for r in waiting if r[3]]
        until = max([watermark * 1000, *finals])
        ready, rest = sorted(r for r in waiting if r[0] <= until), [r for r in waiting if r[0] > until]
        core = tuple(self.kept.get() or self.begin(0))
        at = 0
        for i, r in enumerate(ready):
            if r[3] or i == len(ready) - 1:
                core, out = self.push(key, core, np.array([x[2] for x in ready[at : i + 1] if x[2] is not None], float))
                yield from out
                at = i + 1
                if r[3]:
                    yield from self.flush(key, core)
                    core = self.begin(core[0] + 1)
        last = (self.seen.get() or (None,))[0] if self.idle_ms is not None else None
        if ready and self.idle_ms is not None:
            last = ready[-1][0] // 1000
            self.seen.update((last,))
        if self.idle_ms is not None and last is not None and not rest and watermark >= last + self.idle_ms:
            yield from self.flush(key, core)
            core, last = self.begin(core[0] + 1), None
            self.seen.clear()
        self.kept.update(core)
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(max(watermark, min(r[0] for r in rest) // 1000) + 1)
        elif self.idle_ms is not None and last is not None:
            self.handle.registerTimer(max(watermark, last + self.idle_ms) + 1)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.pending.get()] if self.pending.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._held()
        for b in rows:
            us = b["ts"].astype("datetime64[us]").astype("int64")
            waiting += list(zip(us.tolist(), b["event_id"].tolist(), [None if v != v else v for v in b["value"].tolist()], b["final"].astype(bool).tolist()))
        yield from self._advance(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._held(), timerValues.getCurrentWatermarkInMs())


_CHUNK = "series_id long, run long, chunk long, x array<double>"


class Chunks(InOrder):
    """Hands on each full chunk of a series; what does not fill one waits in a ring."""

    core = "run bigint, chunk bigint, held array<double>"

    def __init__(self, chunk_size: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.size = chunk_size

    def begin(self, run: int) -> tuple:
        return run, 0, []

    def _rows(self, key, run: int, chunk: int, own: list) -> list[pd.DataFrame]:
        return [pd.DataFrame({"series_id": key[0], "run": run, "chunk": np.arange(chunk, chunk + len(own)), "x": own})] if own else []

    def push(self, key, core, values):
        run, chunk, held = core
        ring, full = Ring(self.size, held or ()), []
        at = 0
        while at < len(values):
            some = values[at : at + self.size - len(ring)]
            ring.push(*some.tolist())
            at += len(some)
            if ring.full:
                full.append(ring.held)
                ring.clear()
        return (run, chunk + len(full), ring.held), self._rows(key, run, chunk, full)

    def flush(self, key, core):
        run, chunk, held = core
        return self._rows(key, run, chunk, [held] if held else [])


SPACING_SCHEMA = "series_id long, run long, seen long, n_extrema long, cv double, intermittent boolean, final boolean"


class Spacing(InOrder):
    """The extrema of a series and the variation of their spacing, from the open run and two moments: no sample is kept."""

    core = (
        "run bigint, seen bigint, value double, start bigint, turn int, n_extrema bigint, origin bigint, last bigint, spacings bigint, mean double, m2 double"
    )

    def __init__(self, cv_threshold: float, min_intervals: int, idle_ms: int | None):
        super().__init__(idle_ms)
        self.cv_threshold, self.min_intervals = cv_threshold, min_intervals

    def begin(self, run: int) -> tuple:
        return run, 0, None, 0, 0, 0, -1, -1, 0, 0.0, 0.0

    def push(self, key, core, values):
        run, seen, value, start, turn, n, origin, last, k, mean, m2 = core
        for v in values.tolist():
            if value is None:
                value, start, turn = v, seen, 0
            elif v != value:
                went = 1 if v > value else -1
                if turn and turn != went:
                    t = (start + seen - 1) // 2
                    n += 1
                    if last >= 0:
                        k += 1
                        off = (t - last) - mean
                        mean += off / k
                        m2 += off * ((t - last) - mean)
                    else:
                        origin = t
                    last = t
                value, start, turn = v, seen, went
            seen += 1
        core = run, seen, value, start, turn, n, origin, last, k, mean, m2
        return core, self._told(key, core, False) if len(values) else []

    def _told(self, key, core, final: bool) -> list[pd.DataFrame]:
        run, seen, _, _, _, n, origin, last, k, _, m2 = core
        # by the exact mean: the running one is off by a bit, which decides where the variation is the threshold itself
        cv = math.sqrt(m2 / k) / ((last - origin) / k) if k else None
        row = (key[0], run, seen, n, cv, n >= self.min_intervals + 1 and cv is not None and cv > self.cv_threshold, final)
        return [pd.DataFrame([row], columns=["series_id", "run", "seen", "n_extrema", "cv", "intermittent", "final"])]

    def flush(self, key, core):
        return self._told(key, core, True) if core[1] else []


def _milliseconds(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)


@contextmanager
def keyed_state(spark):
    """State of this kind needs the store that a stream started here uses; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _processed(events: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    if "final" not in events.columns:
        events = events.withColumn("final", F.lit(False))
    rows = events.select("series_id", "ts", "event_id", F.col("value").cast("double").alias("value"), F.coalesce("final", F.lit(False)).alias("final"))
    return rows.groupBy("series_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def decompose_live(events: DataFrame, chunk_size: int = 32, idle: str | None = None, config: K.EmdConfig = K.EmdConfig(validate=False)) -> DataFrame:
    """``series_id, run, chunk, component, t, value, algorithm`` of each chunk of a stream with a watermark on ``ts``.

    ``events`` are ``series_id, ts, event_id, value`` and may have ``final``. A row whose value is
    null only carries its marker. What a run leaves under a chunk is decomposed when it ends.
    """
    if chunk_size < chunks.LEAST:
        raise ValueError("a chunk has at least 10 samples")
    return chunks.decomposed(_processed(events, Chunks(chunk_size, _milliseconds(idle)), _CHUNK), config)


def intermittency_live(events: DataFrame, cv_threshold: float = 0.4, min_intervals: int = 5, idle: str | None = None) -> DataFrame:
    """``series_id, run, seen, n_extrema, cv, intermittent, final``: what ``series.intermittency`` tells, after each trigger's samples."""
    return _processed(events, Spacing(cv_threshold, min_intervals, _milliseconds(idle)), SPACING_SCHEMA)


def run_live(stream: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Drives a stream over what is there now in append mode; its rows, and what its operators reported.

    The report has ``late`` (rows dropped behind the watermark), ``state_rows`` (the most held after a
    trigger) and ``left`` (held at the end). Rows, progress and state are in the shared folder.
    """
    path = chunks.folder_of(stream, name, "rows")
    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", path)
        query = writer.option("checkpointLocation", chunks.folder_of(stream, name, "progress")).start()
        query.awaitTermination()
    operators = [[o for o in p["stateOperators"]] for p in query.recentProgress]
    held = [sum(o["numRowsTotal"] for o in ops) for ops in operators if ops] or [0]
    late = sum(o["numRowsDroppedByWatermark"] for ops in operators for o in ops)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), {"late": late, "state_rows": max(held), "left": held[-1]}
