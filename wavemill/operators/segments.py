"""Decomposition of series that are larger than a task: every step works on segments.

A series is cut into segments of equal length. What crosses a cut is passed on as small rows,
one a segment:

* A plateau may go on over any number of cuts. Segments tell their first and last runs, and the
  runs are joined along the series, so that an extremum lies where it does uncut.
* A spline's curvatures solve one tridiagonal system over all knots. A segment solves its own
  rows for any value of the neighbours' nearest curvatures; the last and first curvatures of the
  segments then solve a small system of their own, by one sweep forth and one back.
* The sums and counts that stop the sifting are added up over the segments.

Each sifting step of all series is a few jobs; its result is a table in the shared folder. A
task holds one segment, and the small rows of a series (one a segment) meet in one task.
"""

from __future__ import annotations

import itertools
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import kernels as K

SEGMENT = 1 << 16

_KNOTS = "array<struct<t: bigint, y: double>>"
_SOLVED = "array<struct<t: bigint, y: double, u: double, v: double, w: double>>"
_STATE = "h array<double>, step int, changed double, base double"
_ENDS = (
    "t0 bigint, n bigint, first double, first_run bigint, first_turn int, last double, last_run bigint, last_turn int, one boolean, "
    f"tops bigint, lows bigint, top_edges {_KNOTS}, low_edges {_KNOTS}, crossings bigint, opens boolean, closes boolean, energy double, "
    "whole double, bad boolean"
)
_TOLD = f"action string, modes int, step int, steady int, joins array<struct<t: bigint, top: boolean>>, before {_KNOTS}, after {_KNOTS}"
_CURVED = "array<struct<t: bigint, y: double, m: double>>"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to a few tasks a core, as a step is several small jobs and rows pass through a task one by one."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))), *keys)


def _mapped(rows: DataFrame, f: Callable, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``series_id, seg, keep`` and the dictionary that ``f(row)`` gives for each row. What is kept is passed on as it is."""
    keys = ["series_id", "seg", *keep]
    full = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + f", {schema}"
    kinds = dict(x.split(" ", 1) for x in _split(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(r) for r in _rows(batch)]
            out = {k: batch.column(k) for k in keys} | {n: _array([m[n] for m in made], kind) for n, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, full)


_PLAIN = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _values(column: pa.Array) -> list:
    """A column's values: lists of structs as lists of tuples, other lists as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, cuts = column.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    if pa.types.is_struct(flat.type):
        flat = list(zip(*(x.to_pylist() for x in flat.flatten())))
    else:
        flat = flat.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def _array(values: list, kind: str) -> pa.Array:
    """The column of type ``kind`` that :func:`_values` takes apart."""
    if kind in _PLAIN:
        return pa.array(values, _PLAIN[kind])
    cuts = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32())
    inner = kind[len("array<") : -1]
    if inner in _PLAIN:
        return pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0), *values]), _PLAIN[inner]))
    fields = [[x.strip() for x in part.split(":")] for part in inner[len("struct<") : -1].split(",")]
    columns = list(zip(*itertools.chain.from_iterable(values))) or [()] * len(fields)
    flat = pa.StructArray.from_arrays([pa.array(c, _PLAIN[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])
    return pa.ListArray.from_arrays(cuts, flat)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return map(namedtuple("Row", batch.schema.names)._make, zip(*map(_values, batch.columns)))


def _split(schema: str) -> list[str]:
    """The columns of a schema, at commas outside of brackets."""
    out, deep = [""], 0
    for ch in schema:
        deep += (ch == "<") - (ch == ">")
        if ch == "," and not deep:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def _along(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    """What ``f(rows of a series in order of seg)`` gives for each of them, as a list of dictionaries.

    Series are dealt out and sorted, so that a task goes through its series one after the other.
    """
    kind = rows.schema["series_id"].dataType.simpleString()
    kinds = dict(x.split(" ", 1) for x in _split(schema))

    def told(held: list, of: pa.DataType) -> pa.RecordBatch:
        made = [m for own in held for m in f(own)]
        flat = [r for own in held for r in own]
        out = {"series_id": pa.array([r.series_id for r in flat], of), "seg": pa.array([r.seg for r in flat], pa.int64())}
        return pa.RecordBatch.from_pydict(out | {n: _array([m[n] for m in made], k) for n, k in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = []  # the series that the next batch may go on with
        of = None
        for batch in batches:
            of = batch.schema.field("series_id").type
            held = []
            for r in _rows(batch):
                if last and last[0].series_id != r.series_id:
                    held.append(last)
                    last = []
                last.append(r)
            if held:
                yield told(held, of)
        if last:
            yield told([last], of)

    return dealt(rows, "series_id").sortWithinPartitions("series_id", "seg").mapInArrow(run, f"series_id {kind}, seg bigint, {schema}")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return start, np.concatenate([start[1:] - 1, [len(x) - 1]])


def _edges(x: np.ndarray, places: np.ndarray, t0: int) -> list[tuple[int, float]]:
    few = places if len(places) <= 2 else places[[0, -1]]
    return [(int(t0 + p), float(x[p])) for p in few]


def _ends(segment: int) -> Callable:
    """What a segment tells of itself."""

    def ends(r) -> dict:
        x, rest = np.asarray(r.h, float), np.asarray(r.rest, float)
        start, end = _runs(x)
        v = x[start]
        tops, lows = K.extrema(x)
        t0 = int(r.seg) * segment
        return {
            "t0": t0, "n": len(x), "first": v[0], "first_run": end[0] + 1, "first_turn": int(np.sign(v[1] - v[0])) if len(v) > 1 else 0,
            "last": v[-1], "last_run": len(x) - start[-1], "last_turn": int(np.sign(v[-1] - v[-2])) if len(v) > 1 else 0, "one": len(v) == 1,
            "tops": len(tops), "lows": len(lows), "top_edges": _edges(x, tops, t0), "low_edges": _edges(x, lows, t0),
            "crossings": K.zero_crossings(x), "opens": bool(x[0] >= 0), "closes": bool(x[-1] >= 0), "energy": float(np.dot(x, x)),
            "whole": float(np.dot(rest, rest)), "bad": not np.isfinite(x).all(),
        }

    return ends


def _joined(rows: list) -> list[tuple[int, float, bool]]:
    """Extrema whose run meets a cut: place, value, whether it is a maximum."""
    out: list[tuple[int, float, bool]] = []
    value = start = turn = None

    def close(end: int, then: float) -> None:
        if turn and turn * then < 0:
            out.append(((start + end) // 2, value, turn > 0))

    for r in rows:
        if value is None:
            value, start, turn = r.first, r.t0, 0
        elif r.first != value:
            went = np.sign(r.first - value)
            close(r.t0 - 1, went)
            value, start, turn = r.first, r.t0, went
        if not r.one:
            close(r.t0 + r.first_run - 1, r.first_turn)
            value, start, turn = r.last, r.t0 + r.n - r.last_run, r.last_turn
    return out


def _decided(c: K.EmdConfig, segment: int) -> Callable:
    """What a series does next (``go``, ``mode``, ``end`` or a status), and what each of its segments needs to know for it."""

    def action(rows: list, tops: int, lows: int) -> tuple[str, int]:
        r = rows[0]
        now, n = sum(x.energy for x in rows), sum(x.n for x in rows)
        if any(x.bad for x in rows):
            return "invalid_value", 0
        if n < 3:
            return "insufficient_data", 0
        steady = r.steady
        if r.step == 0 and ((c.max_imfs and r.modes >= c.max_imfs) or tops + lows < 2):
            return "end", 0
        stop = False
        if r.step and c.fixed_iterations is None:
            crossings = sum(x.crossings for x in rows) + sum(a.closes != b.opens for a, b in zip(rows, rows[1:]))
            steady = steady + 1 if abs(tops + lows - crossings) <= 1 else 0
            changed, base = sum(x.changed for x in rows), sum(x.base for x in rows)
            sd, change = (changed / base, abs(now - base) / base) if base else (0.0, 0.0)
            stop = (
                (c.sd_threshold is not None and sd < c.sd_threshold)
                or (c.s_number is not None and steady >= c.s_number)
                or (c.energy_threshold is not None and change < c.energy_threshold)
            )
        stop = stop or (c.fixed_iterations is not None and r.step >= c.fixed_iterations)
        if not stop and r.step >= c.max_siftings:
            return "convergence_failed", 0
        if stop or tops < 2 or lows < 2:
            whole = sum(x.whole for x in rows)
            return ("end" if not whole or now / whole < 1e-15 else "mode"), 0
        return "go", steady

    def decided(rows: list) -> list[dict]:
        joins = _joined(rows)
        tops = sum(r.tops for r in rows) + sum(j[2] for j in joins)
        lows = sum(r.lows for r in rows) + sum(not j[2] for j in joins)
        what, steady = action(rows, tops, lows)
        own: dict[int, list] = {}
        for t, y, top in joins:
            own.setdefault(t // segment, []).append((t, y, top))
        out = []
        for r in rows:
            mine = own.get(r.seg, [])
            out.append({"action": what, "modes": r.modes, "step": r.step, "steady": steady, "joins": [(int(t), bool(top)) for t, _, top in mine], "before": [], "after": []})
        if what != "go":
            return out
        for top in (True, False):
            firsts, lasts = [], []
            for r in rows:
                all_ = sorted([*(r.top_edges if top else r.low_edges), *((t, y) for t, y, k in own.get(r.seg, []) if k == top)])
                firsts.append(all_[0] if all_ else None)
                lasts.append(all_[-1] if all_ else None)
            # the knot before and the knot after each segment; a missing one is at place -1
            seen = None
            for o, last in zip(out, lasts):
                o["before"].append(seen or (-1, 0.0))
                seen = last or seen
            seen = None
            for o, first in zip(reversed(out), reversed(firsts)):
                o["after"].append(seen or (-1, 0.0))
                seen = first or seen
        return out

    return decided


def _solved(segment: int) -> Callable:
    """A segment's knots, and their curvatures as ``u - v * (curvature before) - w * (curvature after)``."""

    def solved(r) -> dict:
        x, t0 = np.asarray(r.h, float), int(r.seg) * segment
        inner = dict(zip((True, False), K.extrema(x)))
        out = {}
        for k, top in enumerate((True, False)):
            joins = [t for t, is_top in r.joins if is_top == top]
            t = np.sort(np.concatenate([inner[top] + t0, np.array(joins, np.int64)])).astype(np.int64)
            before, after = r.before[k], r.after[k]
            ts, ys = t.astype(float), x[t - t0]
            if before[0] >= 0:
                ts, ys = np.append(before[0], ts), np.append(before[1], ys)
            if after[0] >= 0:
                ts, ys = np.append(ts, after[0]), np.append(ys, after[1])
            solution = np.zeros((len(t), 3))
            if len(t):
                lower, diag, upper, rhs = np.zeros(len(t)), np.ones(len(t)), np.zeros(len(t)), np.zeros((len(t), 3))
                # the first and last knot of all have no curvature
                has = np.arange(len(t)) + (before[0] >= 0)
                mid = np.flatnonzero((has > 0) & (has < len(ts) - 1))
                g = has[mid]
                lower[mid], upper[mid] = ts[g] - ts[g - 1], ts[g + 1] - ts[g]
                diag[mid] = 2 * (lower[mid] + upper[mid])
                rhs[mid, 0] = 6 * ((ys[g + 1] - ys[g]) / upper[mid] - (ys[g] - ys[g - 1]) / lower[mid])
                rhs[0, 1], rhs[-1, 2] = lower[0], upper[-1]
                solution = K._tridiagonal(lower, diag, upper, rhs)
            out["tops" if top else "lows"] = [(int(a), float(b), *map(float, s)) for a, b, s in zip(t, x[t - t0], solution)]
        return out

    return solved


def _interfaces(segment: int) -> Callable:
    """The curvatures at the segments' ends, and for each segment the two knots before and after it with theirs."""

    def one(rows: list, edges: list[list[tuple]]) -> list[dict]:
        held = [k for k, e in enumerate(edges) if e]
        alpha, beta, a, b = {}, {}, {}, {}
        before = (0.0, 0.0)
        for k in held:
            (_, _, u1, v1, w1), (_, _, up, vp, wp) = edges[k][0], edges[k][-1]
            al, be = before
            d = 1 - v1 * be
            a[k], b[k] = (u1 - v1 * al) / d, w1 / d
            alpha[k], beta[k] = up - vp * al + vp * be * a[k], vp * be * b[k] + wp
            before = alpha[k], beta[k]
        nearest, following = {}, 0.0  # each segment's curvature after it
        for k in reversed(held):
            nearest[k] = following
            following = a[k] - b[k] * following
        knots, preceding = [], {}
        last = 0.0
        for k in held:
            preceding[k] = last
            for t, y, u, v, w in edges[k]:
                knots.append((int(t), float(y), float(u - v * last - w * nearest[k])))
            last = alpha[k] - beta[k] * nearest[k]
        places = np.array([t for t, _, _ in knots], np.int64)
        out = []
        for k, r in enumerate(rows):
            lo, hi = np.searchsorted(places, [r.seg * segment, (r.seg + 1) * segment])
            out.append({"preceding": preceding.get(k, 0.0), "following": nearest.get(k, 0.0), "before": knots[max(0, lo - 2) : lo], "after": knots[hi : hi + 2]})
        return out

    def interfaces(rows: list) -> list[dict]:
        tops = one(rows, [r.top_edges for r in rows])
        lows = one(rows, [r.low_edges for r in rows])
        return [{**{f"top_{k}": v for k, v in x.items()}, **{f"low_{k}": v for k, v in y.items()}} for x, y in zip(tops, lows)]

    return interfaces


def _sifted(segment: int) -> Callable:
    """A segment less its mean envelope."""

    def envelope(known, before, after, preceding: float, following: float, at: np.ndarray) -> np.ndarray:
        own = np.array(known, float).reshape(-1, 5)
        m = own[:, 2] - own[:, 3] * preceding - own[:, 4] * following
        knots = np.concatenate([np.array(part, float).reshape(-1, 3) for part in (before, np.column_stack([own[:, :2], m]), after)])
        return K.spline_between(knots[:, 0], knots[:, 1], knots[:, 2], at)

    def sifted(r) -> dict:
        x = np.asarray(r.h, float)
        at = int(r.seg) * segment + np.arange(len(x))
        upper = envelope(r.tops, r.top_before, r.top_after, r.top_preceding, r.top_following, at)
        lower = envelope(r.lows, r.low_before, r.low_after, r.low_preceding, r.low_following, at)
        mean = (upper + lower) / 2
        return {"h": x - mean, "step": r.step + 1, "changed": float(np.dot(mean, mean)), "base": float(np.dot(x, x))}

    return sifted


def _met(segments: DataFrame, told: DataFrame) -> DataFrame:
    """Segments with what they are told, dealt out for the work that follows."""
    return dealt(segments, "series_id", "seg").join(dealt(told, "series_id", "seg"), ["series_id", "seg"])


def cut(df: DataFrame, segment: int) -> DataFrame:
    """``series_id, seg, h``: the samples of ``series_id, t, value`` by segments, each in order."""
    seg = F.floor(F.col("t") / segment)
    rows = dealt(df.select("series_id", seg.alias("seg"), "t", "value"), "series_id", "seg")
    pairs = F.array_sort(F.collect_list(F.struct("t", "value")))
    return rows.groupBy("series_id", "seg").agg(F.transform(pairs, lambda p: p["value"]).alias("h"))


def emd_segmented(df: DataFrame, config: K.EmdConfig = K.EmdConfig(), segment: int = SEGMENT, on_error: str = "status") -> DataFrame:
    """As :func:`decompose.emd` with natural splines, for series of any length (``t`` dense from 0).

    A series that fails is a row with its status, or left out (``drop``).
    """
    if config.spline != "natural" or config.boundary == "palindrome_cyclic":
        raise ValueError("segments are sifted with natural splines and no palindrome")
    spark = df.sparkSession
    zero = F.lit(0)
    start = cut(df, segment).select(
        "series_id", "seg", "h", F.col("h").alias("rest"), *[zero.cast("int").alias(n) for n in ("modes", "step", "steady")], *[F.lit(0.0).alias(n) for n in ("changed", "base")]
    )
    live = shared.materialise(start, "segments")
    done: list[DataFrame] = []
    failed: list[DataFrame] = []
    while not live.isEmpty():
        ends = _mapped(live, _ends(segment), _ENDS, ("modes", "step", "steady", "changed", "base"))
        told = _along(ends, _decided(config, segment), _TOLD)
        step = shared.materialise(_met(live.select("series_id", "seg", "h", "rest"), told), "segments")
        actions = {r.action for r in step.select("action").distinct().collect()}  # a handful of words
        nexts = []
        if "mode" in actions:
            stopped = step.where("action = 'mode'")
            done.append(stopped.select("series_id", "seg", (F.col("modes") + 1).alias("component"), F.lit("imf").alias("kind"), F.col("h").alias("part")))
            less = F.zip_with("rest", "h", lambda a, b: a - b)
            nexts.append(
                stopped.select("series_id", "seg", less.alias("h"), less.alias("rest"), (F.col("modes") + 1).alias("modes"), *[zero.cast("int").alias(n) for n in ("step", "steady")], *[F.lit(0.0).alias(n) for n in ("changed", "base")])
            )
        if "end" in actions:
            done.append(step.where("action = 'end'").select("series_id", "seg", (F.col("modes") + 1).alias("component"), F.lit("residue").alias("kind"), F.col("rest").alias("part")))
        if actions - {"go", "mode", "end"}:
            failed.append(step.where("action not in ('go', 'mode', 'end')").select("series_id", F.col("action").alias("status")).distinct())
        if "go" in actions:
            going = step.where("action = 'go'")
            kept = ("h", "rest", "modes", "step", "steady")
            solved = shared.materialise(_mapped(going, _solved(segment), f"tops {_SOLVED}, lows {_SOLVED}", kept), "segments")
            few = lambda c: F.when(F.size(c) > 4, F.concat(F.slice(c, 1, 2), F.slice(c, -2, 2))).otherwise(F.col(c))
            ends = _along(
                solved.select("series_id", "seg", few("tops").alias("top_edges"), few("lows").alias("low_edges")), _interfaces(segment),
                ", ".join(f"{k}_preceding double, {k}_following double, {k}_before {_CURVED}, {k}_after {_CURVED}" for k in ("top", "low")),
            )
            sifted = _mapped(_met(solved, ends), _sifted(segment), _STATE, ("rest", "modes", "steady"))
            nexts.append(sifted.select(live.columns))
        if not nexts:
            break
        live = nexts[0] if len(nexts) == 1 else nexts[0].unionByName(nexts[1])
        live = shared.materialise(live, "segments")
    t = (F.col("seg") * segment + F.col("at")).cast("int").alias("t")
    kind = df.schema["series_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"series_id {kind}, component int, kind string, t int, value double")
    for d in done:
        rows = d.select("series_id", "seg", "component", "kind", F.posexplode("part").alias("at", "value"))
        out = out.unionByName(rows.select("series_id", "component", "kind", t, "value"))
    if on_error != "status":
        return out
    out = out.withColumn("status", F.lit("ok"))
    for d in failed:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
