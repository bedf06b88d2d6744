"""Live streams: order, markers, timers, late rows and bounded state."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import series
from wavemill.streaming import chunks, live

SCHEMA = "series_id long, s long, event_id long, value double, final boolean"


def rows_of(runs):
    """``{series: [samples of each run]}`` as events ten seconds apart; each run but a last open one ends in a marker."""
    out = []
    for s, parts in runs.items():
        n = 0
        for k, x in enumerate(parts):
            for i, v in enumerate(x):
                out.append((s, 1_000_000 + 10 * n, n, float(v), i == len(x) - 1 and (k, s) != (len(parts) - 1, 9)))
                n += 1
    return out


def stream(spark, path, files):
    """The files in turn, a trigger each; the files' order is that of their names."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, SCHEMA).select("series_id", F.timestamp_seconds("s").alias("ts"), "event_id", "value", "final")
        df.coalesce(1).write.parquet(f"{path}/{i:03d}")
    schema = "series_id long, ts timestamp, event_id long, value double, final boolean"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "200 seconds")


RNG = np.random.default_rng(8)
RUNS = {1: [RNG.standard_normal(70), RNG.standard_normal(12)], 2: [RNG.standard_normal(32)], 3: [RNG.standard_normal(5), RNG.standard_normal(64), RNG.standard_normal(33)]}


@pytest.mark.parametrize("triggers", [1, 5])
def test_chunks_do_not_depend_on_triggers(spark, tmp_path, triggers):
    rng = random.Random(triggers)
    # out of order by less than the delay
    flat = sorted(rows_of(RUNS), key=lambda r: r[1] + rng.randrange(0, 60))
    # a marker promises that no earlier row follows, so each goes behind the rows before it
    for s in RUNS:
        own = [r for r in flat if r[0] == s]
        for m in [r for r in own if r[4]]:
            late = [r for r in own if r[1] < m[1] and flat.index(r) > flat.index(m)]
            for r in late:
                flat.remove(r)
                flat.insert(flat.index(m), r)
    size = -(-len(flat) // triggers)
    out, report = live.run_live(live.decompose_live(stream(spark, str(tmp_path), [flat[i : i + size] for i in range(0, len(flat), size)])), f"live_{triggers}")
    sums, kinds = {}, {}
    for r in out.collect():
        at = r.series_id, r.run, 32 * r.chunk + r.t
        sums[at] = sums.get(at, 0) + r.value
        kinds[r.series_id, r.run, r.chunk] = r.algorithm
    want = {(s, k, i): v for s, parts in RUNS.items() for k, x in enumerate(parts) for i, v in enumerate(x)}
    assert sums.keys() == want.keys() and all(abs(sums[k] - want[k]) < 1e-9 for k in want)
    assert kinds[3, 0, 0] == "residue" and len([k for k in kinds if k[:2] == (1, 0)]) == 3
    assert report["late"] == 0


def test_modes_are_those_of_the_bounded_run(spark, tmp_path):
    runs = {1: [RUNS[1][0]], 2: RUNS[2]}
    rows = rows_of(runs)
    out, _ = live.run_live(live.decompose_live(stream(spark, f"{tmp_path}/a", [rows])), "live_same")
    plain = stream(spark, f"{tmp_path}/b", [rows]).select("series_id", "ts", "event_id", "value")
    key = lambda r: (r.series_id, r.chunk, r.component, r.t, round(r.value, 12), r.algorithm)
    assert sorted(map(key, out.collect())) == sorted(map(key, chunks.decompose_bounded(plain).collect()))


def test_idle_series_end_and_open_ones_wait(spark, tmp_path):
    rows = rows_of({9: [RUNS[1][0][:20]]})
    files = [rows, [(8, 1_000_000 + 5000, 0, 1.0, False)]]
    out, report = live.run_live(live.decompose_live(stream(spark, f"{tmp_path}/a", files), idle="10 minutes"), "live_idle")
    assert {(r.series_id, r.run, r.chunk, r.t) for r in out.collect()} == {(9, 0, 0, t) for t in range(20)}
    assert report["left"] > 0  # the newest row waits behind the watermark
    out, _ = live.run_live(live.decompose_live(stream(spark, f"{tmp_path}/b", files)), "live_open")
    assert out.count() == 0


@pytest.mark.parametrize("triggers", [1, 4])
def test_intermittency_without_samples_in_state(spark, tmp_path, triggers):
    signals = {1: np.round(RNG.standard_normal(90)), 2: np.sin(np.arange(120) / 4), 3: np.ones(15), 4: np.concatenate([RNG.standard_normal(20), np.zeros(60), RNG.standard_normal(20)])}
    rows = sorted(rows_of({s: [x] for s, x in signals.items()}), key=lambda r: r[1])
    size = -(-len(rows) // triggers)
    out, _ = live.run_live(live.intermittency_live(stream(spark, str(tmp_path), [rows[i : i + size] for i in range(0, len(rows), size)])), f"spacing_{triggers}")
    got = {r.series_id: r for r in out.where("final").collect()}
    frame = spark.createDataFrame([(s, t, float(v)) for s, x in signals.items() for t, v in enumerate(x)], "series_id long, t int, value double")
    for r in series.intermittency(frame).collect():
        g = got[r.series_id]
        assert (g.n_extrema, g.intermittent, g.seen) == (r.n_extrema, r.intermittent, len(signals[r.series_id]))
        assert g.cv == pytest.approx(r.cv) if r.cv is not None else g.cv is None


def test_variation_at_the_threshold_is_that_of_sql():
    spacings = [int(c) for c in "121222321111312211221312111322122122"]  # deviation 2/3, mean 5/3
    places = np.cumsum([0, 1, *spacings, 1])
    x = np.interp(np.arange(places[-1] + 1), places, np.arange(len(places)) % 2)
    cv = duckdb.sql(f"SELECT stddev_pop(d) / avg(d) FROM (SELECT unnest({spacings}) AS d)").fetchall()[0][0]
    core = live.Spacing(0.4, 5, None)
    told = core.push((1,), core.begin(0), x)[1][0].iloc[0]
    assert (told.n_extrema, told.cv, told.intermittent) == (len(spacings) + 1, cv, cv > 0.4)
    assert not told.intermittent


def test_closed_windows_leave_the_state_and_late_rows_are_counted(spark, tmp_path):
    hour = lambda h, n: [(h, 3600 * (1000 + h) + 60 * i, 100 * h + i, 1.0 * h, False) for i in range(n)]
    files = [hour(0, 5), hour(1, 5), hour(2, 5), [*hour(3, 5), (0, 3600 * 1000, 99, 7.0, False)], hour(4, 1)]
    events = stream(spark, str(tmp_path), files).withColumn("event_type", F.lit("a"))
    out, report = live.run_live(chunks.window_means(events), "live_windows")
    got = {r.mean: r.n for r in out.collect()}
    assert got == {0.0: 5, 1.0: 5, 2.0: 5} or got == {0.0: 5, 1.0: 5, 2.0: 5, 3.0: 5}
    assert report["late"] == 1 and report["state_rows"] <= 3


def test_ring():
    ring = live.Ring(3)
    assert ring.get(0) is None and not ring.full
    ring.push(1.0, 2.0)
    ring.push(3.0)
    assert ring.full and ring.held == [1.0, 2.0, 3.0]
    ring.push(4.0)
    assert (ring.get(0), ring.get(2), ring.get(3), len(ring)) == (2.0, 4.0, None, 3)
    ring.clear()
    assert len(ring) == 0 and ring.get(0) is None
    with pytest.raises(ValueError):
        live.Ring(0)


def test_the_sessions_own_store_comes_back(spark):
    before = spark.conf.get(live._PROVIDER)
    with live.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(live._PROVIDER)
    assert spark.conf.get(live._PROVIDER) == before
    with pytest.raises(ValueError):
        live.decompose_live(spark.createDataFrame([], "series_id long, ts timestamp, event_id long, value double"), 5)
