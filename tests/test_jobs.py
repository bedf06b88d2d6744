"""Jobs over frames: statuses, ensembles, reports, sources and streams."""

import functools
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import boundary, entropy, metrics
from wavemill.operators import decompose, training
from wavemill.operators import kernels as K
from wavemill.operators.kernels import EmdConfig
from wavemill.sources import frames, jobs
from wavemill.streaming import chunks


@pytest.fixture(scope="module")
def mixed(spark):
    good = training.synthetic(spark, "two_tone", 200)
    bad = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, float("nan")), (2, 2, 0.0)], "series_id long, t int, value double")
    return good.unionByName(bad)


def test_failures_are_rows(mixed):
    got = decompose.emd(mixed, EmdConfig(tolerance=1e-9)).groupBy("series_id").agg(F.max("status").alias("s"), F.count("value").alias("n"))
    by = {r.series_id: (r.s, r.n > 0) for r in got.collect()}
    assert by == {0: ("ok", True), 1: ("insufficient_data", False), 2: ("invalid_value", False)}
    assert decompose.emd(mixed, EmdConfig(tolerance=1e-9), "drop").select("series_id").distinct().count() == 1
    with pytest.raises(Exception, match="decomposition failed"):
        decompose.emd(mixed, on_error="raise").collect()
    with pytest.raises(ValueError):
        decompose.emd(mixed, on_error="ignore")


def test_validate(mixed):
    got = {r.series_id: r.status for r in frames.validate(mixed).collect()}
    assert got == {0: "ok", 1: "insufficient_data", 2: "invalid_value"}


def test_eemd_is_deterministic_and_reports_failures(mixed):
    c = EmdConfig(validate=False)
    a, b = (decompose.eemd(mixed, 4, config=c).orderBy("series_id", "component", "t").collect() for _ in range(2))
    assert [(r.series_id, r.component, r.t, round(r.value or 0, 9)) for r in a] == [(r.series_id, r.component, r.t, round(r.value or 0, 9)) for r in b]
    assert {r.series_id: r.status for r in a if r.status != "ok"} == {1: "insufficient_data", 2: "invalid_value"}


@pytest.mark.parametrize("f", [decompose.ceemdan, decompose.iceemdan])
def test_adaptive_ensembles(spark, mixed, f):
    c = EmdConfig(validate=False, max_imfs=2)
    a, b, other = ({(r.series_id, r.component, r.t): r.value for r in f(mixed, 3, 0.2, seed, c, "drop").collect()} for seed in (1, 1, 2))
    x = {(r.series_id, r.t): r.value for r in mixed.where("series_id = 0").collect()}
    last = max(k for _, k, _ in a)
    assert max(abs(sum(a[0, k, t] for k in range(1, last + 1)) - v) for (_, t), v in x.items()) < 1e-9
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a) and any(abs(a[k] - other[k]) > 1e-3 for k in a)
    assert {k[0] for k in a} == {0}
    failed = {r.series_id: r.status for r in f(mixed, 2, 0.2, 1, c).where("status <> 'ok'").collect()}
    assert failed == {1: "insufficient_data", 2: "invalid_value"}
    with pytest.raises(Exception, match="decomposition failed"):
        f(mixed, 2, 0.2, 1, c, "raise").collect()


def test_a_series_that_does_not_converge_stays_whole(spark):
    df = training.synthetic(spark, "two_tone", 200)
    c = EmdConfig(validate=False, max_siftings=1, sd_threshold=1e-12, s_number=None, energy_threshold=None)
    assert decompose.emd(df, c).first().status == "convergence_failed"
    got = decompose.emd(df, c, "whole").orderBy("t").collect()
    assert [r.value for r in got] == [r.value for r in df.orderBy("t").collect()] and {r.kind for r in got} == {"residue"}


def test_every_strategy_by_name(spark):
    df = training.synthetic(spark, "two_tone", 60)
    x = [r.value for r in df.orderBy("t").collect()]
    for name in [*boundary.STRATEGIES, "characteristic_wave"]:
        r = decompose.extend(df, name).first()
        assert r.x[r.start : r.end] == x and len(r.x) > 60, name
    with pytest.raises(ValueError):
        decompose.extend(df, "other")


def test_jobs(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("# a comment\nuser,n,v\n1,2,0.5\n1,1,0.25\n2,1,3.0\n")
    spec = jobs.JobSpec(str(path), "user", ("n",), "v", "csv", str(tmp_path / "out"))
    assert sorted(map(tuple, jobs.read_job(spark, spec).collect())) == [(1, 0, 0.25), (1, 1, 0.5), (2, 0, 3.0)]
    jobs.write_job(jobs.read_job(spark, spec), spec)
    assert spark.read.parquet(spec.sink).count() == 3
    with pytest.raises(ValueError):
        jobs.JobSpec("x", "a", ("b",), "c", "ftp")
    with pytest.raises(ValueError):
        jobs.JobSpec("x", "a", ("b",), "c", "csv", "y", "http")


def test_signals_from_a_server(spark, tmp_path):
    (tmp_path / "first one.csv").write_text("# a comment\ns,v\n0.2,3.5\n0.1,2.5\n\n# more\n0.3,\n")
    (tmp_path / "b.csv").write_text("s,v\n")

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        spec = jobs.JobSpec(f"{url}/first%20one.csv {url}/b.csv", "", ("s",), "v", "http", str(tmp_path / "out"))
        got = jobs.read_job(spark, spec)
        assert [tuple(r) for r in got.orderBy("t").collect()] == [("first one", 0, 2.5), ("first one", 1, 3.5), ("first one", 2, None)]
        assert {r.status for r in frames.validate(got).collect()} == {"invalid_value"}
        jobs.write_job(got, spec)
        assert spark.read.parquet(spec.sink).count() == 3
        one = spark.read.format("signal").options(time="s", value="v").load(f"{url}/b.csv")
        assert one.count() == 0
        with pytest.raises(Exception, match="404"):
            spark.read.format("signal").load(f"{url}/none.csv").collect()
    finally:
        server.shutdown()
    for urls in ("file:///etc/hosts", "http://a/x.csv http://b/x.csv"):
        with pytest.raises(Exception, match="URL"):
            spark.read.format("signal").option("urls", urls).load().collect()


def test_collections(spark):
    rows = [(0, 1, t, 1.0) for t in range(3)] + [(0, 2, t, 1.0) for t in range(2)] + [(1, 1, 0, float("nan"))]
    got = metrics.validate_collection(spark.createDataFrame(rows, "series_id long, component int, t int, value double")).collect()
    assert {r.series_id: r.status for r in got} == {0: "dimension_mismatch", 1: "invalid_value"}


def test_entropies_by_name(spark):
    df = training.synthetic(spark, "two_tone", 100)
    assert all(entropy.entropy_by_name(df, n).first().entropy > 0 for n in entropy.METRICS)
    with pytest.raises(ValueError):
        entropy.entropy_by_name(df, "other")


def test_reports(spark):
    o = spark.createDataFrame([(0, 1, 2, 0.5), (0, 1, 3, 0.01), (0, 2, 3, 0.2)], "series_id long, i int, j int, overlap double")
    r = metrics.mixing_report(o).first()
    assert (r.severity, r.n_mixed, r.mixed) == ("serious", 2, "1-2,2-3")
    m = {x.i: x for x in metrics.overlap_matrix(o, [1, 2, 3]).collect()}
    assert m[1]["2"] == m[2]["1"] == 0.5 and m[3]["3"] == 1.0
    v = spark.createDataFrame([(0, 1, z, float(z)) for z in range(4)], "volume_id int, component int, z int, value double")
    assert metrics.layer_statistics(v).where("z is null").first()["mean"] == 1.5


def test_strategies(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0, 8.0, 16.0, 3.0])], "series_id long, x array<double>")
    for name in boundary.STRATEGIES:
        r = boundary.extend(df, name).first()
        assert r.x[r.start : r.end] == [1.0, 2.0, 4.0, 8.0, 16.0, 3.0]
        assert len(r.x) > 6
    with pytest.raises(ValueError, match="unknown boundary"):
        boundary.extend(df, "other")
    pad = F.lit(2)
    back = df.select(boundary.unpad(boundary.pad_symmetric(F.col("x"), pad), pad).alias("x")).first().x
    assert back == [1.0, 2.0, 4.0, 8.0, 16.0, 3.0]


def best_window(x, template, starts):
    """The earliest window of the largest correlation, by a plain walk."""
    m, c = len(template), template - template.mean()
    best, at = None, None
    for s in starts:
        w = x[s : s + m] - x[s : s + m].mean()
        flat = (w @ w) ** 0.5 < 1e-15 or (c @ c) ** 0.5 < 1e-15
        r = 0.0 if flat else round(float(w @ c / ((w @ w) * (c @ c)) ** 0.5), 12)
        if best is None or r > best:
            best, at = r, s
    return at


def test_waveforms_are_searched(spark):
    rng = np.random.default_rng(3)
    wave = rng.standard_normal(8)
    signals = [
        rng.standard_normal(90).cumsum(),
        np.concatenate([rng.standard_normal(8), np.tile(wave, 6), rng.standard_normal(8)]),
        np.concatenate([wave, rng.standard_normal(20), 3 * wave + 5, rng.standard_normal(9), 2 * wave, rng.standard_normal(9), wave]),
        np.ones(40), np.arange(23.0), np.arange(24.0), np.arange(16.0), np.arange(15.0), np.arange(3.0),
        np.concatenate([np.zeros(8), rng.standard_normal(30), np.zeros(8)]),
    ]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)], "series_id long, x array<double>")
    got = {r.series_id: r for r in boundary.extend(df, "waveform", match=8).collect()}
    for i, x in enumerate(signals):
        n, m = len(x), min(8, len(x))
        left = best_window(x, x[:8], range(8, n - 15)) if n >= 24 else 0
        right = best_window(x, x[-8:], range(n - 7)) if n >= 16 else n - m
        assert got[i].x == [*x[left : left + m], *x, *x[right : right + m]], i
        assert (got[i].start, got[i].end) == (m, m + n)
    # a scaled repeat is as like as the template, and the first of them counts
    assert got[2].x[:8] == (3 * wave + 5).tolist() and got[2].x[-8:] == wave.tolist()


def test_ar_model_in_columns_equals_the_kernel(spark):
    rng = np.random.default_rng(5)
    signals = [rng.standard_normal(50).cumsum(), rng.standard_normal(7), np.ones(20), np.arange(30.0), np.array([2.0]), np.array([1.0, 3.0]), np.sin(np.arange(200) / 3)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)], "series_id long, x array<double>")
    for r in boundary.extend(df, "ar_model", order=4, length=6).collect():
        x = signals[r.series_id]
        want = np.concatenate([K.forecast(x[::-1], 6, 4)[::-1], x, K.forecast(x, 6, 4)])
        assert np.allclose(r.x, want, atol=1e-7), r.series_id


def test_csv_and_metadata(spark, tmp_path):
    csv = tmp_path / "s.csv"
    csv.write_text("# a comment\ntime_s,signal\n0.0,1.5\n0.1,2.5\n")
    assert [(r.t, r.value) for r in frames.read_csv(spark, str(csv), "time_s", "signal").orderBy("t").collect()] == [(0, 1.5), (1, 2.5)]
    meta = tmp_path / "m.json"
    meta.write_text(json.dumps([{"id": "a", "name": "A", "sample_count": 3, "sample_rate_hz": 2.0, "source": "synthetic", "license": "CC0"}]))
    df = frames.read_metadata(spark, str(meta))
    assert df.where("source = 'synthetic'").first().sample_rate_hz == 2.0
    frames.write_metadata(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("kind", ["tone", "two_tone", "chirp", "am", "fm", "burst", "mix"])
def test_synthetic(spark, kind):
    df = training.synthetic(spark, kind, 64, noise=0.1, seed=3)
    assert df.collect() == training.synthetic(spark, kind, 64, noise=0.1, seed=3).repartition(3).orderBy("t").collect()


def test_sliding_stream_windows(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0)], "event_type string, ts string, value double")
    got = chunks.window_means(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes").collect()
    assert sorted(r.n for r in got) == [1, 1, 2]


def test_small_chunks_are_refused(spark):
    with pytest.raises(ValueError):
        chunks.decompose_stream(spark.createDataFrame([], "series_id long, ts timestamp, event_id long, value double"), 5)


@pytest.mark.parametrize("m,r", [(1, 0.3), (2, 0.2), (3, 0.5)])
def test_sample_entropy_by_strips_equals_the_kernel(spark, m, r):
    rng = np.random.default_rng(9)
    signals = {
        0: rng.standard_normal(300), 1: rng.integers(0, 3, 200).astype(float), 2: np.ones(50), 3: np.sin(np.arange(150) / 5), 4: np.array([1.0, 2.0]),
        5: np.concatenate([rng.standard_normal(80), 1000 + rng.standard_normal(5)]), 6: np.array([1.0, float("nan"), 2.0, 3.0, 1.0]),
    }
    df = spark.createDataFrame([(s, t, float(v)) for s, x in signals.items() for t, v in enumerate(x)], "series_id long, t int, value double")
    got = {x.series_id: x.entropy for x in entropy.sample_entropy(df.repartition(3), m, r).collect()}
    assert got.keys() == signals.keys()
    for s, x in signals.items():
        assert got[s] == pytest.approx(0.0 if np.isnan(x).any() else K.sample_entropy(x, m, r), abs=1e-9), s


def test_sample_entropy_of_a_long_series(spark):
    df = spark.range(60_000).select(F.lit(0).cast("long").alias("series_id"), F.col("id").cast("int").alias("t"), F.sin(F.col("id") / 3).alias("s"))
    noisy = df.select("series_id", "t", (F.col("s") + F.pmod(F.xxhash64("t"), F.lit(1000)) / 500).alias("value"))
    assert 0.5 < entropy.sample_entropy(noisy).first().entropy < 3


def test_csv_files_with_comments(spark, tmp_path):
    df = training.synthetic(spark, "two_tone", 40).unionByName(training.synthetic(spark, "chirp", 30).withColumn("series_id", F.lit(7).cast("long")))
    frames.write_csv(df, str(tmp_path / "csv"))
    files = list((tmp_path / "csv" / "series_id=7").glob("part-*"))
    assert len(files) == 1 and files[0].read_text().splitlines()[:2] == ["# series 7", "t,value"]
    assert [x.split(",")[0] for x in files[0].read_text().splitlines()[2:]] == [str(t) for t in range(30)]
    assert sorted(frames.read_csvs(spark, str(tmp_path / "csv")).collect()) == sorted(df.select("series_id", "t", "value").collect())
