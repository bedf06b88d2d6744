"""Bounded streams: nothing is left over and nothing passes through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import kernels as K
from wavemill.streaming import chunks

SIZES = {1: 70, 2: 32, 3: 31, 4: 9, 5: 1, 6: 42}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rng = np.random.default_rng(0)
    rows = [(s, 1000 * t, 100 * s + t, float(v)) for s, n in SIZES.items() for t, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "series_id long, s long, event_id long, value double")
    df.select("series_id", F.timestamp_seconds("s").alias("ts"), "event_id", "value").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def stream(spark, events):
    return spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 3).parquet(events[1])


def test_rest_of_each_series_is_decomposed(spark, events):
    out = chunks.decompose_bounded(stream(spark, events)).collect()
    sums, ends = {}, {}
    for r in out:
        at = r.series_id, 32 * r.chunk + r.t
        sums[at] = sums.get(at, 0) + r.value
        ends.setdefault(r.series_id, {}).setdefault(r.chunk, set()).add(r.algorithm)
    want = {(r.series_id, r.event_id - 100 * r.series_id): r.value for r in events[0].collect()}
    assert sums.keys() == want.keys()
    assert all(abs(sums[k] - want[k]) < 1e-9 for k in want)
    assert [len(ends[s]) for s in SIZES] == [3, 1, 1, 1, 1, 2]
    assert [ends[s][max(ends[s])] == {"residue"} for s in SIZES] == [True, False, False, True, True, False]
    assert max(r.component for r in out if r.series_id == 3) > 1


def test_rows_of_a_stream_are_in_files(spark, events):
    for mode, df in [("append", stream(spark, events)), ("complete", stream(spark, events).groupBy("series_id").count())]:
        name = f"files_{mode}"
        got = chunks.run_once(df, name, mode)
        assert got.inputFiles()
        assert not spark.catalog.tableExists(name)
        assert got.count() == (sum(SIZES.values()) if mode == "append" else len(SIZES))


def test_chunks_of_one_length_are_sifted_side_by_side(monkeypatch):
    config, seen = K.EmdConfig(validate=False), []
    emd = chunks.batched.emd
    monkeypatch.setattr(chunks.batched, "emd", lambda x, c: seen.append(len(x)) or emd(x, c))
    xs = [np.random.default_rng(i).normal(size=n) for i, n in enumerate([32, 32, 9, 17, 32])]
    made = chunks.decompose_chunks(xs, config)
    assert sorted(seen) == [1, 3]
    for x, parts in zip(xs, made):
        want = [x] if len(x) < chunks.LEAST else [p[10 : 10 + len(x)] for p in K.emd(chunks.padded(x), config)]
        assert len(parts) == len(want) and all(np.abs(a - b).max() < 1e-9 for a, b in zip(parts, want))
