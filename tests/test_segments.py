"""Series in segments against the kernel that holds them whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import kernels as K
from wavemill.operators import segments
from wavemill.operators.segments import emd_segmented

RNG = np.random.default_rng(11)
SIGNALS = {
    1: RNG.standard_normal(500),
    2: RNG.standard_normal(260).cumsum(),
    3: np.repeat(RNG.integers(-3, 4, 60), RNG.integers(1, 25, 60)).astype(float),  # plateaus over several cuts
    4: np.sin(np.arange(700) / 60),
    5: np.ones(130),
    6: np.arange(100.0),
    7: np.concatenate([np.zeros(90), [1.0], np.zeros(120), [-1.0], np.zeros(75)]),
    8: RNG.standard_normal(31),
    9: np.concatenate([RNG.standard_normal(40), np.linspace(0, 9, 400), RNG.standard_normal(40)]),
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(s, t, float(v)) for s, x in SIGNALS.items() for t, v in enumerate(x)]
    rows += [(20, 0, 1.0), (20, 1, 2.0)] + [(21, t, float("nan") if t == 50 else 1.0 * t) for t in range(90)]
    return spark.createDataFrame(rows, "series_id long, t int, value double").repartition(4)


@pytest.mark.parametrize("segment", [32, 77])
@pytest.mark.parametrize("config", [K.EmdConfig(validate=False, max_imfs=2), K.EmdConfig(validate=False, fixed_iterations=2, max_imfs=3)])
def test_modes_do_not_depend_on_the_cuts(frame, segment, config):
    got, status = {}, {}
    for r in emd_segmented(frame, config, segment).collect():
        if r.status == "ok":
            got.setdefault(r.series_id, {})[r.component, r.t] = r.value, r.kind
        else:
            status[r.series_id] = r.status
    assert status == {20: "insufficient_data", 21: "invalid_value"}
    for s, x in SIGNALS.items():
        want = K.emd(x, config)
        assert len(got[s]) == len(want) * len(x), s
        for k, part in enumerate(want, 1):
            have = np.array([got[s][k, t][0] for t in range(len(x))])
            assert np.abs(have - part).max() < 1e-9 * max(1, np.abs(x).max()), (s, k)
            assert got[s][k, 0][1] == ("residue" if k == len(want) else "imf")


def test_small_rows_of_many_series_are_many_tasks(spark):
    rows = spark.range(400).select(F.floor(F.col("id") / 4).alias("series_id"), (3 - F.col("id") % 4).alias("seg"))
    told = segments._along(rows, lambda own: [{"seen": [(r.seg, 0.5)] * k, "n": len(own)} for k, r in enumerate(own)], "seen array<struct<t: bigint, y: double>>, n int")
    got = told.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    assert {(r.series_id, r.seg, r.n, tuple(map(tuple, r.seen))) for r in got} == {(i, g, 4, ((g, 0.5),) * g) for i in range(100) for g in range(4)}


def test_what_does_not_converge_is_told(frame):
    c = K.EmdConfig(validate=False, max_siftings=1, sd_threshold=1e-12, s_number=None, energy_threshold=None)
    some = frame.where("series_id in (1, 5)")
    rows = emd_segmented(some, c, 64).groupBy("series_id", "status").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.series_id, r.status, r.n) for r in rows} == {(1, "convergence_failed", 1), (5, "ok", 130)}
    assert emd_segmented(some, c, 64, "drop").select("series_id").distinct().count() == 1
    with pytest.raises(ValueError):
        emd_segmented(some, K.EmdConfig(spline="periodic"))


def test_a_million_samples_in_sixteen_segments(spark):
    t = spark.range(1_000_000, numPartitions=8).withColumn("t", F.col("id").cast("int"))
    x = F.sin(F.col("t") / 7) + 0.6 * F.sin(F.col("t") / 91) + 0.3 * (F.pmod(F.xxhash64("t"), F.lit(1000)) / 1000 - 0.5)
    df = t.select(F.lit(0).cast("long").alias("series_id"), "t", x.alias("value"))
    config = K.EmdConfig(validate=False, max_imfs=1, fixed_iterations=2)
    whole = np.array([r.value for r in df.orderBy("t").collect()])
    mode = K.emd(whole, config)[0]
    got = emd_segmented(df, config, 62_500).where("kind = 'imf'").select("t", "value").toPandas().sort_values("t")
    assert np.abs(got["value"].to_numpy() - mode).max() < 1e-9
