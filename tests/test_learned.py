"""Boundary predictors fitted over frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import decompose, training
from wavemill.operators.training import BoundaryModel


@pytest.fixture(scope="module")
def waves(spark):
    """Decaying oscillations, which a linear predictor knows, with a little noise."""
    rng = np.random.default_rng(7)
    rows = []
    for s in range(20):
        x = rng.standard_normal(120) * 0.05
        for t in range(2, 120):
            x[t] += 1.6 * x[t - 1] - 0.9 * x[t - 2]
        rows += [(s, t, float(v) + s) for t, v in enumerate(x)]
    rows += [(100, t, 1.0 * t) for t in range(7)]
    return spark.createDataFrame(rows, "series_id long, t int, value double").repartition(6)


def test_fit_is_least_squares(waves):
    pairs = training.boundary_pairs(waves, 6, 4)
    model = training.fit_boundary(pairs, 6, 4)
    held = pairs.collect()
    c, y = np.array([r.context for r in held]), np.array([r.target for r in held])
    x = np.concatenate([c[:, :-1] - c[:, -1:], np.ones((len(c), 1))], axis=1)
    want = np.linalg.lstsq(x, y - c[:, -1:], rcond=None)[0]
    assert np.allclose(model.weights, want.T, atol=1e-8)
    errors = {r.part: r for r in training.prediction_errors(pairs, model, F.lit("all")).collect()}["all"]
    assert errors.pairs == len(held)
    assert errors.mse_model == pytest.approx(((y - c[:, -1:] - x @ want) ** 2).mean())
    assert errors.mse_last == pytest.approx(((y - c[:, -1:]) ** 2).mean())


def test_held_out_error_is_below_the_last_value(waves):
    pairs = training.boundary_pairs(waves)
    out = F.col("series_id") % 4 == 0
    model = training.fit_boundary(pairs.where(~out))
    by = {r.part: r for r in training.prediction_errors(pairs, model, out).collect()}
    assert by[True].mse_model < 0.5 * by[True].mse_last


def test_model_is_stored_and_extends_by_name(spark, waves, tmp_path):
    model = training.fit_boundary(training.boundary_pairs(waves, 6, 4), 6, 4)
    model.save(spark, str(tmp_path / "model"))
    assert BoundaryModel.load(spark, str(tmp_path / "model")) == model
    rows = decompose.extend(waves, "learned", model=model).collect()
    x = {s: [r.value for r in sorted(waves.where(f"series_id = {s}").collect())] for s in (3, 100)}
    for r in rows:
        assert r.end - r.start == (7 if r.series_id == 100 else 120) and len(r.x) == r.end + 4 and r.start == 4
        if r.series_id in x:
            own = np.array(x[r.series_id])
            predict = lambda c: c[-1] + np.array(model.weights) @ [*(c[:-1] - c[-1]), 1.0]
            assert np.allclose(r.x, [*predict(own[:6][::-1])[::-1], *own, *predict(own[-6:])])


def test_short_signals_and_missing_models(spark, waves):
    model = BoundaryModel(((0.0,) * 10,) * 3)
    short = spark.createDataFrame([(0, 0, 2.0), (0, 1, 5.0)], "series_id long, t int, value double")
    assert decompose.extend(short, "learned", model=model).first().x == [2.0] * 3 + [2.0, 5.0] + [5.0] * 3
    with pytest.raises(TypeError):
        decompose.extend(waves, "learned")
    bad = spark.createDataFrame([([1.0, float("nan")], [1.0])], "context array<double>, target array<double>")
    with pytest.raises(ValueError):
        training.fit_boundary(bad, 2, 1)
    none = training.fit_boundary(training.boundary_pairs(short))
    assert set(w for row in none.weights for w in row) == {0.0}
