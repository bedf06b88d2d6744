"""Rows sifted side by side against the plain numerics of one signal."""

import numpy as np
import pyarrow as pa
import pytest

from wavemill.operators import batched, multivariate
from wavemill.operators import kernels as K
from wavemill.operators.directions import direction_vectors

RNG = np.random.default_rng(5)


def signals(n):
    return np.concatenate(
        [RNG.standard_normal((20, n)), RNG.standard_normal((9, n)).cumsum(1), RNG.integers(-2, 3, (20, n)).astype(float), np.ones((2, n)), np.arange(n)[None] * 1.0]
    )


@pytest.mark.parametrize("n", [3, 5, 20, 67, 200])
@pytest.mark.parametrize(
    "config",
    [
        K.EmdConfig(), K.EmdConfig(validate=False, fixed_iterations=1), K.EmdConfig(validate=False, max_siftings=3, max_imfs=2),
        K.EmdConfig(validate=False, sd_threshold=None, s_number=3, energy_threshold=None), K.EmdConfig(relative=True, spline="not_a_knot", max_imfs=2),
    ],
)
def test_rows_are_decomposed_as_alone(n, config):
    x = signals(n)
    modes, rest, codes = batched.emd(x, config)
    for i, row in enumerate(x):
        have = [m[np.flatnonzero(at == i)[0]] for at, m in modes if i in at]
        try:
            want, code = K.emd(row, config), "ok"
        except K.SignalError as e:
            want, code = [], e.code
        assert code == codes[i]
        have += [rest[i]] if code == "ok" else []
        assert len(have) == len(want)
        assert all(np.abs(a - b).max() < 1e-12 * max(1, np.abs(row).max()) for a, b in zip(have, want))
        assert np.abs(batched.first_modes(x, config)[i] - K.first_mode(row, config)).max() < 1e-11 if n < 67 else True


def test_envelopes_of_several_directions(monkeypatch):
    h, v = RNG.standard_normal((3, 90)), direction_vectors(12, 3)
    want, count = K.envelope_sum(h, v)
    for samples in (1, 600, batched.SAMPLES):
        monkeypatch.setattr(batched, "turns", lambda n, rows, s=samples: [slice(i, i + max(1, s // n)) for i in range(0, rows, max(1, s // n))])
        got, turns = batched.envelope_sum(h, v)
        assert turns == count and np.abs(got - want).max() < 1e-12


def test_matrices_are_no_python_numbers():
    held = [np.arange(6.0).reshape(2, 3), None, np.zeros((1, 4))]
    lists = multivariate._lists(held)
    assert lists.type == pa.list_(pa.list_(pa.float64()))
    back = [multivariate._matrix(x) for x in lists]
    assert back[1] is None and all((a == b).all() for a, b in zip(back, held) if b is not None)
    with pytest.raises(K.SignalError):
        multivariate._matrix(pa.array([[[1.0], [1.0, 2.0]]])[0])


def test_without_a_spread_no_noise_is_drawn(spark):
    from wavemill.operators import decompose

    x = {1: np.sin(np.arange(40.0)), 2: np.cos(np.arange(40.0) * 2), 3: np.sin(np.arange(55.0) / 2)}
    df = spark.createDataFrame([(s, t, float(v)) for s, own in x.items() for t, v in enumerate(own)], "series_id long, t int, value double")
    rows = decompose.iceemdan(df, 2, 0.0, config=K.EmdConfig(validate=False, fixed_iterations=1), on_error="drop", noise="none that is known").collect()
    for s, own in x.items():
        want = K.emd(own, K.EmdConfig(validate=False, fixed_iterations=1))[0]
        got = [r.value for r in sorted((r for r in rows if r.series_id == s and r.component == 1), key=lambda r: r.t)]
        assert np.abs(np.array(got) - want).max() < 1e-9


def test_shorter_signals_beside_longer_ones():
    """Signals filled up with NaN, plateaus and many rows among them, against each alone."""
    v = direction_vectors(8, 3, "uniform", 3)  # no two parts are alike, so that sums do not tie by rounding alone
    v[0] = [1, 0, 0]
    own = [RNG.integers(0, 4, (3, n)).astype(float) for n in (40, 64, 65, 90, 7)] + [RNG.standard_normal((3, 61)) for _ in range(40)]
    h = np.full((len(own), 3, 90), np.nan)
    for row, x in zip(h, own):
        row[:, : x.shape[1]] = x
    total, count = batched.envelope_sums(h, v)
    for got, turns, x in zip(total, count, own):
        want, n = K.envelope_sum(x, v)
        assert turns == n and np.abs(got[:, : x.shape[1]] - want).max() < 1e-10 * max(1, np.abs(want).max())
