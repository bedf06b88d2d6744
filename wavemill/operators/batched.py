"""The numerics of many signals of one length at once: rows of a matrix, sifted side by side.

The steps and the stopping rules are those of :mod:`kernels`, with natural splines. All splines of
a matrix are one tridiagonal system, whose blocks do not touch, so that a sifting step is a
fixed number of array operations whatever the number of rows.
"""

from __future__ import annotations

import functools
from dataclasses import replace

import numpy as np

from . import kernels as K

#: Samples that are sifted at once; a task with more takes them in turns.
SAMPLES = 1 << 16


def _with_plateaus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, n = x.shape
    new = np.ones((r, n), bool)
    new[:, 1:] = x[:, 1:] != x[:, :-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], r * n) - 1
    v = x.ravel()[start]
    inner = np.zeros(len(start), bool)
    inner[1:-1] = (start[1:-1] % n > 0) & (end[1:-1] % n < n - 1)
    rise, fall = np.zeros(len(start) + 1, bool), np.zeros(len(start) + 1, bool)
    rise[1:-1], fall[1:-1] = v[1:] > v[:-1], v[1:] < v[:-1]
    middle = (start + end) // 2
    return middle[inner & rise[:-1] & fall[1:]], middle[inner & fall[:-1] & rise[1:]]


def extrema(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row * n + t) of the interior maxima and minima of each row; a plateau counts at its middle.

    A row that is shorter than the others is filled up with NaN, which is no extremum.
    """
    r, n = x.shape
    up, down = x[:, 1:] > x[:, :-1], x[:, 1:] < x[:, :-1]
    flat = np.flatnonzero((x[:, 1:] == x[:, :-1]).any(1))
    up[flat] = down[flat] = False
    found = []
    turn = np.zeros((r, n), bool)
    for before, after in ((up, down), (down, up)):
        np.logical_and(before[:, :-1], after[:, 1:], out=turn[:, 1:-1])
        found.append(np.flatnonzero(turn))
    if len(flat):  # few rows have plateaus
        some = _with_plateaus(x[flat])
        found = [np.sort(np.concatenate([f, flat[p // n] * n + p % n])) for f, p in zip(found, some)]
    return found[0], found[1]


def counts(places: np.ndarray, rows: int, n: int) -> np.ndarray:
    return np.bincount(places // n, minlength=rows)


def _solved(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves blocks of tridiagonal equations for each row of ``rhs``, by taking off neighbours at growing distances.

    The equations of a spline have twice as much on their diagonal as beside it, so what couples
    them vanishes after few steps; blocks end where nothing couples.
    """
    n, step = len(diag), 1
    a, c, r = lower / diag, upper / diag, rhs / diag
    while step < n and max(-a.min(), a.max(), -c.min(), c.max()) > 1e-18:
        back, ahead = a[step:], c[:-step]
        b, new_r, new_a, new_c = np.ones(n), r.copy(), np.zeros(n), np.zeros(n)
        b[step:] -= back * c[:-step]
        b[:-step] -= ahead * a[step:]
        new_r[:, step:] -= back * r[:, :-step]
        new_r[:, :-step] -= ahead * r[:, step:]
        new_a[step:] = -back * a[:-step]
        new_c[:-step] = -ahead * c[step:]
        a, c, r = new_a / b, new_c / b, new_r / b
        step *= 2
    return r


#: Of so many rows and more, equations are swept one by one for all rows together.
SIDE = 64


def _curvatures(row: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Second derivatives at all knots, for each channel; ``first`` and ``last`` are the knots where a row's spline ends."""
    m = np.zeros(rhs.shape)
    depth, rows = int((last - first).max()) - 1, len(first)
    if depth < 1:
        return m
    if len(row) < SIDE * depth:
        lower, diag, upper = np.zeros(len(h)), np.ones(len(h)), np.zeros(len(h))
        lower[1:], upper[:-1] = h[:-1], h[:-1]
        diag[1:-1] = 2 * (h[:-2] + h[1:-1])
        # the curvature of an end is zero: nothing couples with it
        ends = np.concatenate([first, last])
        lower[ends] = upper[ends] = lower[first + 1] = upper[last - 1] = 0.0
        diag[ends] = 1.0
        return _solved(lower, diag, upper, rhs)
    inner = np.ones(len(row), bool)
    inner[first] = inner[last] = False
    inner = np.flatnonzero(inner)
    own = row[inner]
    level = inner - first[own] - 1
    at, channels = level * rows + own, len(rhs)
    d, up, r = np.ones(depth * rows), np.zeros(depth * rows), np.zeros(depth * channels * rows)
    ahead = h[inner]
    d[at] = 2 * (h[inner - 1] + ahead)
    up[at] = ahead
    ends = last - 2 - first
    some = np.flatnonzero(ends >= 0)
    up[ends[some] * rows + some] = 0.0  # the last equation couples with no other
    places = [at if channels == 1 else (level * channels + c) * rows + own for c in range(channels)]
    for c, place in enumerate(places):
        r[place] = rhs[c, inner]
    d, up, wide = d.reshape(depth, rows), up.reshape(depth, rows), r.reshape(depth, channels, rows)
    share, taken, off = np.empty((depth, rows)), np.empty(rows), np.empty((channels, rows))
    for i in range(1, depth):
        np.divide(up[i - 1], d[i - 1], out=share[i])
        d[i] -= np.multiply(share[i], up[i - 1], out=taken)
        wide[i] -= np.multiply(share[i], wide[i - 1], out=off)
    wide /= d[:, None, :]
    for i in range(depth - 2, -1, -1):
        wide[i] -= np.multiply(share[i + 1], wide[i + 1], out=off)
    for c, place in enumerate(places):
        m[c, inner] = r[place]
    return m


#: Samples from one place to the next at which each spline is evaluated.
BLOCK = 8


@functools.cache
def _filling() -> np.ndarray:
    """What the sum of splines is inside a block, by its bends inside and its curvatures and values at both ends.

    Knots are samples, so that the curvature is linear from sample to sample and bends at knots
    alone; second differences of the values follow from it. The map is (BLOCK + 3) x BLOCK.
    """
    inner = BLOCK - 1
    given = np.eye(BLOCK + 3)
    back = np.linalg.inv(np.diag(np.full(inner, -2.0)) + np.eye(inner, k=1) + np.eye(inner, k=-1))

    def between(second: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        second = second.copy()
        second[0] -= left
        second[-1] -= right
        return np.concatenate([left[None], back @ second, right[None]])

    m = between(given[:inner], given[inner], given[inner + 1])
    return between((m[:-2] + 4 * m[1:-1] + m[2:]) / 6, given[inner + 2], given[inner + 3])[:-1].T.copy()


def spline_sums(row: np.ndarray, t: np.ndarray, y: np.ndarray, of: np.ndarray, groups: int, n: int) -> np.ndarray:
    """The sum, over the rows of each group, of natural splines at ``n`` samples: channels x groups x n.

    ``row`` (ascending) and ``t`` are the knots, at least two of each row, ``y`` their values (channels x
    knots) and ``of`` each row's group. A spline is evaluated at every ``BLOCK``-th sample only; in
    between it is its knots' bends that are added up, and one spline is drawn for the whole group.
    """
    rows, blocks = len(of), -(-n // BLOCK)
    wide = blocks * BLOCK
    first = np.searchsorted(row, np.arange(rows))
    last = np.append(first[1:], len(row)) - 1
    h = np.empty(len(t))
    h[:-1] = np.diff(t)
    h[last] = 1.0  # no segment begins at a last knot
    rhs = np.zeros(y.shape)
    rhs[:, 1:-1] = 6 * np.diff(np.diff(y, axis=1) / h[:-1], axis=1)
    rhs[:, first] = rhs[:, last] = 0.0
    m = _curvatures(row, first, last, h, rhs)
    bend = np.zeros(y.shape)
    bend[:, 1:-1] = np.diff(np.diff(m, axis=1) / h[:-1], axis=1)
    bend[:, first] = bend[:, last] = 0.0  # beyond the knots the end cubics go on
    pins = np.arange(blocks + 1) * BLOCK
    each = np.arange(rows)[:, None] * (wide + 1)
    i = np.clip(np.searchsorted(row * (wide + 1) + t, each + pins, side="right") - 1, first[:, None], last[:, None] - 1)
    v = (pins - t[i]).astype(float)
    hi = h[i]
    u = hi - v
    sixth, uu, vv = hi * hi / 6, u * u / 6, v * v / 6
    u, v = u / hi, v / hi
    at, pinned = of[row] * wide + t, (of[:, None] * (blocks + 1) + np.arange(blocks + 1)).ravel()
    given = np.empty((groups, blocks, BLOCK + 3))
    out = np.empty((len(y), groups, n))
    for c in range(len(y)):
        m0, m1 = m[c, i], m[c, i + 1]
        a, b = m0 * u, m1 * v
        value = a * uu + b * vv + (y[c, i] - m0 * sixth) * u + (y[c, i + 1] - m1 * sixth) * v
        given[:, :, : BLOCK - 1] = np.bincount(at, bend[c], groups * wide).reshape(groups, blocks, BLOCK)[:, :, 1:]
        for k, p in enumerate((a + b, value)):
            p = np.bincount(pinned, p.ravel(), groups * (blocks + 1)).reshape(groups, blocks + 1)
            given[:, :, BLOCK - 1 + 2 * k], given[:, :, BLOCK + 2 * k] = p[:, :-1], p[:, 1:]
        out[c] = (given @ _filling()).reshape(groups, wide)[:, :n]
    return out


def _kept(places: np.ndarray, keep: np.ndarray, n: int) -> np.ndarray:
    """The places in rows that are kept, by the rows' new numbers."""
    row = places // n
    number = np.cumsum(keep) - 1
    on = keep[row]
    return number[row[on]] * n + places[on] % n


def _mean_envelopes(x: np.ndarray, tops: np.ndarray, lows: np.ndarray) -> np.ndarray:
    r, n = x.shape
    both = np.concatenate([tops, lows])
    row = both // n
    t, y = both - row * n, x.ravel()[both]
    row[len(tops) :] += r
    return spline_sums(row, t, y[None], np.tile(np.arange(r), 2), r, n)[0] / 2


def _energy(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def sift(x: np.ndarray, c: K.EmdConfig) -> tuple[np.ndarray, np.ndarray]:
    """:func:`kernels.sift` of each row, and which rows did not converge."""
    out, failed = x.copy(), np.zeros(len(x), bool)
    n = x.shape[1]
    at, h = np.arange(len(x)), x
    energy, steady = _energy(x), np.zeros(len(x), int)
    tops, lows = extrema(x)
    with np.errstate(all="ignore"):
        for i in range(c.max_siftings + 1):
            if not len(at) or (c.fixed_iterations is not None and i >= c.fixed_iterations):
                break
            if i >= c.max_siftings:
                failed[at] = True
                break
            go = (counts(tops, len(at), n) >= 2) & (counts(lows, len(at), n) >= 2)
            if not go.all():
                tops, lows = _kept(tops, go, n), _kept(lows, go, n)
                at, h, energy, steady = at[go], h[go], energy[go], steady[go]
                if not len(at):
                    break
            mean = _mean_envelopes(h, tops, lows)
            new = h - mean
            go = np.isfinite(new).all(1)
            if not go.all():
                at, h, mean, new, energy, steady = at[go], h[go], mean[go], new[go], energy[go], steady[go]
                if not len(at):
                    break
            base, now = _energy(h), _energy(new)
            sd = np.where(base > 0, _energy(mean) / base, 0.0)
            change = np.where(energy > 0, np.abs(now - energy) / energy, 0.0)
            tops, lows = extrema(new)
            turns = counts(tops, len(at), n) + counts(lows, len(at), n)
            crossings = ((new[:, 1:] >= 0) != (new[:, :-1] >= 0)).sum(1)
            steady = np.where(np.abs(turns - crossings) <= 1, steady + 1, 0)
            h, energy = new, now
            out[at] = h
            if c.fixed_iterations is None:
                stop = np.zeros(len(at), bool)
                if c.sd_threshold is not None:
                    stop |= sd < c.sd_threshold
                if c.s_number is not None:
                    stop |= steady >= c.s_number
                if c.energy_threshold is not None:
                    stop |= change < c.energy_threshold
                if stop.any():
                    on = ~stop
                    tops, lows = _kept(tops, on, n), _kept(lows, on, n)
                    at, h, energy, steady = at[on], h[on], energy[on], steady[on]
    return out, failed


def _one_by_one(x: np.ndarray, c: K.EmdConfig) -> tuple[list, np.ndarray, list]:
    modes: list[list] = []
    rest, codes = np.zeros_like(x), []
    for i, row in enumerate(x):
        try:
            parts, code = K.emd(row, c), "ok"
        except K.SignalError as e:
            parts, code = [], e.code
        codes.append(code)
        for k, p in enumerate(parts[:-1]):
            if k == len(modes):
                modes.append([])
            modes[k].append((i, p))
        if parts:
            rest[i] = parts[-1]
    return [(np.array([i for i, _ in m]), np.array([p for _, p in m])) for m in modes], rest, codes


def emd(x: np.ndarray, c: K.EmdConfig = K.EmdConfig()) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[str]]:
    """:func:`kernels.emd` of each row: for each mode the rows that have it and the modes, the residues, and each row's code.

    Rows that fail have no modes and a residue without meaning.
    """
    r, n = x.shape
    if c.spline != "natural" or c.boundary == "palindrome_cyclic" or n < 3 or not np.isfinite(x).all():
        return _one_by_one(x, c)
    rest, modes, live, failed = x.copy(), [], np.arange(r), np.zeros(r, bool)
    while len(live) and (not c.max_imfs or len(modes) < c.max_imfs):
        own = rest[live]
        tops, lows = extrema(own)
        go = counts(tops, len(live), n) + counts(lows, len(live), n) >= 2
        live, own = live[go], own[go]
        if not len(live):
            break
        mode, bad = sift(own, c)
        failed[live[bad]] = True
        base = _energy(own)
        go = ~bad & (base > 0) & (_energy(mode) >= 1e-15 * base)
        live, mode = live[go], mode[go]
        if not len(live):
            break
        modes.append((live, mode))
        rest[live] -= mode
    codes = np.where(failed, "convergence_failed", "ok").astype(object)
    if c.validate:
        whole = sum_of(modes, rest)
        limit = c.tolerance * (np.maximum(1.0, np.abs(x).max(1)) if c.relative else 1.0)
        codes[~failed & (np.abs(whole - x).max(1) > limit)] = "reconstruction_failed"
    bad = codes != "ok"
    if bad.any():
        modes = [(at[~bad[at]], m[~bad[at]]) for at, m in modes]
        modes = [(at, m) for at, m in modes if len(at)]
    return modes, rest, codes.tolist()


def sum_of(modes: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray) -> np.ndarray:
    total = np.zeros_like(rest)
    for at, m in modes:
        total[at] += m
    return total + rest


def first_modes(x: np.ndarray, c: K.EmdConfig) -> np.ndarray:
    """:func:`kernels.first_mode` of each row."""
    modes, rest, codes = emd(x, replace(c, max_imfs=1, validate=False))
    out = np.where((np.array(codes) == "ok")[:, None], rest, x)
    if modes:
        out[modes[0][0]] = modes[0][1]
    return out


def nth_modes(x: np.ndarray, k: int, c: K.EmdConfig) -> np.ndarray:
    """The mode ``k`` (from 0) of each row, zero where it has none."""
    modes, _, _ = emd(x, replace(c, max_imfs=0, validate=False))
    out = np.zeros_like(x)
    if k < len(modes):
        out[modes[k][0]] = modes[k][1]
    return out


def turns(n: int, rows: int, samples: int = SAMPLES) -> list[slice]:
    """Rows of ``n`` samples in runs of ``samples`` in all, or of one row."""
    some = max(1, samples // max(n, 1))
    return [slice(i, i + some) for i in range(0, rows, some)]


def envelope_sums(h: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`kernels.envelope_sum` of each of several signals (signals x channels x n), which NaN fills up to one length."""
    s, channels, n = h.shape
    total, count = np.zeros(h.shape), np.zeros(s, int)
    for some in turns(n * s, len(directions)):
        d = len(directions[some])
        row, t, of, begun = [], [], [], 0
        for places in extrema((directions[some] @ h).reshape(s * d, n)):
            own = counts(places, s * d, n)
            count += own.reshape(s, d).sum(1)
            places = _kept(places, own >= 2, n)
            row.append(places // n + begun)
            t.append(places % n)
            of.append(np.flatnonzero(own >= 2) // d)
            begun += len(of[-1])
        if begun:
            row, t, of = (np.concatenate(a) for a in (row, t, of))
            total += spline_sums(row, t, h.transpose(1, 0, 2)[:, of[row], t], of, s, n).transpose(1, 0, 2) / 2
    return total, count


def envelope_sum(h: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, int]:
    """:func:`kernels.envelope_sum` with several directions at a time."""
    total, count = envelope_sums(h[None], directions)
    return total[0], int(count[0])
