"""The catalogue's queries once more, in SQL, from the tables up."""

from __future__ import annotations

from ..operators.directions import direction_vectors

SIG = """sig AS (SELECT user_id AS series_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, value FROM events),
num AS (SELECT series_id, CAST(count(*) AS INTEGER) AS n FROM sig GROUP BY series_id)"""

HOURS = """hr AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2),
cal AS (SELECT unnest(generate_series((SELECT min(h) FROM hr), (SELECT max(h) FROM hr), INTERVAL 1 HOUR)) AS h),
typ AS (SELECT e.event_type AS component, CAST(row_number() OVER (PARTITION BY e.event_type ORDER BY cal.h) - 1 AS INTEGER) AS t,
  coalesce(hr.value, 0.0) AS value
  FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN cal
  LEFT JOIN hr ON hr.event_type = e.event_type AND hr.h = cal.h)"""

RUNS = """chg AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value THEN 1 ELSE 0 END AS c FROM sig
  WINDOW w AS (PARTITION BY series_id ORDER BY t)),
rid AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t) AS run FROM chg),
run AS (SELECT series_id, run, min(t) AS a, max(t) AS b, min(value) AS value FROM rid GROUP BY 1, 2),
nb AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM run WINDOW w AS (PARTITION BY series_id ORDER BY run)),
ext AS (SELECT series_id, CAST((a + b) // 2 AS INTEGER) AS t, CASE WHEN value > l THEN 'max' ELSE 'min' END AS kind, value
  FROM nb WHERE (value > l AND value > r) OR (value < l AND value < r))"""

#: Statistics of rolling variances by direct sums.
STAT = """win AS (SELECT s.series_id, num.n, greatest(5, least(50, num.n // 4)) AS w FROM num JOIN (SELECT DISTINCT series_id FROM sig) s USING (series_id)),
st AS (SELECT a.series_id, a.t, var_pop(b.value) AS v FROM sig a JOIN win ON win.series_id = a.series_id
  JOIN sig b ON b.series_id = a.series_id AND b.t >= a.t AND b.t < a.t + win.w
  WHERE a.t < win.n - win.w GROUP BY 1, 2),
sp AS (SELECT series_id, var_pop(v) AS spread FROM st GROUP BY 1),
al AS (SELECT series_id, count(*) AS n, var_pop(value) AS v FROM sig GROUP BY 1),
sc AS (SELECT al.series_id, al.n, CASE WHEN al.n < 10 THEN 0.5 WHEN al.v < 1e-10 THEN 1.0
  ELSE 1.0 / (1.0 + coalesce(sp.spread, 0.0) / (al.v * al.v + 1e-10)) END AS score FROM al LEFT JOIN sp USING (series_id))"""


def _dft(source: str, keys: str, name: str) -> str:
    """Fourier sums of ``source(keys, t, value)`` over the length padded to a power of two."""
    return f"""{name}_n AS (SELECT {keys}, CAST(pow(2, ceil(log2(count(*)))) AS INTEGER) AS p FROM {source} GROUP BY {keys}),
{name}_k AS (SELECT {keys}, p, unnest(range(p)) AS bin FROM {name}_n),
{name} AS (SELECT {keys}, p, bin, sum(value * cos(2 * pi() * ((bin * t) % p) / p)) AS re, -sum(value * sin(2 * pi() * ((bin * t) % p) / p)) AS im
  FROM {name}_k JOIN {source} USING ({keys}) GROUP BY {keys}, p, bin)"""


ANALYTIC = _dft("sig", "series_id", "ft") + """,
one AS (SELECT series_id, p, bin, re * g AS re, im * g AS im FROM (SELECT *, CASE WHEN bin = 0 OR bin = p // 2 THEN 1.0 WHEN bin < p // 2 THEN 2.0 ELSE 0.0 END AS g FROM ft)),
ana AS (SELECT sig.series_id, sig.t,
  sum(re * cos(2 * pi() * ((bin * t) % p) / p) - im * sin(2 * pi() * ((bin * t) % p) / p)) / max(p) AS re,
  sum(re * sin(2 * pi() * ((bin * t) % p) / p) + im * cos(2 * pi() * ((bin * t) % p) / p)) / max(p) AS im
  FROM sig JOIN one USING (series_id) GROUP BY 1, 2)"""

INST = ANALYTIC + """,
ang AS (SELECT *, sqrt(re * re + im * im) AS amp, atan2(im, re) AS a FROM ana),
trn AS (SELECT *, coalesce(round((a - lag(a) OVER (PARTITION BY series_id ORDER BY t)) / (2 * pi())), 0) AS k FROM ang),
phs AS (SELECT *, a - 2 * pi() * sum(k) OVER (PARTITION BY series_id ORDER BY t) AS ph FROM trn),
ins AS (SELECT series_id, t, amp, CASE WHEN lag(ph) OVER w IS NOT NULL AND lead(ph) OVER w IS NOT NULL THEN (lead(ph) OVER w - lag(ph) OVER w) / 2
  WHEN lead(ph) OVER w IS NOT NULL THEN lead(ph) OVER w - ph WHEN lag(ph) OVER w IS NOT NULL THEN ph - lag(ph) OVER w ELSE 0.0 END / (2 * pi()) AS freq
  FROM phs WINDOW w AS (PARTITION BY series_id ORDER BY t))"""

PAD = """pd AS (SELECT series_id, n, CASE WHEN n < 10 THEN greatest(n, 5) // 2
  ELSE least(greatest(5, least(CAST(floor(n * 0.12) AS INTEGER), CAST(floor(n * 0.3) AS INTEGER))), n // 3) END AS p FROM num)"""

_INPUT = f"WITH {SIG} SELECT series_id, t, round(value, 6) + 0.0 AS value FROM sig"
_SUPPLIERS = """sup AS MATERIALIZED (SELECT l_suppkey AS series_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_quantity, l_extendedprice, l_discount) - 1 AS INTEGER) AS t, l_quantity AS c0, l_extendedprice / 1000 AS c1, l_discount * 100 AS c2 FROM lineitem),
sch AS MATERIALIZED (SELECT series_id, channel, t, CASE channel WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS value FROM sup, (SELECT unnest([0, 1, 2]) AS channel))"""
_CHANNEL_INPUT = f"WITH {_SUPPLIERS} SELECT series_id, channel, t, round(value, 6) + 0.0 AS value FROM sch"


def _memd_once(directions: int) -> str:
    """A signal less the mean, over directions, of splines through its channels at the extrema of its projections."""
    rows = ", ".join(f"({i}, " + ", ".join(repr(float(v)) for v in d) + ")" for i, d in enumerate(direction_vectors(directions, 3)))
    key = "PARTITION BY series_id, d"
    line = "PARTITION BY series_id, d, kind, channel"
    same = "k.series_id = f.series_id AND k.d = f.d AND k.kind = f.kind AND k.channel = f.channel"
    return f"""WITH RECURSIVE {_SUPPLIERS},
dir AS (SELECT * FROM (VALUES {rows}) v(d, w0, w1, w2)),
pj AS MATERIALIZED (SELECT series_id, d, t, c0 * CAST(w0 AS DOUBLE) + c1 * CAST(w1 AS DOUBLE) + c2 * CAST(w2 AS DOUBLE) AS value FROM sup, dir),
chg AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value THEN 1 ELSE 0 END AS c FROM pj WINDOW w AS ({key} ORDER BY t)),
rid AS (SELECT *, sum(c) OVER ({key} ORDER BY t) AS run FROM chg),
run AS (SELECT series_id, d, run, min(t) AS a, max(t) AS b, min(value) AS value FROM rid GROUP BY 1, 2, 3),
nb AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM run WINDOW w AS ({key} ORDER BY run)),
kn AS (SELECT series_id, d, CAST((a + b) // 2 AS INTEGER) AS t, CASE WHEN value > l THEN 'max' ELSE 'min' END AS kind FROM nb
  WHERE (value > l AND value > r) OR (value < l AND value < r)),
ka AS (SELECT series_id, d, kind, channel, t, sch.value, row_number() OVER w AS i, count(*) OVER ({line}) AS m,
  lead(t) OVER w - t AS h, (lead(sch.value) OVER w - sch.value) / (lead(t) OVER w - t) AS s FROM kn JOIN sch USING (series_id, t) WINDOW w AS ({line} ORDER BY t)),
kb AS MATERIALIZED (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp FROM ka WHERE m >= 2 WINDOW w AS ({line} ORDER BY t)),
fw AS (SELECT series_id, d, kind, channel, i, m, h, CAST(2 * (hp + h) AS DOUBLE) AS e, CAST(6 * (s - sp) AS DOUBLE) AS r FROM kb WHERE i = 2 AND m > 2
  UNION ALL SELECT k.series_id, k.d, k.kind, k.channel, k.i, k.m, k.h, 2 * (k.hp + k.h) - k.hp / f.e * k.hp, 6 * (k.s - k.sp) - k.hp / f.e * f.r
  FROM fw f JOIN kb k ON {same} AND k.i = f.i + 1 WHERE k.i < k.m),
fm AS MATERIALIZED (SELECT * FROM fw),
bk AS (SELECT series_id, d, kind, channel, m AS i, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT series_id, d, kind, channel, m FROM kb)
  UNION ALL SELECT k.series_id, k.d, k.kind, k.channel, k.i, (k.r - k.h * f.c) / k.e FROM bk f JOIN fm k ON {same} AND k.i = f.i - 1),
sg AS MATERIALIZED (SELECT *, CASE WHEN i = 1 THEN -1 ELSE t END AS low FROM (SELECT *, lead(c) OVER w AS c2, lead(value) OVER w AS v2, lead(t) OVER w AS t2
  FROM (SELECT b.*, coalesce(bk.c, 0.0) AS c FROM kb b LEFT JOIN bk USING (series_id, d, kind, channel, i)) WINDOW w AS ({line} ORDER BY t)) WHERE i < m),
ev AS (SELECT s.series_id, s.channel, s.t, s.value, k.d, k.kind FROM sch s JOIN (SELECT DISTINCT series_id, d, kind FROM sg) k USING (series_id)),
me AS (SELECT a.series_id, a.channel, a.t, sum((g.c * pow(g.t2 - a.t, 3) + g.c2 * pow(a.t - g.t, 3)) / (6 * g.h)
  + (g.value / g.h - g.c * g.h / 6) * (g.t2 - a.t) + (g.v2 / g.h - g.c2 * g.h / 6) * (a.t - g.t)) / {2 * directions} AS mean
  FROM ev a ASOF JOIN sg g ON g.series_id = a.series_id AND g.channel = a.channel AND g.d = a.d AND g.kind = a.kind AND a.t >= g.low GROUP BY 1, 2, 3)
SELECT sch.series_id, sch.channel, sch.t, round(sch.value - coalesce(me.mean, 0), 4) + 0.0 AS value FROM sch LEFT JOIN me USING (series_id, channel, t)"""


def _placed(ctes: str, total: str, index: str, sign: str = "1") -> str:
    """The signal read at ``index`` for each place ``j`` of an extension that is ``total`` long."""
    return f"""WITH {SIG}, {ctes} pos AS (SELECT *, unnest(range(CAST({total} AS BIGINT))) AS j FROM base),
ix AS (SELECT series_id, CAST(j AS INTEGER) AS t, {index} AS i, {sign} AS sgn FROM pos)
SELECT ix.series_id, ix.t, round(sig.value * ix.sgn, 6) + 0.0 AS value FROM ix JOIN sig ON sig.series_id = ix.series_id AND sig.t = ix.i"""


_MIRROR = "base AS (SELECT series_id, n, least(greatest(4, least(n, 20)), n) AS m FROM num),"
_MIRROR_AT = "CASE WHEN j < m THEN m - 1 - j WHEN j < m + n THEN j - m ELSE j - m - m END"

PAIRS = f"""{HOURS}, pr AS (SELECT a.component AS i, b.component AS j, count(*) AS n, sum(a.value * b.value) AS dot, sum(a.value) AS si,
  sum(b.value) AS sj, sum(a.value * a.value) AS ei, sum(b.value * b.value) AS ej
  FROM typ a JOIN typ b ON a.t = b.t AND a.component < b.component GROUP BY 1, 2)"""
_CORR = """co AS (SELECT i, j, CASE WHEN ei - si * si / n > 1e-12 AND ej - sj * sj / n > 1e-12
  THEN (dot - si * sj / n) / sqrt((ei - si * si / n) * (ej - sj * sj / n)) ELSE 0.0 END AS correlation FROM pr)"""
OVERLAP = f"""{HOURS}, {_dft("typ", "component", "ft")},
pw AS (SELECT component, bin, re * re + im * im AS power FROM ft WHERE bin <= p // 2),
sh AS (SELECT component, bin, power / sum(power) OVER (PARTITION BY component) AS q FROM pw),
ov AS (SELECT a.component AS i, b.component AS j, sum(least(a.q, b.q)) AS overlap FROM sh a JOIN sh b
  ON a.bin = b.bin AND a.component < b.component GROUP BY 1, 2)"""
_SEVERITY = "CASE WHEN round({0}, 9) < 0.1 THEN 'ok' WHEN round({0}, 9) <= 0.3 THEN 'caution' ELSE 'serious' END"

_IMAGE = "cell AS (SELECT CAST(vec_id AS INTEGER) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_VOLUME = "cell AS (SELECT CAST(vec_id % 4 AS INTEGER) AS z, CAST(vec_id // 4 AS INTEGER) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS x, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def _extrema(cells: str, axes: list[str], neighbours: int) -> str:
    cols = ", ".join(f"a.{a}" for a in axes)
    # one shifted copy of the cells for every offset keeps the join an equality
    offs = "off AS (SELECT * FROM " + " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a}) AS o{a}" for a in axes) + ")"
    shifted = ", ".join(f"{a} + d{a} AS {a}" for a in axes)
    zero = " AND ".join(f"d{a} = 0" for a in axes)
    return f"""WITH {cells}, {offs},
nb AS (SELECT {shifted}, value FROM cell CROSS JOIN off WHERE NOT ({zero})),
mm AS (SELECT {", ".join(axes)}, max(value) AS hi, min(value) AS lo, count(*) AS n FROM nb GROUP BY {", ".join(axes)})
SELECT {cols}, CASE WHEN a.value > mm.hi THEN 'max' ELSE 'min' END AS kind, round(a.value, 6) + 0.0 AS value
FROM cell a JOIN mm USING ({", ".join(axes)}) WHERE mm.n = {neighbours} AND (a.value > mm.hi OR a.value < mm.lo)"""


def _entropy(keys: str) -> str:
    return f"""tt AS (SELECT *, (re * re + im * im) AS pw FROM ft), tq AS (SELECT *, pw / sum(pw) OVER (PARTITION BY {keys}) AS q,
  sum(pw) OVER (PARTITION BY {keys}) AS total FROM tt),
en AS (SELECT {keys}, coalesce(sum(CASE WHEN total > 1e-10 AND q > 1e-10 THEN -q * ln(q) END), 0.0) AS entropy FROM tq GROUP BY {keys})"""


def _radical(base: int) -> str:
    terms = " + ".join(f"((i // {base**k}) % {base}) / {float(base ** (k + 1))!r}" for k in range(8))
    return f"({terms})"


def _sequence(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(i AS BIGINT) AS i, {d} AS dim, round({c}, 9) + 0.0 AS value FROM range(64) r(i)" for d, c in enumerate(columns)
    )


#: One sifting step: natural splines through maxima and minima by the tridiagonal sweep, row by row.
SIFT = f"""WITH RECURSIVE {SIG}, {RUNS},
k0 AS (SELECT series_id, kind, t, value, row_number() OVER (PARTITION BY series_id, kind ORDER BY t) AS i,
  count(*) OVER (PARTITION BY series_id, kind) AS m FROM ext),
k1 AS (SELECT *, lead(t) OVER w - t AS h, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS s FROM k0 WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
k2 AS (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp FROM k1 WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
fw AS (SELECT series_id, kind, i, m, h, CAST(2 * (hp + h) AS DOUBLE) AS d, CAST(6 * (s - sp) AS DOUBLE) AS r FROM k2 WHERE i = 2 AND m > 2
  UNION ALL SELECT k.series_id, k.kind, k.i, k.m, k.h, 2 * (k.hp + k.h) - k.hp / fw.d * k.hp, 6 * (k.s - k.sp) - k.hp / fw.d * fw.r
  FROM fw JOIN k2 k ON k.series_id = fw.series_id AND k.kind = fw.kind AND k.i = fw.i + 1 WHERE k.i < k.m),
bk AS (SELECT series_id, kind, m AS i, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT series_id, kind, m FROM k0)
  UNION ALL SELECT fw.series_id, fw.kind, fw.i, (fw.r - fw.h * bk.c) / fw.d FROM bk JOIN fw ON fw.series_id = bk.series_id AND fw.kind = bk.kind AND fw.i = bk.i - 1),
cv AS (SELECT k1.*, coalesce(bk.c, 0.0) AS c FROM k1 LEFT JOIN bk USING (series_id, kind, i)),
sg AS (SELECT *, lead(c) OVER w AS c2, lead(value) OVER w AS v2, lead(t) OVER w AS t2 FROM cv WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
en AS (SELECT s.series_id, s.t, g.kind, (g.c * pow(g.t2 - s.t, 3) + g.c2 * pow(s.t - g.t, 3)) / (6 * g.h)
  + (g.value / g.h - g.c * g.h / 6) * (g.t2 - s.t) + (g.v2 / g.h - g.c2 * g.h / 6) * (s.t - g.t) AS e
  FROM sig s JOIN sg g ON g.series_id = s.series_id AND g.i < g.m
   AND (s.t >= g.t OR g.i = 1) AND (s.t < g.t2 OR g.i = g.m - 1)),
me AS (SELECT series_id, t, sum(e) / 2 AS mean FROM en GROUP BY 1, 2)
SELECT sig.series_id, sig.t, round(sig.value - me.mean, 4) + 0.0 AS value FROM sig JOIN me USING (series_id, t)"""


def _envelopes(src: str, k: str) -> str:
    """``mean{k}``: the mean of natural splines through maxima and minima of ``src(series_id, t, value)``; ``kn{k}``: its extrema.

    A series with fewer than two knots for either has no mean. The tridiagonal sweep is row by row.
    """
    return f"""chg{k} AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR lag(value) OVER w <> value THEN 1 ELSE 0 END AS c FROM {src}
  WINDOW w AS (PARTITION BY series_id ORDER BY t)),
rid{k} AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t) AS run FROM chg{k}),
run{k} AS (SELECT series_id, run, min(t) AS a, max(t) AS b, min(value) AS value FROM rid{k} GROUP BY 1, 2),
nb{k} AS (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM run{k} WINDOW w AS (PARTITION BY series_id ORDER BY run)),
kn{k} AS MATERIALIZED (SELECT series_id, CAST((a + b) // 2 AS INTEGER) AS t, CASE WHEN value > l THEN 'max' ELSE 'min' END AS kind, value
  FROM nb{k} WHERE (value > l AND value > r) OR (value < l AND value < r)),
both{k} AS (SELECT series_id FROM kn{k} GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 'max') >= 2 AND count(*) FILTER (WHERE kind = 'min') >= 2),
ka{k} AS (SELECT series_id, kind, t, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id, kind) AS m,
  lead(t) OVER w - t AS h, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS s FROM kn{k} JOIN both{k} USING (series_id)
  WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
kb{k} AS MATERIALIZED (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp FROM ka{k} WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
fw{k} AS (SELECT series_id, kind, i, m, h, CAST(2 * (hp + h) AS DOUBLE) AS d, CAST(6 * (s - sp) AS DOUBLE) AS r FROM kb{k} WHERE i = 2 AND m > 2
  UNION ALL SELECT k.series_id, k.kind, k.i, k.m, k.h, 2 * (k.hp + k.h) - k.hp / f.d * k.hp, 6 * (k.s - k.sp) - k.hp / f.d * f.r
  FROM fw{k} f JOIN kb{k} k ON k.series_id = f.series_id AND k.kind = f.kind AND k.i = f.i + 1 WHERE k.i < k.m),
fm{k} AS MATERIALIZED (SELECT * FROM fw{k}),
bk{k} AS (SELECT series_id, kind, m AS i, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT series_id, kind, m FROM kb{k})
  UNION ALL SELECT f.series_id, f.kind, f.i, (f.r - f.h * b.c) / f.d FROM bk{k} b JOIN fm{k} f ON f.series_id = b.series_id AND f.kind = b.kind AND f.i = b.i - 1),
sg{k} AS MATERIALIZED (SELECT *, lead(c) OVER w AS c2, lead(value) OVER w AS v2, lead(t) OVER w AS t2
  FROM (SELECT b.*, coalesce(bk{k}.c, 0.0) AS c FROM kb{k} b LEFT JOIN bk{k} USING (series_id, kind, i)) WINDOW w AS (PARTITION BY series_id, kind ORDER BY t)),
mean{k} AS MATERIALIZED (SELECT s.series_id, s.t, sum((g.c * pow(g.t2 - s.t, 3) + g.c2 * pow(s.t - g.t, 3)) / (6 * g.h)
  + (g.value / g.h - g.c * g.h / 6) * (g.t2 - s.t) + (g.v2 / g.h - g.c2 * g.h / 6) * (s.t - g.t)) / 2 AS mean
  FROM {src} s JOIN sg{k} g ON g.series_id = s.series_id AND g.i < g.m AND (s.t >= g.t OR g.i = 1) AND (s.t < g.t2 OR g.i = g.m - 1) GROUP BY 1, 2)"""


def _decomposed(src: str, tag: str, depth: int) -> str:
    """``fin{tag}(series_id, component, kind, t, value)``: modes of one sifting step each, and residue, of ``src``.

    A series goes on while it has two extrema; without two knots for either envelope all that is left is a mode.
    """
    out, now, parts = [], src, []
    for k in range(1, depth + 1):
        n = f"{tag}{k}"
        out += [
            _envelopes(now, n),
            f"live{n} AS (SELECT series_id FROM kn{n} GROUP BY 1 HAVING count(*) >= 2)",
            f"lv{n} AS MATERIALIZED (SELECT s.series_id, s.t, s.value, coalesce(s.value - m.mean, s.value) AS mode FROM {now} s"
            f" JOIN live{n} USING (series_id) LEFT JOIN mean{n} m USING (series_id, t))",
            f"re{n} AS MATERIALIZED (SELECT series_id, t, value - mode AS value FROM lv{n})",
        ]
        parts += [
            f"SELECT series_id, {k} AS component, 'imf' AS kind, t, mode AS value FROM lv{n}",
            f"SELECT series_id, {k}, 'residue', t, value FROM {now} WHERE series_id NOT IN (SELECT series_id FROM live{n})",
        ]
        now = f"re{n}"
    parts.append(f"SELECT series_id, {depth + 1}, 'residue', t, value FROM {now}")
    return ",\n".join([*out, f"fin{tag} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"])


#: Levels that the short series of the small tables do not use up.
_DEPTH = 7


def _modes(number: str = "component", kind: bool = True) -> str:
    columns = f"series_id, CAST({number} AS INTEGER) AS component, " + ("kind, " if kind else "") + "t, round(value, 4) + 0.0 AS value"
    return f"WITH RECURSIVE {SIG}, {_decomposed('sig', 'a', _DEPTH)} SELECT {columns} FROM fina"


def _hashed(key: str, name: str = "nz") -> str:
    """``name(series_id, trial, t, z)``: two trials of normal deviates by hashes of ``key``."""
    u = lambda k: f"(CAST('0x' || substr(md5({key} || ':{k}:' || t), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE"
    return f"""{name} AS MATERIALIZED (SELECT series_id, trial, t, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z
  FROM (SELECT series_id, trial, t, {u(0)} AS u, {u(1)} AS v FROM sig, range(2) r(trial)))"""


_TRIAL = "'0:' || series_id || ':' || trial"


def _added(name: str, source: str, signs: tuple[int, ...] = (1,), noise: str = "nz") -> str:
    """``name``: a series for each trial and sign of ``source`` with noise at a fifth of its spread; the first id is a multiple of their number."""
    return f"""{name} AS MATERIALIZED (SELECT s.series_id * {2 * len(signs)} + z.trial * {len(signs)} + g.i AS series_id, t, s.value + g.sign * 0.2 * p.sd * z.z AS value FROM {source} s
  JOIN {noise} z USING (series_id, t) JOIN (SELECT series_id, stddev_pop(value) AS sd FROM {source} GROUP BY 1) p USING (series_id),
  (SELECT unnest([{', '.join(map(str, signs))}]) AS sign, unnest(range({len(signs)})) AS i) g)"""


def _ensemble_once(signs: tuple[int, ...]) -> str:
    many = 2 * len(signs)
    return f"""WITH RECURSIVE {SIG}, {_hashed(_TRIAL)}, {_added('ns', 'sig', signs)}, {_decomposed('ns', 'a', 1)}
SELECT series_id // {many} AS series_id, CAST(CASE WHEN kind = 'residue' THEN 0 ELSE component END AS INTEGER) AS component, t, round(sum(value) / {many}, 4) + 0.0 AS value
FROM fina GROUP BY 1, 2, 3"""


def _first_mode(rule: str, steps: int) -> str:
    """The first mode when ``rule`` (over sd, steady and change) stops the sifting, within ``steps`` steps."""
    out = ["h0 AS MATERIALIZED (SELECT series_id, t, value, false AS done, 0 AS steady FROM sig)"]
    for i in range(1, steps + 1):
        p, k = f"h{i - 1}", f"m{i}"
        out += [
            _envelopes(p, k),
            f"st{i} AS MATERIALIZED (SELECT h.series_id, h.t, h.value, h.done, h.steady, m.mean, h.value - m.mean AS new FROM {p} h LEFT JOIN mean{k} m USING (series_id, t))",
            f"""cr{i} AS (SELECT *, CASE WHEN lag(new) OVER w IS NOT NULL AND (new >= 0) <> (lag(new) OVER w >= 0) THEN 1 ELSE 0 END AS z,
  CASE WHEN (new > lag(new) OVER w AND new > lead(new) OVER w) OR (new < lag(new) OVER w AND new < lead(new) OVER w) THEN 1 ELSE 0 END AS x
  FROM st{i} WINDOW w AS (PARTITION BY series_id ORDER BY t))""",
            f"""ru{i} AS MATERIALIZED (SELECT *, ({rule}) AS stop FROM (SELECT series_id, bool_or(done OR mean IS NULL) AS over, sum(mean * mean) / sum(value * value) AS sd,
  abs(sum(new * new) - sum(value * value)) / sum(value * value) AS change, CASE WHEN abs(sum(x) - sum(z)) <= 1 THEN max(steady) + 1 ELSE 0 END AS steady FROM cr{i} GROUP BY 1))""",
            f"h{i} AS MATERIALIZED (SELECT s.series_id, s.t, CASE WHEN r.over THEN s.value ELSE s.new END AS value, r.over OR r.stop AS done, r.steady FROM st{i} s JOIN ru{i} r USING (series_id))",
        ]
    return f"WITH RECURSIVE {SIG}, " + ",\n".join(out) + f" SELECT series_id, t, round(value, 4) + 0.0 AS value FROM h{steps} WHERE done"


def _grid_modes(cells: str, axes: tuple[str, ...], lines: list[tuple[str, ...]]) -> str:
    """Parts of one mode and residue (0) along each of ``lines``' axes in turn, of ``cell``; lines that lack a mode have zero there."""
    out, now, have = [cells], "cell", []
    for n, (along, name) in enumerate(lines):
        others = [a for a in axes if a != along]
        keys = [*others, *have]
        out += [
            f"id{n} AS MATERIALIZED (SELECT *, CAST(dense_rank() OVER (ORDER BY {', '.join(keys)}) AS BIGINT) AS series_id, CAST({along} AS INTEGER) AS t FROM {now})",
            f"sr{n} AS MATERIALIZED (SELECT series_id, t, value FROM id{n})",
            _decomposed(f"sr{n}", f"g{n}", 1),
            f"pt{n} AS MATERIALIZED (SELECT {', '.join('i.' + c for c in [*axes, *have])}, CASE WHEN f.kind = 'imf' THEN 1 ELSE 0 END AS {name}, f.value FROM fing{n} f JOIN id{n} i USING (series_id, t))",
        ]
        have = [*have, name]
        now = f"pt{n}"
        if n + 1 < len(lines):
            spread = ", ".join(f"c.{c}" for c in axes)
            got = ", ".join(f"k.{c}" for c in have)
            same = " AND ".join([f"p.{c} = c.{c}" for c in axes] + [f"p.{c} = k.{c}" for c in have])
            out.append(
                f"fl{n} AS MATERIALIZED (SELECT {spread}, {got}, coalesce(p.value, 0.0) AS value FROM cell c CROSS JOIN (SELECT DISTINCT {', '.join(have)} FROM pt{n}) k LEFT JOIN pt{n} p ON {same})"
            )
            now = f"fl{n}"
    picked = ", ".join([*[f"CAST({c} AS INTEGER) AS {c}" for c in have], *axes])
    return f"WITH RECURSIVE {', '.join(out)} SELECT {picked}, round(value, 4) + 0.0 AS value FROM {now}"


#: Two tones for each region, by its key.
_TONES = "SELECT CAST(r_regionkey AS BIGINT) AS series_id, CAST(5 + r_regionkey AS INTEGER) AS low, CAST(50 + 3 * r_regionkey AS INTEGER) AS high FROM region"


def _entropies(keys: str) -> str:
    """``rep``: the three entropies and score of each series of ``sig``."""
    return f"""{_dft('sig', 'series_id', 'ft')}, {_entropy('series_id')},
wv AS MATERIALIZED (SELECT series_id, t, value AS a, lead(value, 1) OVER x AS b, lead(value, 2) OVER x AS c FROM sig WINDOW x AS (PARTITION BY series_id ORDER BY t)),
pt AS (SELECT series_id, CASE WHEN a <= b THEN 1 ELSE 0 END * 4 + CASE WHEN a <= c THEN 1 ELSE 0 END * 2 + CASE WHEN b <= c THEN 1 ELSE 0 END AS pat FROM wv WHERE c IS NOT NULL),
pk AS (SELECT series_id, pat, count(*) AS n FROM pt GROUP BY 1, 2),
pe AS (SELECT series_id, least(1.0, sum(-q * ln(q)) / ln(6)) AS permutation FROM (SELECT series_id, n * 1.0 / sum(n) OVER (PARTITION BY series_id) AS q FROM pk) GROUP BY 1),
dv AS (SELECT series_id, 0.2 * stddev_pop(value) AS r, count(*) AS n FROM sig GROUP BY 1),
sm AS (SELECT series_id, CASE WHEN a > 0 AND b > 0 THEN -ln(a * 1.0 / b) ELSE 0.0 END AS sample FROM (SELECT i.series_id,
  sum(CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b)) <= r AND j.t < n - 2 THEN 1 ELSE 0 END) AS b,
  sum(CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b), abs(i.c - j.c)) <= r AND j.t < n - 3 THEN 1 ELSE 0 END) AS a
  FROM wv i JOIN wv j ON i.series_id = j.series_id AND i.t < j.t JOIN dv ON dv.series_id = i.series_id GROUP BY 1)),
rep AS (SELECT series_id, least(1.0, entropy / ln(dv.n)) AS spectral, permutation, sample FROM en JOIN pe USING (series_id) JOIN sm USING (series_id) JOIN dv USING (series_id))"""


_TYPE_SIG = """sig AS MATERIALIZED (SELECT CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS series_id, t, value FROM typ),
num AS (SELECT series_id, CAST(count(*) AS INTEGER) AS n FROM sig GROUP BY series_id)"""
_DFT_MAGNITUDE = """bn AS (SELECT series_id, n, unnest(range(n // 2)) AS bin FROM num),
mg AS (SELECT series_id, bin, sqrt(pow(sum(value * cos(2 * pi() * ((bin * t) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((bin * t) % n) / n)), 2)) / n AS magnitude
  FROM bn JOIN sig USING (series_id) GROUP BY series_id, n, bin)"""
_KINDS = {
    "tone": "sin(2 * pi() * 10 * s)",
    "two_tone": "sin(2 * pi() * 10 * s) + 0.5 * sin(2 * pi() * 50 * s)",
    "chirp": "sin(2 * pi() * (5 * s + 20 * s * s))",
    "am": "(1 + 0.5 * sin(2 * pi() * 2 * s)) * sin(2 * pi() * 25 * s)",
    "fm": "sin(2 * pi() * 25 * s + 3 * sin(2 * pi() * 2 * s))",
    "burst": "exp(-pow((s - 0.5) * 20, 2)) * sin(2 * pi() * 40 * s)",
    "mix": "sin(2 * pi() * 5 * s) + 0.3 * sin(2 * pi() * 40 * s) + exp(-pow((s - 0.5) * 20, 2))",
}


#: Correlations of both ends' templates with every window, by joining samples at each offset.
_WAVEFORM = """wf AS (SELECT s.series_id, s.t AS start, x.side, corr(w.value, p.value) AS r,
  stddev_pop(w.value) * sqrt(20) AS wn, stddev_pop(p.value) * sqrt(20) AS pn
  FROM sig s JOIN num ON num.series_id = s.series_id CROSS JOIN (SELECT unnest(['a', 'b']) AS side) x CROSS JOIN (SELECT unnest(range(20)) AS k) o
  JOIN sig w ON w.series_id = s.series_id AND w.t = s.t + o.k
  JOIN sig p ON p.series_id = s.series_id AND p.t = o.k + CASE WHEN x.side = 'a' THEN 0 ELSE num.n - 20 END
  WHERE CASE WHEN x.side = 'a' THEN num.n >= 60 AND s.t BETWEEN 20 AND num.n - 40 ELSE num.n >= 40 AND s.t <= num.n - 20 END GROUP BY 1, 2, 3),
wb AS (SELECT series_id, side, start FROM wf QUALIFY row_number() OVER (PARTITION BY series_id, side
  ORDER BY CASE WHEN wn < 1e-15 OR pn < 1e-15 THEN 0 ELSE round(r, 12) END DESC, start) = 1),
base AS (SELECT num.series_id, n, least(20, n) AS m, coalesce(l.start, 0) AS a, coalesce(r.start, n - least(20, n)) AS b FROM num
  LEFT JOIN wb l ON l.series_id = num.series_id AND l.side = 'a' LEFT JOIN wb r ON r.series_id = num.series_id AND r.side = 'b'),"""


#: Levinson-Durbin by order, then ten forecasts at each end, by recursion over lists.
_AR = f"""WITH RECURSIVE {SIG}, xs AS (SELECT series_id, list(value ORDER BY t) AS x, avg(value) AS mean, CAST(count(*) AS BIGINT) AS n FROM sig GROUP BY 1),
cs AS MATERIALIZED (SELECT series_id, x, mean, n, list_transform(x, lambda v: v - mean) AS c, least(5, n - 1) AS p FROM xs),
ac AS MATERIALIZED (SELECT series_id, p, list_transform(range(0, p + 1), lambda k: list_inner_product(c[1:n - k], c[k + 1:n])) AS r FROM cs),
lev AS (SELECT series_id, p, r, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS a, r[1] AS e, r[1] < 1e-12 OR p < 1 AS done FROM ac
  UNION ALL SELECT series_id, p, r, k, list_append(list_transform(range(1, k), lambda j: a[j] - g * a[k - j]), g), e * (1 - g * g), e * (1 - g * g) <= 1e-12 * r[1]
  FROM (SELECT series_id, p, r, k + 1 AS k, a, e, (r[k + 2] - CASE WHEN k = 0 THEN 0 ELSE list_inner_product(a, list_reverse(r[2:k + 1])) END) / e AS g
        FROM lev WHERE NOT done AND k < p)),
co AS MATERIALIZED (SELECT series_id, CASE WHEN len(a) = 0 THEN [1.0::DOUBLE] ELSE a END AS a FROM lev QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY k DESC) = 1),
fc AS (SELECT series_id, side, a, 0 AS i, past[len(past) - len(a) + 1:len(past)] AS past FROM (SELECT series_id, a, 'b' AS side, c AS past FROM co JOIN cs USING (series_id)
    UNION ALL SELECT series_id, a, 'a', list_reverse(c) FROM co JOIN cs USING (series_id))
  UNION ALL SELECT series_id, side, a, i + 1, list_append(past[2:], list_inner_product(a, list_reverse(past))) FROM fc WHERE i < 10)
SELECT series_id, CAST(CASE WHEN side = 'a' THEN 10 - i ELSE 9 + n + i END AS INTEGER) AS t, round(past[len(past)] + mean, 6) + 0.0 AS value
FROM fc JOIN cs USING (series_id) WHERE i > 0 UNION ALL SELECT series_id, t + 10, round(value, 6) + 0.0 FROM sig"""


#: Normal equations of the window pairs of four users in five, solved by Gauss-Jordan over rows of lists.
_FIT = f"""{SIG}, pr AS MATERIALIZED (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS v FROM sig
  QUALIFY len(v) = 25),
ft AS MATERIALIZED (SELECT series_id, t, v[10] AS last, list_append(list_transform(v[1:9], lambda x: x - v[10]), 1.0) AS f, list_transform(v[11:25], lambda x: x - v[10]) AS y FROM pr),
ne AS (SELECT i, j, sum(f[i] * g[j]) AS s FROM (SELECT f, list_concat(f, y) AS g FROM ft WHERE series_id % 5 <> 0), range(1, 11) a(i), range(1, 26) b(j) GROUP BY 1, 2),
gj AS (SELECT 1 AS k, i, list(s ORDER BY j) AS row FROM ne GROUP BY i
  UNION ALL SELECT k + 1, i, CASE WHEN i = k THEN list_transform(p, lambda x: x / p[k]) ELSE list_transform(range(1, 26), lambda c: row[c] - row[k] / p[k] * p[c]) END
  FROM (SELECT *, max(CASE WHEN i = k THEN row END) OVER () AS p FROM gj WHERE k <= 10)),
wt AS MATERIALIZED (SELECT j, list(row[10 + j] ORDER BY i) AS w FROM gj, range(1, 16) r(j) WHERE k = 11 GROUP BY j)"""


def oracle_sql() -> dict[str, str]:
    entropy_sig = f"WITH {SIG}, {_dft('sig', 'series_id', 'ft')}, {_entropy('series_id')}"
    slides = """wn AS (SELECT series_id, n, unnest(range(0, n - 32 + 1, 16)) AS start FROM num WHERE n >= 32),
sl AS (SELECT wn.series_id, wn.start, sig.t - wn.start AS t, sig.value FROM wn JOIN sig ON sig.series_id = wn.series_id AND sig.t >= wn.start AND sig.t < wn.start + 32)"""
    out = dict.fromkeys(
        ["signal_frame", "emd_reconstruct", "emd_palindrome_reconstruct", "ceemd_reconstruct", "ceemdan_reconstruct",
         "iceemdan_reconstruct", "vmd_reconstruct", "emd_table_function"], _INPUT,
    )
    out |= dict.fromkeys(["memd_reconstruct", "namemd_reconstruct"], _CHANNEL_INPUT)
    out |= {
        "memd_sift_once": _memd_once(4),
        "emd_gradient": f"WITH {SIG} SELECT series_id, t, round(value, 4) + 0.0 AS value FROM sig",
        "hourly_dense": f"WITH {HOURS} SELECT component AS series_id, t, round(value, 6) + 0.0 AS value FROM typ",
        "daily_totals": """SELECT CAST(0 AS BIGINT) AS series_id, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS t, round(v, 2) + 0.0 AS value
FROM (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1)""",
        "signal_validate": f"""WITH {SIG} SELECT series_id, count(*) AS n, CAST(sum(CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
CASE WHEN count(*) < 3 THEN 'insufficient_data' ELSE 'ok' END AS status FROM sig GROUP BY 1""",
        "local_extrema": f"WITH {SIG}, {RUNS} SELECT series_id, t, kind, round(value, 6) + 0.0 AS value FROM ext",
        "signal_shape": f"""WITH {SIG}, f AS (SELECT *, CASE WHEN (lag(value) OVER (PARTITION BY series_id ORDER BY t) >= 0) <> (value >= 0) THEN 1 ELSE 0 END AS z FROM sig)
SELECT series_id, count(*) AS n, CAST(sum(z) AS BIGINT) AS zero_crossings, round(sum(value * value), 3) + 0.0 AS energy,
round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM f GROUP BY 1""",
        "intermittency": f"""WITH {SIG}, {RUNS}, g AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ext),
s AS (SELECT series_id, count(*) AS n_extrema, stddev_pop(d) / nullif(avg(d), 0) AS cv FROM g GROUP BY 1)
SELECT num.series_id, coalesce(s.n_extrema, 0) AS n_extrema, round(s.cv, 6) + 0.0 AS cv, coalesce(s.n_extrema >= 6 AND s.cv > 0.4, false) AS intermittent
FROM num LEFT JOIN s USING (series_id)""",
        "stationarity_score": f"WITH {SIG}, {STAT} SELECT series_id, n, round(score, 6) + 0.0 AS score, CASE WHEN score > 0.7 THEN 'ar' ELSE 'last_value' END AS predictor FROM sc",
        "algorithm_advice": f"WITH {SIG}, {STAT} SELECT series_id, CASE WHEN round(score, 9) > 0.8 THEN 'emd' WHEN round(score, 9) >= 0.5 THEN 'eemd' ELSE 'ceemdan' END AS advice FROM sc",
        "ext_mirror_even": _placed(_MIRROR, "n + 2 * m", _MIRROR_AT),
        "ext_mirror_odd": _placed(_MIRROR, "n + 2 * m", _MIRROR_AT, "CASE WHEN j < m OR j >= m + n THEN -1 ELSE 1 END"),
        "ext_periodic": _placed("base AS (SELECT series_id, n FROM num),", "3 * n", "j % n"),
        "ext_palindrome": _placed("base AS (SELECT series_id, n FROM num),", "2 * n - 1", "CASE WHEN j < n THEN j ELSE 2 * n - 2 - j END"),
        "ext_slope": f"""WITH {SIG}, e AS (SELECT series_id, max(CASE WHEN sig.t = 0 THEN value END) AS a, max(CASE WHEN sig.t = 1 THEN value END) AS b,
max(CASE WHEN sig.t = n - 1 THEN value END) AS z, max(CASE WHEN sig.t = n - 2 THEN value END) AS y FROM sig JOIN num USING (series_id) GROUP BY 1)
SELECT series_id, t, round(value, 6) + 0.0 AS value FROM (
SELECT series_id, CAST(10 - k AS INTEGER) AS t, a - (b - a) * k AS value FROM e, range(1, 11) r(k)
UNION ALL SELECT series_id, t + 10, value FROM sig
UNION ALL SELECT e.series_id, CAST(9 + n + k AS INTEGER), z + (z - y) * k FROM e JOIN num USING (series_id), range(1, 11) r(k))""",
        "pad_symmetric": _placed(PAD + ", base AS (SELECT series_id, n, p FROM pd),", "n + 2 * p", "CASE WHEN j < p THEN p - 1 - j WHEN j < p + n THEN j - p ELSE n - 2 - (j - p - n) END"),
        "pad_periodic": _placed(PAD + ", base AS (SELECT series_id, n, p FROM pd),", "n + 2 * p", "(j - p + n) % n"),
        "ext_characteristic_wave": _placed(
            RUNS + """, es AS (SELECT series_id, list(t ORDER BY t) AS e FROM ext GROUP BY 1),
base AS (SELECT num.series_id, n, CASE WHEN len(e) >= 2 THEN e[2] - e[1] ELSE least(4, n) END AS a,
  CASE WHEN len(e) >= 2 THEN e[-1] - e[-2] ELSE least(4, n) END AS b FROM num LEFT JOIN es USING (series_id)),""",
            "n + 4 * a + 4 * b", "CASE WHEN j < 4 * a THEN j % a WHEN j < 4 * a + n THEN j - 4 * a ELSE n - b + (j - 4 * a - n) % b END",
        ),
        "sift_once": SIFT,
        "energy_ratios": f"WITH {HOURS} SELECT component, round(sum(value * value), 2) + 0.0 AS energy, round(sum(value * value) / sum(sum(value * value)) OVER (), 6) + 0.0 AS ratio FROM typ GROUP BY 1",
        "orthogonality": f"WITH {PAIRS} SELECT CAST(0 AS BIGINT) AS series_id, round(sum(abs(dot) / sqrt(ei * ej)), 6) + 0.0 AS pairwise, round(sum(abs(dot)) / (SELECT sum(value * value) FROM typ), 6) + 0.0 AS by_energy FROM pr",
        "correlations": f"WITH {PAIRS}, {_CORR} SELECT i, j, round(correlation, 6) + 0.0 AS correlation FROM co",
        "mean_abs_correlation": f"WITH {PAIRS}, {_CORR} SELECT CAST(0 AS BIGINT) AS series_id, round(avg(abs(correlation)), 6) + 0.0 AS mean_abs_correlation FROM co",
        "mode_overlap": f"WITH {OVERLAP} SELECT i, j, round(overlap, 6) + 0.0 AS overlap, {_SEVERITY.format('overlap')} AS severity FROM ov",
        "top_mixed_pairs": f"WITH {OVERLAP} SELECT i, j, round(overlap, 6) + 0.0 AS overlap FROM ov ORDER BY overlap DESC, i, j LIMIT 3",
        "mixing_report": f"""WITH {OVERLAP}, mx AS (SELECT max(overlap) AS worst, count(*) FILTER (WHERE overlap > 0.05) AS n_mixed,
string_agg(i || '-' || j, ',' ORDER BY overlap DESC, i, j) FILTER (WHERE overlap > 0.05) AS mixed FROM ov),
sv AS (SELECT *, {_SEVERITY.format('worst')} AS severity FROM mx)
SELECT CAST(0 AS BIGINT) AS series_id, round(worst, 6) + 0.0 AS worst, severity, n_mixed, mixed, CASE severity WHEN 'ok' THEN 'The modes hold separate frequencies.'
WHEN 'caution' THEN 'Some modes share frequencies; an ensemble method may separate them.' ELSE 'Modes are mixed; use an ensemble with adaptive noise or fewer modes.' END AS advice FROM sv""",
        "recon_error": f"""WITH {HOURS}
SELECT CAST(0 AS BIGINT) AS series_id, round(sqrt(sum(d * d)) / sqrt(sum(x * x)), 6) + 0.0 AS relative_error, round(max(abs(d)), 6) + 0.0 AS max_error, round(sum(e) / sum(x * x), 6) + 0.0 AS energy_conservation, max(abs(d)) <= 1e-9 AS valid
FROM (SELECT t, x, e, x - y AS d FROM (SELECT t, sum(value) AS x, sum(value * value) FILTER (WHERE component <> (SELECT min(component) FROM typ)) AS e,
  coalesce(sum(value) FILTER (WHERE component <> (SELECT min(component) FROM typ)), 0) AS y FROM typ GROUP BY 1))""",
        "boundary_artifact": f"""WITH {SIG} SELECT series_id, round(coalesce(stddev_pop(CASE WHEN t < 10 OR t >= n - 10 THEN value END)
/ nullif(stddev_pop(CASE WHEN t >= 10 AND t < n - 10 THEN value END), 0), 1.0), 6) + 0.0 AS artifact FROM sig JOIN num USING (series_id) GROUP BY 1""",
        "kl_divergence": f"""WITH {SIG}, {_dft('sig', 'series_id', 'ft')}, pw AS (SELECT series_id, bin, re * re + im * im AS power FROM ft WHERE bin <= p // 2),
m AS (SELECT bin, sum(power) AS power FROM pw GROUP BY 1), b AS (SELECT pw.series_id, pw.bin, pw.power AS a, m.power AS b FROM pw JOIN m USING (bin)),
q AS (SELECT series_id, greatest(a / sum(a) OVER w, 1e-10) AS p, greatest(b / sum(b) OVER w, 1e-10) AS q FROM b WINDOW w AS (PARTITION BY series_id))
SELECT series_id, round(sum(p * ln(p / q)), 5) + 0.0 AS kl FROM q GROUP BY 1""",
        "power_spectrum": f"WITH {SIG}, {_dft('sig', 'series_id', 'ft')} SELECT series_id, CAST(bin AS INTEGER) AS bin, round(re * re + im * im, 2) + 0.0 AS power FROM ft WHERE bin <= p // 2",
        "analytic_signal": f"WITH {SIG}, {ANALYTIC} SELECT series_id, t, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ana",
        "instantaneous": f"WITH {SIG}, {INST} SELECT series_id, t, round(amp, 5) + 0.0 AS amp, round(freq, 5) + 0.0 AS freq FROM ins",
        "instantaneous_forward": f"""WITH {SIG}, {INST} SELECT series_id, t, round(coalesce(lead(ph) OVER w - ph, ph - lag(ph) OVER w, 0.0) / (2 * pi()), 5) + 0.0 AS freq
FROM phs WINDOW w AS (PARTITION BY series_id ORDER BY t)""",
        "emd_trace": f"WITH {SIG}, {RUNS}, c AS (SELECT series_id, count(*) FILTER (WHERE kind = 'max') AS a, count(*) FILTER (WHERE kind = 'min') AS b FROM ext GROUP BY 1) SELECT series_id, t, kind FROM ext JOIN c USING (series_id) WHERE a >= 2 AND b >= 2",
        "marginal_nyquist": f"""WITH {SIG}, {INST}, f AS (SELECT series_id, amp, round(freq, 9) AS freq FROM ins)
SELECT series_id, CAST(floor(freq / 0.5 * 16) AS INTEGER) AS bin, round(sum(amp * amp) / max(n), 4) + 0.0 AS energy FROM f JOIN num USING (series_id) WHERE freq >= 0 AND freq < 0.5 GROUP BY 1, 2""",
        "marginal_log": f"""WITH {SIG}, {INST} SELECT series_id, CAST(floor((log10(freq) + 3) / 6 * 64) AS INTEGER) AS bin, round(sum(amp * amp), 4) + 0.0 AS energy
FROM ins WHERE freq > 0 AND floor((log10(freq) + 3) / 6 * 64) BETWEEN 0 AND 63 GROUP BY 1, 2""",
        "marginal_linear": f"""WITH {SIG}, {INST}, r AS (SELECT *, greatest(min(freq) OVER w, 0.0) AS lo, max(freq) OVER w AS hi, count(*) OVER w AS c FROM ins WINDOW w AS (PARTITION BY series_id))
SELECT series_id, CAST(least(floor((freq - lo) / (hi - lo) * 16), 15) AS INTEGER) AS bin, round(sum(amp * amp) / max(c), 4) + 0.0 AS energy FROM r WHERE hi > lo AND freq >= lo GROUP BY 1, 2""",
        "spectral_entropy": entropy_sig + " SELECT series_id, round(entropy, 6) + 0.0 AS entropy, round(CASE WHEN n > 1 THEN least(1.0, entropy / ln(n)) ELSE 0.0 END, 6) + 0.0 AS normalized FROM en JOIN num USING (series_id)",
        "sliding_entropy": f"WITH {SIG}, {slides}, {_dft('sl', 'series_id, start', 'ft')}, {_entropy('series_id, start')} SELECT series_id, CAST(start AS INTEGER) AS start, round(entropy, 6) + 0.0 AS entropy FROM en",
        "permutation_entropy": f"""WITH {SIG}, w AS (SELECT series_id, t, value AS a, lead(value, 1) OVER x AS b, lead(value, 2) OVER x AS c FROM sig WINDOW x AS (PARTITION BY series_id ORDER BY t)),
r AS (SELECT series_id, CASE WHEN a <= b THEN 1 ELSE 0 END * 4 + CASE WHEN a <= c THEN 1 ELSE 0 END * 2 + CASE WHEN b <= c THEN 1 ELSE 0 END AS pat FROM w WHERE c IS NOT NULL),
k AS (SELECT series_id, pat, count(*) AS n FROM r GROUP BY 1, 2), q AS (SELECT series_id, n * 1.0 / sum(n) OVER (PARTITION BY series_id) AS p FROM k)
SELECT series_id, round(sum(-p * ln(p)), 6) + 0.0 AS entropy, round(least(1.0, sum(-p * ln(p)) / ln(6)), 6) + 0.0 AS normalized FROM q GROUP BY 1""",
        "sample_entropy": f"""WITH {SIG}, w AS (SELECT series_id, t, value AS a, lead(value, 1) OVER x AS b, lead(value, 2) OVER x AS c FROM sig WINDOW x AS (PARTITION BY series_id ORDER BY t)),
d AS (SELECT series_id, 0.2 * stddev_pop(value) AS r, count(*) AS n FROM sig GROUP BY 1),
m AS (SELECT i.series_id, CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b)) <= r AND j.t < n - 2 THEN 1 ELSE 0 END AS two,
  CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b), abs(i.c - j.c)) <= r AND j.t < n - 3 THEN 1 ELSE 0 END AS three
  FROM w i JOIN w j ON i.series_id = j.series_id AND i.t < j.t JOIN d ON d.series_id = i.series_id),
s AS (SELECT series_id, sum(two) AS b, sum(three) AS a FROM m GROUP BY 1)
SELECT series_id, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a * 1.0 / b) ELSE 0.0 END, 6) + 0.0 AS entropy FROM s""",
        "dir_hammersley": _sequence(["i / 64.0", *[_radical(b) for b in (2, 3, 4)]]),
        "dir_halton": _sequence([_radical(b) for b in (2, 3, 5, 7)]),
        "extrema_2d": _extrema(_IMAGE, ["row", "col"], 8),
        "extrema_3d": _extrema(_VOLUME, ["z", "y", "x"], 26),
        "emd_2d_reconstruct": f"WITH {_IMAGE} SELECT row, col, round(value, 6) + 0.0 AS value FROM cell",
        "emd_3d_reconstruct": f"WITH {_VOLUME} SELECT z, y, x, round(value, 6) + 0.0 AS value FROM cell",
        "boundary_pairs": f"""WITH {SIG} SELECT a.series_id, a.t, round(avg(CASE WHEN b.t < a.t + 10 THEN b.value END), 6) + 0.0 AS context_mean,
round(avg(CASE WHEN b.t >= a.t + 10 THEN b.value END), 6) + 0.0 AS target_mean FROM sig a JOIN num ON num.series_id = a.series_id
JOIN sig b ON b.series_id = a.series_id AND b.t >= a.t AND b.t < a.t + 25 WHERE a.t <= num.n - 25 GROUP BY 1, 2""",
        "classification_metrics": """WITH c AS (SELECT count(*) AS n, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END)::DOUBLE AS tp,
sum(CASE WHEN toxic <> 1 AND quality = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN toxic = 1 AND quality <> 0 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM labels)
SELECT n, round((n - fp - fn) / n, 6) + 0.0 AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) + 0.0 AS precision,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) + 0.0 AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) + 0.0 AS f1 FROM c""",
        "regression_metrics": """WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS d FROM lineitem)
SELECT round(avg(d * d), 1) + 0.0 AS mse, round(avg(abs(d)), 3) + 0.0 AS mae, round(sqrt(avg(d * d)), 3) + 0.0 AS rmse, round(1 - avg(d * d) / var_pop(y), 6) + 0.0 AS r2 FROM e""",
        "stream_window_mean": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2",
        "stream_session": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, sid""",
        "stream_window_append": """WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events)
SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events, w
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2""",
        "stream_session_append": """WITH w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events),
g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s, w
GROUP BY user_id, sid, mark HAVING max(ts) + INTERVAL 12 HOUR <= mark""",
        "stream_live_chunks": f"""WITH {SIG} SELECT series_id, CAST(0 AS BIGINT) AS run, CAST(t // 32 AS BIGINT) AS chunk, CAST(t % 32 AS INTEGER) AS t, round(value, 6) + 0.0 AS value FROM sig""",
        "stream_intermittency": f"""WITH {SIG}, {RUNS}, g AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ext),
s AS (SELECT series_id, count(*) AS n_extrema, stddev_pop(d) / nullif(avg(d), 0) AS cv FROM g GROUP BY 1)
SELECT num.series_id, CAST(num.n AS BIGINT) AS seen, coalesce(s.n_extrema, 0) AS n_extrema, round(s.cv, 6) + 0.0 AS cv, coalesce(s.n_extrema >= 6 AND s.cv > 0.4, false) AS intermittent
FROM num LEFT JOIN s USING (series_id)""",
        "stream_dedup": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1",
        "stream_chunks": f"""WITH {SIG} SELECT series_id, CAST(t // 32 AS BIGINT) AS chunk, CAST(t % 32 AS INTEGER) AS t, round(value, 6) + 0.0 AS value
FROM sig JOIN num USING (series_id)""",
        "emd_modes": _modes(),
        "eemd_noiseless": _modes("CASE WHEN kind = 'residue' THEN 0 ELSE component END", False),
        "ceemd_noiseless": _modes("CASE WHEN kind = 'residue' THEN 0 ELSE component END", False),
        "ceemdan_noiseless": _modes(),
        "iceemdan_noiseless": _modes(),
        "mode_by_sd": _first_mode("coalesce(sd < 0.3, false)", 6),
        "mode_by_s_number": _first_mode("steady >= 2", 14),
        "mode_by_energy": _first_mode("coalesce(change < 0.2, false)", 10),
        "emd_2d_modes": _grid_modes(_IMAGE, ("row", "col"), [("col", "row_component"), ("row", "col_component")]),
        "emd_3d_modes": _grid_modes(_VOLUME, ("z", "y", "x"), [("x", "row_component"), ("y", "col_component"), ("z", "z_component")]),
        "vmd_centres": f"WITH s AS ({_TONES}) SELECT series_id, 1 AS component, low AS bin FROM s UNION ALL SELECT series_id, 2, high FROM s",
        "memd_alignment": f"WITH s AS ({_TONES}) SELECT series_id, CAST(c AS INTEGER) AS channel, 1 AS component, high AS bin FROM s, range(2) r(c) UNION ALL SELECT series_id, CAST(c AS INTEGER), 2, low FROM s, range(2) r(c)",
        "namemd_alignment": f"WITH s AS ({_TONES}) SELECT series_id, CAST(c AS INTEGER) AS channel, 1 AS component, high AS bin FROM s, range(2) r(c)",
        "ext_last_value": _placed("base AS (SELECT series_id, n FROM num),", "n + 20", "least(greatest(j - 10, 0), n - 1)"),
        "ext_waveform": _placed(_WAVEFORM, "n + 2 * m", "CASE WHEN j < m THEN a + j WHEN j < m + n THEN j - m ELSE b + j - m - n END"),
        "ext_ar": _AR,
        "emd_segmented": f"WITH RECURSIVE {SIG}, {_decomposed('sig', 'a', 2)} SELECT series_id, CAST(component AS INTEGER) AS component, kind, t, round(value, 4) + 0.0 AS value FROM fina",
        "csv_round_trip": _INPUT,
        "metadata_round_trip": f"WITH {SIG} SELECT CAST(series_id AS VARCHAR) AS id, 'series ' || series_id AS name, CAST(n AS BIGINT) AS sample_count, 0.5::DOUBLE AS sample_rate_hz, 'Events' AS source FROM num",
        "entropy_aggregates": f"""WITH {SIG}, {_dft('sig', 'series_id', 'ft')}, {_entropy('series_id')},
wv AS MATERIALIZED (SELECT series_id, t, value AS a, lead(value, 1) OVER x AS b, lead(value, 2) OVER x AS c FROM sig WINDOW x AS (PARTITION BY series_id ORDER BY t)),
pt AS (SELECT series_id, CASE WHEN a <= b THEN 1 ELSE 0 END * 4 + CASE WHEN a <= c THEN 1 ELSE 0 END * 2 + CASE WHEN b <= c THEN 1 ELSE 0 END AS pat FROM wv WHERE c IS NOT NULL),
pk AS (SELECT series_id, pat, count(*) AS n FROM pt GROUP BY 1, 2),
pe AS (SELECT series_id, sum(-q * ln(q)) AS permutation FROM (SELECT series_id, n * 1.0 / sum(n) OVER (PARTITION BY series_id) AS q FROM pk) GROUP BY 1),
dv AS (SELECT series_id, 0.2 * stddev_pop(value) AS r, count(*) AS n FROM sig GROUP BY 1),
sm AS (SELECT series_id, CASE WHEN a > 0 AND b > 0 THEN -ln(a * 1.0 / b) ELSE 0.0 END AS sample FROM (SELECT i.series_id,
  sum(CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b)) <= r AND j.t < n - 2 THEN 1 ELSE 0 END) AS b,
  sum(CASE WHEN greatest(abs(i.a - j.a), abs(i.b - j.b), abs(i.c - j.c)) <= r AND j.t < n - 3 THEN 1 ELSE 0 END) AS a
  FROM wv i JOIN wv j ON i.series_id = j.series_id AND i.t < j.t JOIN dv ON dv.series_id = i.series_id GROUP BY 1))
SELECT series_id, round(sample, 6) + 0.0 AS sample, round(permutation, 6) + 0.0 AS permutation, round(entropy, 6) + 0.0 AS spectral FROM en JOIN pe USING (series_id) JOIN sm USING (series_id)""",
        "eemd_noisy": _ensemble_once((1,)),
        "ceemd_noisy": _ensemble_once((1, -1)),
        "ceemdan_noisy": f"""WITH RECURSIVE {SIG}, {_hashed(_TRIAL)}, {_added('n1', 'sig')}, {_decomposed('n1', 'a', 1)},
m1 AS MATERIALIZED (SELECT series_id // 2 AS series_id, t, sum(value) / 2 AS value FROM fina WHERE kind = 'imf' GROUP BY 1, 2),
r1 AS MATERIALIZED (SELECT series_id, t, sig.value - m1.value AS value FROM sig JOIN m1 USING (series_id, t)),
{_added('n2', 'r1')}, {_decomposed('n2', 'b', 1)},
m2 AS MATERIALIZED (SELECT series_id // 2 AS series_id, t, sum(value) / 2 AS value FROM finb WHERE kind = 'imf' GROUP BY 1, 2)
SELECT series_id, component, kind, t, round(value, 4) + 0.0 AS value FROM (SELECT series_id, 1 AS component, 'imf' AS kind, t, value FROM m1
  UNION ALL SELECT series_id, 2, 'imf', t, value FROM m2 UNION ALL SELECT series_id, 3, 'residue', t, r1.value - m2.value FROM r1 JOIN m2 USING (series_id, t))""",
        "iceemdan_noisy": f"""WITH RECURSIVE {SIG}, {_hashed("'0:' || series_id || ':0:' || trial", 'ny')}, nr AS MATERIALIZED (SELECT series_id * 2 + trial AS series_id, t, z AS value FROM ny),
{_decomposed('nr', 'b', 1)}, nz AS MATERIALIZED (SELECT series_id // 2 AS series_id, series_id % 2 AS trial, t, value AS z FROM finb WHERE kind = 'imf'),
{_added('ns', 'sig')}, {_decomposed('ns', 'a', 1)}
SELECT series_id // 2 AS series_id, 1 AS component, kind, t, round(sum(value) / 2, 4) + 0.0 AS value FROM fina WHERE kind = 'imf' GROUP BY 1, 3, 4""",
        "forward_context_broken": f"WITH RECURSIVE {SIG}, {_decomposed('sig', 'a', _DEPTH)} SELECT series_id, NOT (count(*) FILTER (WHERE kind = 'imf') > 0 AND (series_id % 2 = 1 OR series_id % 5 = 0)) AS valid FROM fina GROUP BY 1",
        "boundary_coefficients": f"WITH RECURSIVE {_FIT} SELECT CAST(j - 1 AS INTEGER) AS target, CAST(i - 1 AS INTEGER) AS feature, round(w[i], 6) + 0.0 AS weight FROM wt, range(1, 11) r(i)",
        "boundary_fit_error": f"""WITH RECURSIVE {_FIT} SELECT CASE WHEN series_id % 5 = 0 THEN 'held_out' ELSE 'fitted' END AS part, count(*) // 15 AS pairs,
round(avg(pow(y[j] - list_inner_product(w, f), 2)), 5) + 0.0 AS mse_model, round(avg(y[j] * y[j]), 5) + 0.0 AS mse_last FROM ft, wt GROUP BY 1""",
        "ext_learned": f"""WITH RECURSIVE {_FIT}, ls AS (SELECT series_id, CAST(count(*) AS BIGINT) AS n, list(value ORDER BY t) AS x FROM sig GROUP BY 1),
sd AS (SELECT series_id, n, 'a' AS side, list_reverse(x[1:10]) AS v FROM ls UNION ALL SELECT series_id, n, 'b', x[n - 9:n] FROM ls)
SELECT series_id, CAST(CASE WHEN side = 'a' THEN 15 - j ELSE 14 + n + j END AS INTEGER) AS t,
  round(CASE WHEN n < 10 THEN v[len(v)] ELSE v[10] + list_inner_product(w, list_append(list_transform(v[1:9], lambda y: y - v[10]), 1.0)) END, 5) + 0.0 AS value FROM sd, wt
UNION ALL SELECT series_id, t + 15, round(value, 5) + 0.0 FROM sig""",
        "ring_buffer": f"WITH {SIG} SELECT series_id, CAST(t - greatest(n - 32, 0) AS INTEGER) AS place, t, round(value, 6) + 0.0 AS value FROM sig JOIN num USING (series_id) WHERE t >= n - 32",
        "job_signals": _INPUT,
        "collection_validate": f"WITH {HOURS} SELECT CAST(0 AS BIGINT) AS series_id, count(DISTINCT component) AS components, count(*) // count(DISTINCT component) AS shortest, count(*) // count(DISTINCT component) AS longest, 'ok' AS status FROM typ",
        "stationarity_degree": f"""WITH {SIG}, {INST}, f AS (SELECT series_id, round(freq, 9) AS freq FROM ins)
SELECT series_id, round(var_pop(freq) / pow(avg(freq), 2), 5) + 0.0 AS degree FROM f WHERE freq >= 0 GROUP BY 1 HAVING count(*) >= 2 AND avg(freq) > 0""",
        "overlap_matrix": f"WITH {OVERLAP} SELECT i, j, round(overlap, 6) + 0.0 AS overlap FROM (SELECT i, j, overlap FROM ov UNION ALL SELECT j, i, overlap FROM ov UNION ALL SELECT DISTINCT component, component, 1.0 FROM typ)",
        "layer_statistics": f"""WITH {_VOLUME} SELECT z, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance, round(sum(value * value), 4) + 0.0 AS energy FROM cell GROUP BY z
UNION ALL SELECT NULL, round(avg(value), 6) + 0.0, round(var_pop(value), 6) + 0.0, round(sum(value * value), 4) + 0.0 FROM cell""",
        "volume_slices": f"WITH {_VOLUME} SELECT z, round(sum(value), 4) + 0.0 AS total, count(*) AS n FROM cell GROUP BY z",
        "volume_columns": f"WITH {_VOLUME} SELECT y, x, round(max(CASE WHEN z = 0 THEN value END), 6) + 0.0 AS first, count(*) AS n FROM cell GROUP BY y, x",
        "equal_mode_counts": f"""WITH RECURSIVE {SIG}, {_decomposed('sig', 'a', _DEPTH)}, mo AS (SELECT max(component) AS most FROM fina WHERE kind = 'imf')
SELECT series_id, CAST(c AS INTEGER) AS component, count(*) AS n, round(coalesce(sum(pow(f.value, 2)), 0), 3) + 0.0 AS energy
FROM (SELECT series_id, t, unnest(range(1, most + 2)) AS c FROM sig, mo) g
LEFT JOIN (SELECT series_id, t, value, CASE WHEN kind = 'imf' THEN component ELSE most + 1 END AS c FROM fina, mo) f USING (series_id, t, c) GROUP BY series_id, c""",
        "forward_context": f"WITH RECURSIVE {SIG}, {_decomposed('sig', 'a', _DEPTH)} SELECT series_id, count(DISTINCT component) FILTER (WHERE kind = 'imf') AS modes, true AS valid FROM fina GROUP BY 1",
        "synthetic_signals": " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(i AS INTEGER) AS t, round({f}, 6) + 0.0 AS value FROM (SELECT i, i / 500.0::DOUBLE AS s FROM range(500) r(i))" for k, f in sorted(_KINDS.items())),
        "spline_cubic": """SELECT CAST(r_regionkey AS BIGINT) AS spline_id, k / 4.0::DOUBLE AS x, round(pow(k / 4.0, 3) - r_regionkey * pow(k / 4.0, 2) + 2, 6) + 0.0 AS value,
round(3 * pow(k / 4.0, 2) - 2 * r_regionkey * (k / 4.0), 6) + 0.0 AS slope, round(6 * (k / 4.0) - 2 * r_regionkey, 6) + 0.0 AS curvature FROM region, range(29) r(k)""",
        "spline_triangle": """SELECT CAST(r_regionkey AS BIGINT) AS spline_id, k / 4.0::DOUBLE AS x, round((r_regionkey + 1) * (1.5 * u - 0.5 * u * u * u), 6) + 0.0 AS value,
round((r_regionkey + 1) * (1.5 - 1.5 * u * u) * (CASE WHEN k <= 4 THEN 1 ELSE -1 END), 6) + 0.0 AS slope, round(-3 * (r_regionkey + 1) * u, 6) + 0.0 AS curvature
FROM (SELECT r_regionkey, k, CASE WHEN k <= 4 THEN k / 4.0 ELSE 2 - k / 4.0 END AS u FROM region, range(9) r(k))""",
        "spline_periodic": """SELECT CAST(r_regionkey AS BIGINT) AS spline_id, k / 4.0::DOUBLE AS x, round((r_regionkey + 1) * s * (1.5 * u - 0.5 * u * u * u), 6) + 0.0 AS value,
round((r_regionkey + 1) * s * d * (1.5 - 1.5 * u * u), 6) + 0.0 AS slope, round(-3 * (r_regionkey + 1) * s * u, 6) + 0.0 AS curvature
FROM (SELECT r_regionkey, k, CASE WHEN k <= 8 THEN 1 ELSE -1 END AS s, CASE WHEN k % 8 <= 4 AND k NOT IN (8, 16) THEN 1 ELSE -1 END AS d,
  CASE WHEN k % 8 <= 4 THEN (k % 8) / 4.0 ELSE 2 - (k % 8) / 4.0 END AS u FROM region, range(17) r(k))""",
        "boundary_artifact_rms": f"""WITH {SIG} SELECT series_id, round(coalesce(sqrt(avg(CASE WHEN t < 10 OR t >= n - 10 THEN value * value END))
/ sqrt(avg(CASE WHEN t >= 20 AND t < n - 20 THEN value * value END)), 1.0), 6) + 0.0 AS artifact FROM sig JOIN num USING (series_id) GROUP BY 1""",
        "dft_magnitude": f"WITH {SIG}, {_DFT_MAGNITUDE} SELECT series_id, CAST(bin AS INTEGER) AS bin, round(magnitude, 9) + 0.0 AS magnitude FROM mg",
        "spectral_distortion": f"""WITH RECURSIVE {SIG.replace('sig AS', 'raw AS').replace('FROM sig', 'FROM raw')}, {_decomposed('raw', 'a', 1)},
both_ AS (SELECT series_id, 0 AS w, t, value FROM raw UNION ALL SELECT series_id, 1, t, value FROM fina WHERE kind = 'imf'),
bn AS (SELECT series_id, n, unnest(range(n // 2)) AS bin FROM num),
mg AS (SELECT series_id, w, bin, sqrt(pow(sum(value * cos(2 * pi() * ((bin * t) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((bin * t) % n) / n)), 2)) AS m FROM bn JOIN both_ USING (series_id) GROUP BY series_id, n, w, bin),
sh AS (SELECT series_id, w, bin, greatest(m / sum(m) OVER (PARTITION BY series_id, w), 1e-10) AS p FROM mg)
SELECT a.series_id, round(sum(a.p * ln(a.p / b.p)), 4) + 0.0 AS distortion FROM sh a JOIN sh b ON a.series_id = b.series_id AND a.bin = b.bin AND a.w = 0 AND b.w = 1 GROUP BY 1""",
        "hilbert_imf": f"""WITH {SIG}, {INST} SELECT series_id, 1 AS component, t, round(amp, 5) + 0.0 AS amp, round(coalesce(lead(ph) OVER w - ph, ph - lag(ph) OVER w, 0.0) / (2 * pi()), 5) + 0.0 AS freq
FROM phs WINDOW w AS (PARTITION BY series_id ORDER BY t)""",
        "entropy_report": f"""WITH {HOURS}, {_TYPE_SIG}, {_entropies('series_id')}, av AS (SELECT count(*) AS modes, avg(spectral) AS spectral, avg(permutation) AS permutation, avg(sample) AS sample FROM rep)
SELECT CAST(0 AS BIGINT) AS series_id, modes, round(spectral, 6) + 0.0 AS spectral, round(permutation, 6) + 0.0 AS permutation, round(sample, 6) + 0.0 AS sample,
round((spectral + permutation + least(sample / 2, 1.0)) / 3, 6) + 0.0 AS score, spectral > 0.7 AS high_complexity FROM av""",
        "complexity": f"""WITH {HOURS}, {_TYPE_SIG}, {_entropies('series_id')} SELECT series_id AS component, round(spectral, 6) + 0.0 AS spectral, round(permutation, 6) + 0.0 AS permutation, round(sample, 6) + 0.0 AS sample,
round((spectral + permutation + least(sample / 2, 1.0)) / 3, 6) + 0.0 AS score, spectral > 0.7 AS high_complexity FROM rep""",
    }
    return out
