"""DuckDB SQL for the same results, written independently of the Spark plans: long tables and lists."""

from __future__ import annotations

import math
from fractions import Fraction

PTS = """pts AS (SELECT user_id AS curve_id, event_id AS idx, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600000000.0 AS x, value AS y FROM events)"""
CV = PTS + """,
fp AS (SELECT curve_id, x, arg_min(y, idx) AS y FROM pts GROUP BY curve_id, x),
cv AS (SELECT curve_id, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM fp GROUP BY curve_id)"""


def interpolated(xs: str, ys: str, q: str) -> str:
    i = f"greatest(1, least(len({xs}) - 1, len(list_filter({xs}, lambda v: v < {q}))))"
    return f"({ys}[{i} + 1] - {ys}[{i}]) / ({xs}[{i} + 1] - {xs}[{i}]) * ({q} - {xs}[{i}]) + {ys}[{i}]"


GRID = CV + f""",
rs AS (SELECT curve_id, k, CASE WHEN k = 199 THEN xs[len(xs)] ELSE xs[1] + k * ((xs[len(xs)] - xs[1]) / 199) END AS x, xs, ys FROM cv, range(200) t(k) WHERE len(xs) >= 5),
gr AS (SELECT curve_id, k, x, {interpolated('xs', 'ys', 'x')} AS y FROM rs)"""


def _polynomial_weights(window: int, order: int = 3) -> list[list[float]]:
    """For each place of a window, the weights whose sum with the samples is the fitted cubic there: discrete orthogonal polynomials, in fractions."""
    ts = [Fraction(k) for k in range(window)]
    base: list[list[Fraction]] = []
    for d in range(order + 1):
        v = [t**d for t in ts]
        for b in base:
            c = sum(x * y for x, y in zip(v, b)) / sum(y * y for y in b)
            v = [x - c * y for x, y in zip(v, b)]
        base.append(v)
    norm = [sum(y * y for y in b) for b in base]
    return [[float(sum(b[i] * b[j] / n for b, n in zip(base, norm))) for j in range(window)] for i in range(window)]


# fixed values: the interior weights that published tables give for a cubic
assert [round(w * 429) for w in _polynomial_weights(11)[5]] == [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]
assert [round(w * 35) for w in _polynomial_weights(5)[2]] == [-3, 12, 17, 12, -3]


def _weighted(list_: str, first: str, weights: list[float]) -> str:
    return " + ".join(f"{list_}[{first} + {j}] * CAST({w!r} AS DOUBLE)" for j, w in enumerate(weights))


def smoothed(window: int = 11, n: int = 200) -> str:
    m, h = _polynomial_weights(window), window // 2
    cases = [f"WHEN k >= {h} AND k < {n - h} THEN {_weighted('yl', f'k - {h} + 1', m[h])}"]
    for e in range(h):
        cases += [f"WHEN k = {e} THEN {_weighted('yl', '1', m[e])}", f"WHEN k = {n - h + e} THEN {_weighted('yl', str(n - window + 1), m[h + 1 + e])}"]
    return GRID + f""",
gl AS (SELECT curve_id, list(y ORDER BY k) AS yl FROM gr GROUP BY curve_id),
sm AS (SELECT gr.curve_id, k, x, CASE {' '.join(cases)} END AS y FROM gr JOIN gl ON gr.curve_id = gl.curve_id)"""


def gradient_of(xl: str, yl: str, k: str = "k") -> str:
    """At the zero-based place k of two lists."""
    n, x, y = f"len({xl})", lambda o: f"{xl}[{k} + 1 + ({o})]", lambda o: f"{yl}[{k} + 1 + ({o})]"
    hs, hd = f"({x(0)} - {x(-1)})", f"({x(1)} - {x(0)})"
    inner = f"({hs} * {hs} * {y(1)} + ({hd} * {hd} - {hs} * {hs}) * {y(0)} - {hd} * {hd} * {y(-1)}) / ({hs} * {hd} * ({hs} + {hd}))"
    return f"CASE WHEN {k} = 0 THEN ({yl}[2] - {yl}[1]) / ({xl}[2] - {xl}[1]) WHEN {k} = {n} - 1 THEN ({yl}[{n}] - {yl}[{n} - 1]) / ({xl}[{n}] - {xl}[{n} - 1]) ELSE {inner} END"


SMOOTH = smoothed()
DERIV = SMOOTH + f""",
sl AS (SELECT curve_id, list(x ORDER BY k) AS xl, list(y ORDER BY k) AS yl FROM sm GROUP BY curve_id),
dv AS (SELECT sm.curve_id, k, x, y, {gradient_of('xl', 'yl')} AS d FROM sm JOIN sl ON sm.curve_id = sl.curve_id),
w AS (SELECT *, lag(d) OVER c AS d0, lag(x) OVER c AS x0, lag(y) OVER c AS y0, lead(d) OVER c AS d1 FROM dv WINDOW c AS (PARTITION BY curve_id ORDER BY k)),
zc AS (SELECT curve_id, k, k - 1 + d0 / (d0 - d) AS z, CAST(round_even(k - 1 + d0 / (d0 - d), 0) AS BIGINT) AS j FROM w WHERE d0 > 0 AND d <= 0)"""

PROMINENT = """,
st AS (SELECT a.curve_id, a.k AS l, a.y AS h, coalesce((SELECT min(b.k) FROM dv b WHERE b.curve_id = a.curve_id AND b.k > a.k AND b.y <> a.y), 200) - 1 AS r
  FROM w a WHERE a.k BETWEEN 1 AND 198 AND a.y > a.y0),
lm AS (SELECT st.curve_id, l, h, r, (l + r) // 2 AS k FROM st JOIN dv ON dv.curve_id = st.curve_id AND dv.k = r + 1 WHERE dv.y < h),
sd AS (SELECT lm.*, coalesce((SELECT max(b.k) FROM dv b WHERE b.curve_id = lm.curve_id AND b.k < l AND b.y > h), -1) AS lo, coalesce((SELECT min(b.k) FROM dv b WHERE b.curve_id = lm.curve_id AND b.k > r AND b.y > h), 200) AS hi FROM lm),
pk AS (SELECT curve_id, k, h, h - greatest((SELECT min(b.y) FROM dv b WHERE b.curve_id = sd.curve_id AND b.k > lo AND b.k <= sd.k), (SELECT min(b.y) FROM dv b WHERE b.curve_id = sd.curve_id AND b.k >= sd.k AND b.k < hi)) AS prominence FROM sd)"""

PEAK = DERIV + PROMINENT + """,
mx AS (SELECT curve_id, max(y) AS top, arg_min(k, (-y, k)) AS am, min(y) AS low, max(d) AS dtop FROM dv GROUP BY curve_id),
c1 AS (SELECT zc.curve_id, arg_min(j, zc.k) AS j FROM zc JOIN mx ON mx.curve_id = zc.curve_id JOIN dv ON dv.curve_id = zc.curve_id AND dv.k = zc.j WHERE dv.y > 0.5 * top GROUP BY zc.curve_id),
c2 AS (SELECT pk.curve_id, arg_min(pk.k, (-h, pk.k)) AS j FROM pk JOIN mx ON mx.curve_id = pk.curve_id WHERE prominence >= 0.1 * top GROUP BY pk.curve_id),
pp AS (SELECT mx.curve_id, coalesce(c1.j, c2.j, mx.am) AS p, top, low, dtop FROM mx LEFT JOIN c1 ON c1.curve_id = mx.curve_id LEFT JOIN c2 ON c2.curve_id = mx.curve_id),
pa AS (SELECT pp.*, dv.x AS px, dv.y AS py FROM pp JOIN dv ON dv.curve_id = pp.curve_id AND dv.k = pp.p),
hf AS (SELECT pa.curve_id, arg_min(dv.k, (abs(dv.y - py / 2), dv.k)) AS h FROM pa JOIN dv ON dv.curve_id = pa.curve_id AND dv.k <= p GROUP BY pa.curve_id)"""

FEATURES = PEAK + """,
im AS (SELECT pa.curve_id, avg(d) FILTER (WHERE k < greatest(1, CAST(floor(p * 0.1) AS BIGINT))) AS e0,
  coalesce(sum((y + y0) / 2 * (x - x0)) FILTER (WHERE k BETWEEN 1 AND p), 0) AS energy,
  avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE k < p) AS up, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE k >= p) AS down,
  count(*) FILTER (WHERE k BETWEEN 1 AND p AND x > x0) AS rises FROM pa JOIN w ON w.curve_id = pa.curve_id GROUP BY pa.curve_id),
ft AS (SELECT pa.curve_id, py AS peak_stress, px AS failure_strain, e0 AS initial_modulus, CASE WHEN dv.x > 0 THEN dv.y / dv.x ELSE e0 END AS secant_modulus_50, energy AS energy_to_peak, p < 195 AS post_peak,
  (1.0 + CASE WHEN py > 0 THEN least((py - low) / py, 1.0) ELSE 0.0 END + CASE WHEN p > 5 AND p < 195 THEN (up + down) / 2 ELSE 0.5 END + rises / greatest(p, 1)) / 4 AS confidence, p AS peak_index
  FROM pa JOIN im ON im.curve_id = pa.curve_id JOIN hf ON hf.curve_id = pa.curve_id JOIN dv ON dv.curve_id = pa.curve_id AND dv.k = hf.h
  UNION ALL SELECT curve_id, list_max(ys), xs[list_position(ys, list_max(ys))], 0.0, 0.0, 0.0, false, 0.0, list_position(ys, list_max(ys)) - 1 FROM cv WHERE len(xs) < 5)"""

PAIRS = CV + """,
pr AS (SELECT a.curve_id // 2 AS pair_id, a.xs AS gx, a.ys AS gy, b.xs AS ex, b.ys AS ey, greatest(a.xs[1], b.xs[1]) AS lo, least(a.xs[len(a.xs)], b.xs[len(b.xs)]) AS hi
  FROM cv a JOIN cv b ON b.curve_id = a.curve_id + 1 WHERE a.curve_id % 2 = 0)"""


def pair_grid(n: int) -> str:
    return PAIRS + f""",
pg AS (SELECT *, CASE WHEN k = {n - 1} THEN hi ELSE lo + k * ((hi - lo) / {n - 1}) END AS q FROM pr, range({n}) t(k) WHERE lo < hi),
pe AS (SELECT pair_id, k, {interpolated('gx', 'gy', 'q')} AS g, {interpolated('ex', 'ey', 'q')} AS e, list_max(gy) AS top, gx, gy, ex, ey FROM pg)"""


SCORES = CV + f""",
g1 AS (SELECT curve_id, xs, ys, list_transform(range(len(xs)), lambda k: {gradient_of('xs', 'ys')}) AS g FROM cv),
g2 AS (SELECT curve_id, xs, ys, list_transform(range(len(xs)), lambda k: {gradient_of('xs', 'g')}) AS s FROM g1),
sv AS (SELECT curve_id, xs, ys, len(ys) AS n, list_var_pop(s) AS vs, list_var_pop(ys) AS vy FROM g2),
so AS (SELECT curve_id, xs, ys, n, CASE WHEN n < 3 THEN 0.0 WHEN n < 5 THEN 0.5 ELSE 1 / (1 + 10 * (vs / (vy + 1e-6))) END AS curve_smoothness FROM sv),
va AS (SELECT curve_id, n, curve_smoothness, n // 3 AS m,
  CASE WHEN len(list_filter(xs, lambda v: v < -0.1)) > 0 THEN 0.5 ELSE 1.0 END AS v1, CASE WHEN len(list_filter(ys, lambda v: v < -100)) > 0 THEN 0.5 ELSE 1.0 END AS v2,
  len(list_filter(range(1, greatest(n // 3, 2)), lambda i: ys[i + 1] - ys[i] > 0)) AS rises, len(list_filter(range(1, n), lambda i: xs[i + 1] - xs[i] >= 0)) / greatest(n - 1, 1) AS v4, least(n / 50, 1.0) AS v5 FROM so),
sc AS (SELECT curve_id, curve_smoothness, CASE WHEN n < 3 THEN 0.0 WHEN m > 2 THEN (v1 + v2 + rises / (m - 1) + v4 + v5) / 5 ELSE (v1 + v2 + v4 + v5) / 4 END AS data_validity FROM va)"""

REPORT = SCORES + """,
fn AS (SELECT *, CASE WHEN curve_id % 3 > 0 THEN (curve_id % 5) * 0.04 END AS nmae, data_validity AS raw_validity FROM sc),
fa AS (SELECT curve_id, nmae, raw_validity, curve_smoothness, CASE WHEN nmae > 0.05 THEN raw_validity * (1 - least(nmae, 0.5)) ELSE raw_validity END AS data_validity, (0.4 + (curve_id % 7) * 0.1 + 0.8) / 2 AS ocr_confidence, (least((curve_id % 8) / 5, 1.0) + least((curve_id % 5 + 1) / 5, 1.0)) / 2 * CASE WHEN curve_id % 8 < 2 OR curve_id % 5 + 1 < 2 THEN 0.5 ELSE 1.0 END AS axis_detection,
  (curve_id % 10) / 10.0 AS image_quality, CAST(CASE curve_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS method_confidence FROM fn),
ov AS (SELECT *, 0.0 + ocr_confidence * 0.2 + curve_smoothness * 0.25 + axis_detection * 0.15 + data_validity * 0.15 + image_quality * 0.15 + method_confidence * 0.1 AS overall FROM fa)"""

_CLEAN = """kept AS (SELECT DISTINCT tok, regexp_replace(translate(trim(tok), 'OolI|SsBZzGg,', '001115582269.'), '[^0-9.\\-]', '', 'g') AS k FROM toks),
dots AS (SELECT tok, CASE WHEN position('.' IN k) > 0 THEN split_part(k, '.', 1) || '.' || replace(substr(k, position('.' IN k) + 1), '.', '') ELSE k END AS d FROM kept),
cleaned AS (SELECT tok, CASE WHEN length(d) - length(replace(d, '-', '')) > 1 THEN CASE WHEN d[1] = '-' THEN '-' || replace(d, '-', '') ELSE replace(d, '-', '') END ELSE d END AS cleaned FROM dots)"""
TOKENS = "toks AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t-\\r]+')) AS tok FROM documents)"
CLEAN = TOKENS + ",\n" + _CLEAN


def gaussian_sql(sigma: float = 2.0) -> str:
    r = math.floor(4 * sigma + 0.5)
    taps = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    taps = [t / math.fsum(taps) for t in taps]
    at = lambda o: f"(CASE WHEN (i + {o}) < 0 THEN ys[-(i + {o})] WHEN (i + {o}) >= len(ys) THEN ys[2 * len(ys) - (i + {o})] ELSE ys[i + {o} + 1] END)"
    return " + ".join(f"{at(j - r)} * CAST({w!r} AS DOUBLE)" for j, w in enumerate(taps))
