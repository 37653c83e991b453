"""The query catalogue over the standard tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.functions import arrays as A
from curvelab.functions import register
from curvelab.functions import text as T
from curvelab.operators import contours, extraction, features, images, jobs, long_curves, merge, scale, scoring, validation
from curvelab.operators import curves as C
from curvelab.plans import oracle as O
from curvelab.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.event_points(table(spark, sf_dir, "events"))


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_points(points(spark, sf_dir))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves with many equal x: per supplier, y = quantity by ship day, in order of order key and line."""
    day = F.expr("cast(datediff(cast(l_shipdate as date), DATE'1992-01-01') as bigint)")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("curve_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("idx"), day.alias("x"), F.col("l_quantity").alias("y"))


SHIP = "sh AS (SELECT l_suppkey AS curve_id, l_orderkey * 100 + l_linenumber AS idx, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x, l_quantity AS y FROM lineitem)"


# --- curves -----------------------------------------------------------------


@query(f"WITH {SHIP} SELECT curve_id, x, min(idx) AS idx, arg_min(y, idx) AS y FROM sh GROUP BY curve_id, x")
def curve_dedup_first(spark, sf_dir):
    return C.dedup_first(shipments(spark, sf_dir))


@query(f"WITH {SHIP} SELECT curve_id, x, CAST(trunc(median(y)) AS INTEGER) AS y FROM sh GROUP BY curve_id, x")
def curve_median_by_x(spark, sf_dir):
    return C.median_by_x(shipments(spark, sf_dir))


@query(f"WITH {SHIP} SELECT curve_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n FROM sh GROUP BY curve_id")
def curve_ranges(spark, sf_dir):
    return shipments(spark, sf_dir).groupBy("curve_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE p AS (SELECT l_suppkey AS curve_id, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS x, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS y FROM lineitem GROUP BY ALL),
c AS (SELECT curve_id, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM p GROUP BY curve_id),
s(curve_id, a, b) AS (SELECT curve_id, CAST(1 AS BIGINT), len(xs) FROM c
  UNION ALL SELECT curve_id, unnest([a, k]), unnest([k, b]) FROM (SELECT curve_id, a, b, a + list_position(dd, list_max(dd)) AS k, list_max(dd) > 400 * ((xs[b] - xs[a]) * (xs[b] - xs[a]) + (ys[b] - ys[a]) * (ys[b] - ys[a])) AS far
    FROM (SELECT s.*, xs, ys, list_transform(range(a + 1, b), lambda i: ((xs[i] - xs[a]) * (ys[b] - ys[a]) - (ys[i] - ys[a]) * (xs[b] - xs[a])) * ((xs[i] - xs[a]) * (ys[b] - ys[a]) - (ys[i] - ys[a]) * (xs[b] - xs[a]))) AS dd FROM s JOIN c USING (curve_id) WHERE b - a > 1)) WHERE far)
SELECT DISTINCT curve_id, CAST(xs[k] AS DOUBLE) AS x, CAST(ys[k] AS DOUBLE) AS y FROM (SELECT curve_id, a AS k FROM s UNION SELECT curve_id, b FROM s) JOIN c USING (curve_id)""")
def curve_simplified(spark, sf_dir):
    """The points of each supplier's curve that a polyline within 20 of it needs."""
    kept = C.simplify(C.ordered(C.dedup_first(shipments(spark, sf_dir))), 20)
    return kept.select("curve_id", F.explode(F.arrays_zip("xs", "ys")).alias("p")).select("curve_id", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


@query(f"WITH {O.GRID} SELECT curve_id, CAST(k AS INTEGER) AS k, round(x, 6) AS x, round(y, 6) AS y FROM gr")
def curve_resample_200(spark, sf_dir):
    return C.exploded(C.resample(event_curves(spark, sf_dir)), x="xs", y="ys").select("curve_id", "k", *r6("x", "y"))


@query(f"WITH {O.SMOOTH} SELECT curve_id, CAST(k AS INTEGER) AS k, round(y, 6) AS y FROM sm")
def curve_smooth_sg(spark, sf_dir):
    return C.exploded(C.smooth(C.resample(event_curves(spark, sf_dir))), y="ys").select("curve_id", "k", *r6("y"))


@query(f"WITH {O.smoothed(5)} SELECT curve_id, CAST(k AS INTEGER) AS k, round(y, 6) AS y FROM sm")
def curve_smooth_least(spark, sf_dir):
    """Without smoothing asked for: the least window."""
    return C.exploded(C.smooth(C.resample(event_curves(spark, sf_dir)), features.window_for(False)), y="ys").select("curve_id", "k", *r6("y"))


@query(f"WITH {O.DERIV} SELECT curve_id, CAST(k AS INTEGER) AS k, round(d, 6) AS d FROM dv")
def curve_derivative(spark, sf_dir):
    return C.exploded(C.derivative(C.smooth(C.resample(event_curves(spark, sf_dir)))), d="ds").select("curve_id", "k", *r6("d"))


@query(f"WITH {O.DERIV} SELECT curve_id, CAST(k AS INTEGER) AS i, round(z, 6) AS z, CAST(j AS INTEGER) AS j FROM zc")
def zero_crossings(spark, sf_dir):
    d = C.derivative(C.smooth(C.resample(event_curves(spark, sf_dir))))
    return d.select("curve_id", F.inline(A.zero_crossings(F.col("ds")))).select("curve_id", "i", *r6("z"), "j")


@query(f"WITH {O.CV}, g AS (SELECT curve_id, i, {O.gaussian_sql()} AS y FROM cv, LATERAL (SELECT unnest(range(len(xs))) AS i)) SELECT curve_id, CAST(i AS INTEGER) AS k, round(y, 6) AS y FROM g")
def gaussian_smooth(spark, sf_dir):
    return C.exploded(C.gaussian(event_curves(spark, sf_dir)), y="ys").select("curve_id", "k", *r6("y"))


@query(ORACLE_SQL["curve_resample_200"])
def long_resample(spark, sf_dir):
    """The same from curves as rows in ranges."""
    return long_curves.resample(long_curves.placed(points(spark, sf_dir))).select("curve_id", "k", *r6("x", "y"))


@query(f"""WITH {O.PTS}, fp AS (SELECT curve_id, x, arg_min(y, idx) AS y FROM pts GROUP BY curve_id, x), s AS (SELECT curve_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM fp WINDOW w AS (PARTITION BY curve_id ORDER BY x))
SELECT curve_id, count(*) AS n, round(sum(coalesce((y + py) / 2 * (x - px), 0)), 4) AS area, round(sum(coalesce((y + py) / 2 * (x - px), 0)) FILTER (WHERE x < 100), 4) AS early, CAST(count_if(CASE WHEN px IS NULL THEN (ny - y) / (nx - x) WHEN nx IS NULL THEN (y - py) / (x - px)
  ELSE ((x - px) * (x - px) * ny + ((nx - x) * (nx - x) - (x - px) * (x - px)) * y - (nx - x) * (nx - x) * py) / ((x - px) * (nx - x) * (nx - px)) END > 0) AS BIGINT) AS rising FROM s GROUP BY curve_id""")
def long_energy(spark, sf_dir):
    """The whole integral, that up to 100, and how many points rise, of curves as rows in ranges."""
    p = long_curves.placed(points(spark, sf_dir))
    run = long_curves.running_area(p).groupBy("curve_id").agg(F.round(F.max_by("area", F.when(F.col("x") < 100, F.col("x"))), 4).alias("early"))
    rising = long_curves.gradient(p).groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("rising"))
    return long_curves.area(p).select("curve_id", F.round("area", 4).alias("area")).join(run, "curve_id").join(rising, "curve_id")


# --- features ---------------------------------------------------------------

FEATURES = ("peak_stress", "failure_strain", "initial_modulus", "secant_modulus_50", "energy_to_peak", "energy_to_peak_kj_m3", "confidence")


@query(f"WITH {O.FEATURES} SELECT curve_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES if c != 'energy_to_peak_kj_m3')}, round(energy_to_peak / 100, 6) AS energy_to_peak_kj_m3, post_peak, CAST(peak_index AS INTEGER) AS peak_index FROM ft")
def peak_features(spark, sf_dir):
    return features.analyze(event_curves(spark, sf_dir)).select("curve_id", *r6(*FEATURES), "post_peak", "peak_index")


@query(f"WITH {O.FEATURES} SELECT curve_id, round(secant_modulus_50, 6) AS secant_modulus_50 FROM ft WHERE peak_index > 0")
def secant_modulus(spark, sf_dir):
    return features.analyze(event_curves(spark, sf_dir)).where("peak_index > 0").select("curve_id", *r6("secant_modulus_50"))


@query(f"WITH {O.FEATURES} SELECT curve_id, round(energy_to_peak, 6) AS energy_to_peak FROM ft")
def energy_to_peak(spark, sf_dir):
    return features.analyze(event_curves(spark, sf_dir)).select("curve_id", *r6("energy_to_peak"))


@query(f"""WITH {O.PEAK}, yd AS (SELECT pa.curve_id, min(w.k) AS q FROM pa JOIN w ON w.curve_id = pa.curve_id WHERE greatest(1, p // 2) > 5 AND w.k < greatest(1, p // 2) - 1 AND w.d1 - w.d < -0.1 * dtop GROUP BY pa.curve_id),
cp AS (SELECT curve_id, 'Peak' AS point, p AS k FROM pa UNION ALL SELECT curve_id, '50% Peak', h FROM hf UNION ALL SELECT curve_id, 'Yield', q FROM yd)
SELECT cp.curve_id, point, round(x, 6) AS strain, round(y, 6) AS stress FROM cp JOIN dv ON dv.curve_id = cp.curve_id AND dv.k = cp.k""")
def critical_points(spark, sf_dir):
    return features.critical_points(event_curves(spark, sf_dir)).select("curve_id", "point", *r6("strain", "stress"))


@query(f"WITH {O.DERIV}{O.PROMINENT} SELECT curve_id, CAST(k AS INTEGER) AS k, round(h, 6) AS height, round(prominence, 6) AS prominence FROM pk")
def prominent_peaks(spark, sf_dir):
    s = C.smooth(C.resample(event_curves(spark, sf_dir)))
    return s.select("curve_id", F.inline(A.prominent_peaks(F.col("ys")))).select("curve_id", "k", *r6("height", "prominence"))


# --- validation -------------------------------------------------------------


def event_pairs(spark, sf_dir) -> DataFrame:
    """Users 2k and 2k+1 as ground truth and extraction."""
    c = event_curves(spark, sf_dir)
    half = lambda odd: c.where(F.col("curve_id") % 2 == odd).withColumn("curve_id", F.floor(F.col("curve_id") / 2))
    return validation.paired(half(0), half(1))


METRICS = ("mae", "rmse", "max_error", "r_squared", "within_5_percent", "within_10_percent", "peak_stress_error", "failure_strain_error", "accuracy_score")


@query(f"""WITH {O.pair_grid(100)}, gm AS (SELECT pair_id, avg(g) AS m FROM pe GROUP BY pair_id),
ag AS (SELECT pe.pair_id, avg(abs(e - g)) AS mae, sqrt(avg((e - g) * (e - g))) AS rmse, max(abs(e - g)) AS max_error,
  CASE WHEN sum((g - m) * (g - m)) > 0 THEN 1 - sum((e - g) * (e - g)) / sum((g - m) * (g - m)) ELSE 0.0 END AS r_squared, avg(CASE WHEN abs(e - g) / top <= 0.05 THEN 1.0 ELSE 0.0 END) AS within_5_percent,
  avg(CASE WHEN abs(e - g) / top <= 0.10 THEN 1.0 ELSE 0.0 END) AS within_10_percent, abs(list_max(any_value(ey)) - list_max(any_value(gy))) AS peak_stress_error,
  abs(any_value(ex[list_position(ey, list_max(ey))]) - any_value(gx[list_position(gy, list_max(gy))])) AS failure_strain_error, greatest(0, 1 - avg(abs(e - g)) / any_value(top)) AS accuracy_score
  FROM pe JOIN gm ON gm.pair_id = pe.pair_id GROUP BY pe.pair_id)
SELECT pr.pair_id, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, CASE WHEN lo < hi THEN 'ok' ELSE 'no_overlap' END AS status, coalesce(accuracy_score >= 0.95, false) AS passed FROM pr LEFT JOIN ag ON ag.pair_id = pr.pair_id""")
def validate_curves(spark, sf_dir):
    return validation.validate(event_pairs(spark, sf_dir)).select("pair_id", *r6(*METRICS), "status", "passed")


@query(f"WITH {O.pair_grid(50)}, ag AS (SELECT pair_id, avg(abs(e - g)) / any_value(top) AS n FROM pe GROUP BY pair_id) SELECT pr.pair_id, round(coalesce(n, 1.0), 6) AS nmae FROM pr LEFT JOIN ag ON ag.pair_id = pr.pair_id")
def normalized_mae_50(spark, sf_dir):
    return validation.normalized_mae(event_pairs(spark, sf_dir)).select("pair_id", *r6("nmae"))


# --- scoring ----------------------------------------------------------------


@query(f"WITH {O.SCORES} SELECT curve_id, round(curve_smoothness, 6) AS smoothness FROM sc")
def smoothness_score(spark, sf_dir):
    return event_curves(spark, sf_dir).select("curve_id", F.round(scoring.smoothness(F.col("xs"), F.col("ys")), 6).alias("smoothness"))


@query(f"WITH {O.SCORES} SELECT curve_id, round(data_validity, 6) AS validity FROM sc")
def data_validity(spark, sf_dir):
    return event_curves(spark, sf_dir).select("curve_id", F.round(scoring.validity(F.col("xs"), F.col("ys")), 6).alias("validity"))


@query("WITH t AS (SELECT conv_id, count_if(role = 'user') AS a, count_if(role <> 'user') AS b FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(a AS BIGINT) AS x_ticks, CAST(b AS BIGINT) AS y_ticks, round((least(a / 5, 1.0) + least(b / 5, 1.0)) / 2 * CASE WHEN a < 2 OR b < 2 THEN 0.5 ELSE 1.0 END, 6) AS score FROM t")
def axis_score(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("x_ticks"), F.count_if(F.col("role") != "user").alias("y_ticks"))
    return t.withColumn("score", F.round(scoring.axis_score(F.col("x_ticks"), F.col("y_ticks")), 6))


def event_report(spark, sf_dir, strict: bool = False) -> DataFrame:
    """Scores of the event curves, with recognition, ticks, quality and method derived from the curve's number."""
    i = F.col("curve_id")
    method = F.when(i % 4 == 0, "contour_tracing").when(i % 4 == 1, "unet_primary").when(i % 4 == 2, "unet_fallback").otherwise("unknown")
    df = event_curves(spark, sf_dir).select("curve_id", "xs", "ys", F.array(0.4 + (i % 7) * 0.1, F.lit(0.8)).alias("ocr"), (i % 8).alias("x_ticks"), (i % 5 + 1).alias("y_ticks"), ((i % 10) / 10.0).alias("quality"), method.alias("method"), F.when(i % 3 > 0, (i % 5) * 0.04).alias("nmae"))
    return scoring.scored(df, strict=strict)


FACTORS = ("ocr_confidence", "curve_smoothness", "axis_detection", "data_validity", "image_quality", "method_confidence", "overall")


@query(f"WITH {O.REPORT} SELECT curve_id, {', '.join(f'round({f}, 6) AS {f}' for f in FACTORS)} FROM ov")
def confidence_report(spark, sf_dir):
    return event_report(spark, sf_dir).select("curve_id", *r6(*FACTORS))


GRADE_SQL = "CASE WHEN {0} >= 0.9 THEN 'A' WHEN {0} >= 0.8 THEN 'B' WHEN {0} >= 0.7 THEN 'C' WHEN {0} >= 0.6 THEN 'D' ELSE 'F' END"


@query(f"WITH {O.REPORT} SELECT curve_id, {GRADE_SQL.format('overall')} AS grade, 'ok' AS status, (ocr_confidence < 0.7)::BIGINT + (curve_smoothness < 0.7)::BIGINT + (axis_detection < 0.7)::BIGINT + (image_quality < 0.6)::BIGINT + (raw_validity < 0.7)::BIGINT + coalesce(nmae > 0.05, false)::BIGINT + (overall < 0.95)::BIGINT AS n_warnings FROM ov")
def confidence_grade(spark, sf_dir):
    return event_report(spark, sf_dir).select("curve_id", "grade", "status", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"WITH {O.REPORT} SELECT curve_id, round(overall * CASE WHEN least(ocr_confidence, curve_smoothness, axis_detection, data_validity) < 0.5 THEN 0.8 ELSE 1.0 END, 6) AS overall FROM ov")
def strict_score(spark, sf_dir):
    return event_report(spark, sf_dir, strict=True).select("curve_id", *r6("overall"))


# fixed values: what is advised where a factor is low
ADVICE_SQL = """(VALUES ('ocr_confidence', 'axis numbers are hard to read', 'use a sharper image with larger axis numbers'),
('curve_smoothness', 'the curve has jumps', 'clean the image or use a wider smoothing window'),
('axis_detection', 'few axis ticks were found', 'keep both axes and their tick labels in the image'),
('image_quality', 'the image is blurred, noisy or flat', 'scan again at a higher resolution'),
('data_validity', 'the points do not look like a test curve', 'check the region and the scale of the axes')) a(factor, issue, solution)"""


@query(f"""WITH {O.REPORT}, lg AS (SELECT curve_id, unnest(['ocr_confidence', 'curve_smoothness', 'axis_detection', 'image_quality', 'data_validity']) AS factor,
  unnest([ocr_confidence < 0.7, curve_smoothness < 0.7, axis_detection < 0.7, image_quality < 0.6, data_validity < 0.7]) AS low FROM ov)
SELECT curve_id, factor, issue, solution FROM lg JOIN {ADVICE_SQL} USING (factor) WHERE low""")
def improvement_suggestions(spark, sf_dir):
    return scoring.suggestions(event_report(spark, sf_dir))


# --- recognised text, ticks, scales ------------------------------------------


def document_tokens(spark, sf_dir) -> DataFrame:
    """Every word of every document as a recognised token, with confidence and box derived from its place."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if d.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a small file is one split, and its words many rows
        d = d.repartition(spark.sparkContext.defaultParallelism)
    return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))).alias("pos", "tok"))


@query(f"WITH {O.CLEAN} SELECT tok, cleaned, TRY_CAST(cleaned AS DOUBLE) AS value FROM cleaned")
def ocr_clean_numbers(spark, sf_dir):
    t = document_tokens(spark, sf_dir).select("tok").distinct()
    return t.select("tok", T.clean_number(F.col("tok")).alias("cleaned"), T.parse_number(F.col("tok")).alias("value"))


LABELS = [r"\(([^)]+)\)", r"\[([^\]]+)\]", "(kN/m²|kN/m2)", "(MPa)", "(%)", "(mm)"]


def _label_sql(unit: bool) -> str:
    cases = []
    for p in LABELS:
        q = p.replace("'", "''")
        hit = f"trim(regexp_extract(t, '{q}', 1))" if unit else f"nullif(trim(regexp_extract(t, '(?s)^(.*?){q}', 1)), '')"
        cases.append(f"WHEN regexp_matches(t, '{q}') THEN {hit}")
    return f"CASE {' '.join(cases)} ELSE {'NULL' if unit else 'nullif(t, NULL)'} END"


@query(f"WITH l AS (SELECT page_id, trim(unnest(string_split(html, chr(10)))) AS t FROM pages), d AS (SELECT DISTINCT t FROM l WHERE t <> '') SELECT t AS line, {_label_sql(False)} AS label, {_label_sql(True)} AS unit FROM d")
def axis_label_unit(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "\n")).alias("line")).select(F.trim("line").alias("line")).where("line <> ''").distinct()
    return lines.withColumn("a", T.axis_label(F.col("line"))).select("line", F.col("a.label").alias("label"), F.col("a.unit").alias("unit"))


TICK_TOKENS = r"tk AS (SELECT doc_id AS chart_id, u.tok AS text, u.pos AS pos FROM documents, LATERAL (SELECT unnest(regexp_extract_all(text, '[^ \t-\r]+')) AS tok, generate_subscripts(regexp_extract_all(text, '[^ \t-\r]+'), 1) - 1 AS pos) u)"


def _tick_tokens(spark, sf_dir) -> DataFrame:
    i = F.col("pos")
    return document_tokens(spark, sf_dir).select(F.col("doc_id").alias("chart_id"), F.when(i % 2 == 0, "x").otherwise("y").alias("axis"), F.col("tok").alias("text"), (40 + (i % 60)).cast("double").alias("conf"), (i * 10).alias("left"), (i * 7).alias("top"), (F.length("tok") * 8).alias("width"), F.lit(12).alias("height"))


@query(f"""WITH {TICK_TOKENS}, toks AS (SELECT text AS tok FROM tk), {O._CLEAN}
SELECT chart_id, CASE WHEN pos % 2 = 0 THEN 'x' ELSE 'y' END AS axis, CAST(CASE WHEN pos % 2 = 0 THEN pos * 10 + (length(text) * 8) // 2 ELSE pos * 7 + 6 END AS INTEGER) AS pixel_position, TRY_CAST(cleaned AS DOUBLE) AS value, (40 + pos % 60) / 100.0 AS confidence, text AS raw_text
FROM tk JOIN cleaned ON cleaned.tok = tk.text WHERE (40 + pos % 60) / 100.0 >= 0.5 AND TRY_CAST(cleaned AS DOUBLE) IS NOT NULL""")
def token_ticks(spark, sf_dir):
    return scale.ticks(_tick_tokens(spark, sf_dir))


@query("WITH t AS (SELECT s_nationkey AS k, s_suppkey AS p, s_acctbal AS v FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000) SELECT k AS chart_id, count(*) AS tick_count, count(*) >= 2 AS is_valid, arg_min(v, p) AS first_tick_value, arg_max(v, p) AS last_tick_value FROM t GROUP BY k")
def tick_ranges(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("chart_id"), F.lit("x").alias("axis"), F.col("s_suppkey").alias("pixel_position"), F.col("s_acctbal").alias("value"))
    return scale.axes(scale.in_range(t, 0, 5000)).drop("axis")


@query("SELECT o_orderpriority, count(*) AS n, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept, round(regr_r2(o_totalprice, o_custkey), 6) AS r2 FROM orders GROUP BY o_orderpriority")
def fit_ols(spark, sf_dir):
    f = scale.fit_ols(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice")
    return f.select("o_orderpriority", "n", *r6("slope"), F.round("intercept", 4).alias("intercept"), *r6("r2"))


@query("""WITH s AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y, l_discount + 0.01 AS w FROM lineitem),
a AS (SELECT f, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM s GROUP BY f)
SELECT f AS l_returnflag, n, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 4) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 4) AS intercept FROM a""")
def fit_weighted(spark, sf_dir):
    f = scale.fit_weighted(table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_discount") + 0.01), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH c AS (SELECT p_brand AS b, p_size AS x, CASE WHEN p_size % 2 = 0 THEN 5.0 ELSE 5.0 + p_partkey % 3 END AS y FROM part),
f AS (SELECT b, count(*) AS n, regr_syy(y, x) AS syy, greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / nullif(regr_sxx(y, x), 0), 0) AS res FROM c GROUP BY b)
SELECT b AS p_brand, n, round(CASE WHEN syy > 1e-12 THEN 1 - res / syy WHEN res <= 1e-12 THEN 1.0 ELSE 0.0 END, 6) AS r2 FROM f""")
def r_squared_guarded(spark, sf_dir):
    y = F.when(F.col("p_size") % 2 == 0, 5.0).otherwise(5.0 + F.col("p_partkey") % 3)
    return scale.fit_ols(table(spark, sf_dir, "part").withColumn("y", y), ["p_brand"], "p_size", "y").select("p_brand", "n", *r6("r2"))


def supplier_ticks(spark, sf_dir) -> DataFrame:
    """Tick sets per nation: mostly on a line, some off it."""
    s = table(spark, sf_dir, "supplier")
    p = F.col("s_suppkey").cast("double")
    return s.select(F.col("s_nationkey").alias("nation"), p.alias("x"), (3 * p + 7 + F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") / 50).otherwise(0.0)).alias("y"))


ROBUST = """t AS (SELECT s_nationkey AS nation, CAST(s_suppkey AS DOUBLE) AS x, 3 * CAST(s_suppkey AS DOUBLE) + 7 + CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal / 50 ELSE 0.0 END AS y FROM supplier),
nb AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY x, y) AS i FROM t),
ln AS (SELECT a.nation, a.i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM nb a JOIN nb b ON a.nation = b.nation AND a.i < b.i AND a.x <> b.x),
ea AS (SELECT ln.nation, ln.i, ln.j, count(*) AS inliers, regr_slope(t.y, t.x) AS slope, regr_intercept(t.y, t.x) AS intercept, regr_syy(t.y, t.x) AS syy, greatest(regr_syy(t.y, t.x) - regr_sxy(t.y, t.x) * regr_sxy(t.y, t.x) / nullif(regr_sxx(t.y, t.x), 0), 0) AS res FROM ln JOIN t ON t.nation = ln.nation WHERE abs(t.y - (m * t.x + c)) <= 5.0 GROUP BY ln.nation, ln.i, ln.j),
rk AS (SELECT *, CASE WHEN syy > 1e-12 THEN 1 - res / syy WHEN res <= 1e-12 THEN 1.0 ELSE 0.0 END AS r2 FROM ea),
best AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY inliers DESC, round(r2, 9) DESC, i, j) AS rn FROM rk)"""


@query(f"WITH {ROBUST} SELECT nation, inliers, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2 FROM best WHERE rn = 1")
def fit_robust(spark, sf_dir):
    """Through every pair of a nation's ticks."""
    return scale.fit_robust(supplier_ticks(spark, sf_dir), ["nation"], sample=None).select("nation", "inliers", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2")])


@query("""WITH t AS (SELECT o_orderpriority AS g, CAST(o_custkey % 4000 AS DOUBLE) AS x, 0.5 * (o_custkey % 4000) + o_orderkey % 3 + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 977 ELSE 0 END AS y FROM orders),
u AS (SELECT g, x, y, count(*) AS m FROM t GROUP BY g, x, y),
sp AS (SELECT g, x, y, row_number() OVER (PARTITION BY g ORDER BY x, y) AS i FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY md5('robust-1:' || x || ':' || y), x, y) <= 64)),
ln AS (SELECT a.g, a.i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS s, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM sp a JOIN sp b ON a.g = b.g AND a.i < b.i AND a.x <> b.x),
n AS (SELECT ln.g, i, j, CAST(sum(m) AS BIGINT) AS inliers FROM ln JOIN u ON u.g = ln.g WHERE abs(u.y - (s * u.x + c)) <= 5 GROUP BY ln.g, i, j),
mo AS (SELECT n.*, s, c FROM n JOIN ln USING (g, i, j) QUALIFY inliers = max(inliers) OVER (PARTITION BY n.g)),
f AS (SELECT mo.g, i, j, any_value(inliers) AS inliers, regr_slope(t.y, t.x) AS slope, regr_intercept(t.y, t.x) AS intercept, regr_r2(t.y, t.x) AS r2 FROM mo JOIN t ON t.g = mo.g WHERE abs(t.y - (s * t.x + c)) <= 5 GROUP BY mo.g, i, j)
SELECT g, CAST(inliers AS INTEGER) AS inliers, round(slope, 4) AS slope, round(intercept, 2) AS intercept, round(r2, 4) AS r2 FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(r2, 9) DESC, i, j) = 1""")
def fit_robust_large(spark, sf_dir):
    """Groups of thousands of points, a quarter of them off the line."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 4000).cast("double")
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), c.alias("x"), (0.5 * c + k % 3 + F.when(k % 4 == 0, k % 977).otherwise(0)).alias("y"))
    return scale.fit_robust(t, ["g"]).select("g", "inliers", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 4).alias("r2"))


def _embedding_points(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chart_id"), F.posexplode("embedding").alias("idx", "v")).select("chart_id", "idx", (100 + F.col("idx") * 5).alias("px"), F.round(F.col("v").cast("double") * 100 + 250).cast("int").alias("py"))


def _chart_scales(spark, sf_dir) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(i.alias("chart_id"), F.lit(100).alias("origin_x"), F.lit(500).alias("origin_y"), (0.01 + (i % 5) * 0.01).alias("x_scale"), F.lit(0.0).alias("x_offset"), (1.0 + i % 3).alias("y_scale"), (i % 2).cast("double").alias("y_offset"), (i % 4 != 0).alias("is_valid"))


EMB = "ep AS (SELECT vec_id AS chart_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, unnest(embedding) AS v FROM embeddings), px AS (SELECT chart_id, idx, 100 + idx * 5 AS px, CAST(round(CAST(v AS DOUBLE) * 100 + 250) AS INTEGER) AS py FROM ep)"


@query(f"WITH {EMB} SELECT chart_id, idx, round(CAST(CASE WHEN chart_id % 4 <> 0 THEN 0.0 + (px - 100) * (0.01 + (chart_id % 5) * 0.01) ELSE px END AS DOUBLE), 6) AS strain, round(CAST(CASE WHEN chart_id % 4 <> 0 THEN chart_id % 2 + (500 - py) * (1.0 + chart_id % 3) ELSE py END AS DOUBLE), 6) AS stress, px AS pixel_x, py AS pixel_y, CASE WHEN chart_id % 4 <> 0 THEN 'calibrated' ELSE 'pixel' END AS units FROM px")
def map_units(spark, sf_dir):
    return scale.map_units(_embedding_points(spark, sf_dir), _chart_scales(spark, sf_dir)).select("chart_id", "idx", *r6("strain", "stress"), "pixel_x", "pixel_y", "units")


@query(f"WITH {EMB}, c AS (SELECT chart_id, list(idx * (0.5 + chart_id % 3) ORDER BY idx) AS xs, list(CAST(py AS DOUBLE) - 240 + 500 * (chart_id % 2) + CASE WHEN chart_id % 5 = 0 THEN 10 * idx ELSE 0 END ORDER BY idx) AS ys FROM px GROUP BY chart_id) SELECT chart_id, (list_max(xs) > 60)::BIGINT + (list_min(ys) < 0 OR list_max(ys) > 50000)::BIGINT + (len(list_filter(range(1, len(ys) // 4), lambda i: ys[i + 1] < ys[i])) > 0)::BIGINT AS n_issues FROM c")
def validate_mapping(spark, sf_dir):
    c = _embedding_points(spark, sf_dir).select(F.col("chart_id").alias("curve_id"), "idx", (F.col("idx") * (0.5 + F.col("chart_id") % 3)).alias("x"), (F.col("py") - 240 + 500 * (F.col("chart_id") % 2) + F.when(F.col("chart_id") % 5 == 0, 10 * F.col("idx")).otherwise(0)).cast("double").alias("y"))
    return C.ordered(c).select(F.col("curve_id").alias("chart_id"), F.size(scale.mapping_issues(F.col("xs"), F.col("ys"), (0, 60))).cast("long").alias("n_issues"))


@query(f"WITH {EMB} SELECT chart_id, idx, CAST(px AS DOUBLE) AS strain, CAST(py AS DOUBLE) AS stress FROM px WHERE chart_id % 4 = 0")
def pixel_fallback(spark, sf_dir):
    return scale.map_units(_embedding_points(spark, sf_dir), _chart_scales(spark, sf_dir)).where("units = 'pixel'").select("chart_id", "idx", "strain", "stress")


@query("""WITH c AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 > 0 THEN (p_size % 7 - 1) / 100.0 END AS xm, CASE WHEN p_size % 4 > 0 THEN -(p_partkey % 9) / 50.0 END AS ym, p_size * 1.0 AS x0, p_partkey % 11 * 1.0 AS y0 FROM part),
d AS (SELECT *, x0 - 20 * xm AS xo, y0 + 20 * ym AS yo FROM c)
SELECT k, round(CASE WHEN xm IS NULL OR xm = 0 THEN 1.0 ELSE xm END, 6) AS x_scale, round(coalesce(xo, 0.0), 6) AS x_offset, round(CASE WHEN ym IS NULL OR ym = 0 THEN 1.0 ELSE -ym END, 6) AS y_scale, round(coalesce(yo, 0.0), 6) AS y_offset,
  CAST(xm IS NOT NULL AS DOUBLE) AS x_r2, CAST(ym IS NOT NULL AS DOUBLE) AS y_r2, coalesce(xm > 0 AND ym IS NOT NULL, false) AS is_valid FROM d""")
def scale_defaults(spark, sf_dir):
    """Charts of two ticks an axis, where an axis may lack one; the origin lies 20 pixels left of the first x tick and 20 below the first y tick."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chart_id"), F.col("p_size").alias("size"))
    i, xm, ym, x0, y0 = F.col("chart_id"), (F.col("size") % 7 - 1) / 100.0, -(F.col("chart_id") % 9) / 50.0, F.col("size") * 1.0, F.col("chart_id") % 11 * 1.0
    tick = lambda axis, at, v, ok: F.when(ok, F.struct(F.lit(axis).alias("axis"), F.lit(at).alias("pixel_position"), v.alias("value"), (0.5 + i % 5 / 10).alias("confidence")))
    ticks = F.array_compact(F.array(tick("x", 120, x0, F.lit(True)), tick("x", 220, x0 + 100 * xm, F.col("size") % 5 > 0), tick("y", 480, y0, F.lit(True)), tick("y", 380, y0 - 100 * ym, F.col("size") % 4 > 0)))
    f = scale.scale_factors(p.select("chart_id", F.inline(ticks)), p.select("chart_id", F.lit(100).alias("origin_x"), F.lit(500).alias("origin_y")))
    return f.select(F.col("chart_id").alias("k"), *r6("x_scale", "x_offset", "y_scale", "y_offset", "x_r2", "y_r2"), "is_valid")


# --- merging, routing ---------------------------------------------------------


def _daily(spark, sf_dir, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("curve_id"), F.expr("datediff(cast(ts as date), DATE'2024-01-01')").alias("x")).agg(F.max("value").alias("y"))


MERGE = "d AS (SELECT user_id AS curve_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x, max(value) AS y FROM events GROUP BY ALL)"


@query(f"""WITH {MERGE}, a AS (SELECT * FROM d WHERE event_type = 'click'), b AS (SELECT * FROM d WHERE event_type = 'view'), m AS (SELECT coalesce(a.curve_id, b.curve_id) AS curve_id, coalesce(a.x, b.x) AS x, a.y AS ya, b.y AS yb FROM a FULL JOIN b ON a.curve_id = b.curve_id AND a.x = b.x),
c AS (SELECT *, (curve_id % 5) / 10.0 AS ca, (curve_id % 3) / 10.0 AS cb FROM m)
SELECT curve_id, CAST(x AS INTEGER) AS x, CAST(trunc(CASE WHEN ya IS NOT NULL AND yb IS NOT NULL THEN CASE WHEN ca + cb > 0 THEN ca / (ca + cb) * ya + cb / (ca + cb) * yb ELSE ya END ELSE coalesce(ya, yb) END) AS INTEGER) AS y FROM c WHERE ca + cb > 0 OR ya IS NOT NULL""")
def merge_curves_weighted(spark, sf_dir):
    i = F.col("curve_id")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("curve_id")).distinct().select("curve_id", ((i % 5) / 10.0).alias("conf_a"), ((i % 3) / 10.0).alias("conf_b"))
    return merge.merge_weighted(_daily(spark, sf_dir, "click"), _daily(spark, sf_dir, "view"), users)


@query("WITH e AS (SELECT vec_id, (vec_id % 11) / 10.0 AS c, (vec_id % 7) / 6.0 AS u FROM embeddings) SELECT vec_id, CASE WHEN c >= u AND c > 0 THEN 'contour_tracing' WHEN u > 0 THEN 'unet_segmentation' ELSE 'extraction_failed' END AS method, round(greatest(c, u), 6) AS confidence FROM e")
def select_best_method(spark, sf_dir):
    i = F.col("vec_id")
    m = merge.best_method((i % 11) / 10.0, F.lit(5), (i % 7) / 6.0, F.lit(5))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.col("m.method").alias("method"), F.round("m.confidence", 6).alias("confidence"))


@query("WITH e AS (SELECT vec_id, (vec_id % 10) / 10.0 AS q, (vec_id % 11) / 10.0 AS c, (vec_id % 7) / 6.0 AS u FROM embeddings) SELECT vec_id, CASE WHEN q >= 0.7 AND c >= 0.7 THEN 'contour_tracing' WHEN q >= 0.7 THEN 'unet_fallback' ELSE 'unet_primary' END AS method, round(CASE WHEN q >= 0.7 AND c >= 0.7 THEN c ELSE u END, 6) AS confidence FROM e")
def route_by_quality(spark, sf_dir):
    i = F.col("vec_id")
    m = merge.route((i % 10) / 10.0, (i % 11) / 10.0, F.lit(5), (i % 7) / 6.0, F.lit(5))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.col("m.method").alias("method"), F.round("m.confidence", 6).alias("confidence"))


# --- images as 8 x 8 arrays ---------------------------------------------------


def _pixels(spark, sf_dir) -> DataFrame:
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 400 + 128))).cast("int"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), v.alias("a"))
    return images.pixels(e, F.col("a"), F.lit(8))


PIX = "pv AS (SELECT vec_id AS image_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, CAST(greatest(0, least(255, round(CAST(unnest(embedding) AS DOUBLE) * 400 + 128))) AS INTEGER) AS v FROM embeddings), px AS (SELECT image_id, k % 8 AS px, k // 8 AS py, v FROM pv)"
LAP = PIX + ", lp AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS dn FROM px WINDOW r AS (PARTITION BY image_id, py ORDER BY px), c AS (PARTITION BY image_id, px ORDER BY py)), la AS (SELECT image_id, v, coalesce(l, rr) + coalesce(rr, l) + coalesce(u, dn) + coalesce(dn, u) - 4 * v AS q FROM lp)"


def gray_images(spark, sf_dir) -> DataFrame:
    """8 x 8 grey images as bytes, of contrast that differs between them."""
    i = F.col("vec_id")
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 400 / (1 + 4 * (i % 9)) + 128))).cast("int"))
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(i.alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


GRAY = "gv AS (SELECT vec_id AS image_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, CAST(greatest(0, least(255, round(CAST(unnest(embedding) AS DOUBLE) * 400 / (1 + 4 * (vec_id % 9)) + 128))) AS INTEGER) AS v FROM embeddings), px AS (SELECT image_id, k % 8 AS px, k // 8 AS py, v FROM gv)"
GRAY_LAP = GRAY + ", lp AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS dn FROM px WINDOW r AS (PARTITION BY image_id, py ORDER BY px), c AS (PARTITION BY image_id, px ORDER BY py)), la AS (SELECT image_id, v, coalesce(l, rr) + coalesce(rr, l) + coalesce(u, dn) + coalesce(dn, u) - 4 * v AS q FROM lp)"
_AT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
NEAR = f"nb AS (SELECT DISTINCT a.a AS px, b.a AS py, dx, dy, {_AT.format('a.a + dx')} AS qx, {_AT.format('b.a + dy')} AS qy FROM range(8) a(a), range(8) b(a), range(-2, 3) c(dx), range(-2, 3) d(dy))"
MEANS = NEAR + ", lm AS (SELECT p.image_id, p.px, p.py, any_value(p.v) AS v, avg(q.v) AS m FROM px p JOIN nb ON nb.px = p.px AND nb.py = p.py JOIN px q ON q.image_id = p.image_id AND q.px = qx AND q.py = qy GROUP BY p.image_id, p.px, p.py)"


@query(f"WITH {GRAY}, {MEANS} SELECT image_id, px, py, round(m, 6) AS v FROM lm")
def local_means(spark, sf_dir):
    return images.gray_pixels(gray_images(spark, sf_dir), 5).select("image_id", "px", "py", *r6("v"))


@query(f"""WITH {GRAY_LAP}, {MEANS}, sq AS (SELECT image_id, px, py, (v - round(m)) * (v - round(m)) AS s FROM lm),
no AS (SELECT p.image_id, least(avg(q.s) / 1000, 1) AS noise FROM sq p JOIN nb ON nb.px = p.px AND nb.py = p.py JOIN sq q ON q.image_id = p.image_id AND q.px = qx AND q.py = qy GROUP BY p.image_id),
bc AS (SELECT image_id, 1 - least(var_pop(q) / 500, 1) AS blur, least(stddev_pop(v) / 60, 1) AS contrast FROM la GROUP BY image_id)
SELECT image_id, CAST(round(blur * 2048000) AS BIGINT) AS blur, CAST(round(noise * 1600000) AS BIGINT) AS noise, round(contrast, 6) AS contrast, round(0.35 * (1 - blur) + 0.35 * (1 - noise) + 0.30 * contrast, 6) AS overall FROM bc JOIN no USING (image_id)""")
def image_quality(spark, sf_dir):
    """Blur and noise in units in which variances of 64 and means of 25 whole numbers are whole."""
    return images.quality(gray_images(spark, sf_dir)).select("image_id", F.round(F.col("blur") * 2048000).cast("long").alias("blur"), F.round(F.col("noise") * 1600000).cast("long").alias("noise"), *r6("contrast", "overall"))


@query(f"WITH {GRAY_LAP} SELECT image_id, CAST(round(least(var_pop(q) / 1000, 1) * 4096000) AS BIGINT) AS noise FROM la GROUP BY image_id")
def noise_estimate(spark, sf_dir):
    """In units in which the variances of 64 whole numbers are whole."""
    return images.noise(gray_images(spark, sf_dir)).select("image_id", F.round(F.col("noise") * 4096000).cast("long").alias("noise"))


@query("""WITH e AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, round(CAST(x AS DOUBLE) * 400 + 128))) AS INTEGER)) AS a FROM embeddings)
SELECT image_id, CAST(k % 7 AS INTEGER) AS px, CAST(k // 7 AS INTEGER) AS py, CAST((114 * a[3 * k + 1] + 587 * a[3 * k + 2] + 299 * a[3 * k + 3] + 500) // 1000 AS DOUBLE) AS v FROM e, range(21) t(k)""")
def gray_levels(spark, sf_dir):
    """Blue-green-red images of 7 x 3."""
    v = F.transform(F.slice("embedding", 1, 63), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 400 + 128))).cast("int"))
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    rgb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(3).alias("height"), F.lit(7).alias("width"), F.lit(3).alias("channels"), data.alias("data"))
    return images.gray_pixels(rgb)


BARS = "CAST(greatest(0, least(7, floor(CAST(embedding[x + 1] AS DOUBLE) * 14 + 4))) AS INTEGER)"


def bar_masks(spark, sf_dir) -> DataFrame:
    """8 x 8 masks that are on from some height down to the bottom in every column."""
    top = lambda x: F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.get("embedding", x).cast("double") * 14 + 4))).cast("int")
    on = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(F.floor(k / 8) >= top(k % 8), "FF").otherwise("00"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(on, "")).alias("data"))


@query(f"WITH t AS (SELECT vec_id AS image_id, CAST(x AS INTEGER) AS px, {BARS} AS t FROM embeddings, range(8) r(x)) SELECT image_id, px AS idx, px, CAST((t + 7) // 2 AS INTEGER) AS py FROM t")
def traced_masks(spark, sf_dir):
    return images.trace(bar_masks(spark, sf_dir))


@query(f"""WITH RECURSIVE b AS (SELECT vec_id AS image_id, list_transform(range(64), lambda k: k // 8 >= {BARS.replace('x + 1', 'k % 8 + 1')}) AS a FROM embeddings),
s(image_id, n, a) AS (SELECT image_id, 0, a FROM b
  UNION ALL SELECT image_id, n + 1, list_transform(range(64), lambda k: a[k + 1] AND (k % 8 = 0 OR a[k]) AND (k % 8 = 7 OR a[k + 2]) AND (k < 8 OR a[k - 7]) AND (k > 55 OR a[k + 9])) FROM s WHERE list_contains(a, true) AND n < 64)
SELECT DISTINCT s.image_id, CAST(k % 8 AS INTEGER) AS px, CAST(k // 8 AS INTEGER) AS py FROM s JOIN s t ON t.image_id = s.image_id AND t.n = s.n + 1, range(64) r(k)
WHERE s.a[k + 1] AND NOT (t.a[k + 1] OR (k % 8 > 0 AND t.a[k]) OR (k % 8 < 7 AND t.a[k + 2]) OR (k > 7 AND t.a[k - 7]) OR (k < 56 AND t.a[k + 9]))""")
def skeletons(spark, sf_dir):
    return images.skeleton(bar_masks(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAY}, {NEAR},
gr AS (SELECT p.image_id, p.px, p.py, sum(q.v * dx * (2 - abs(dy))) AS gx, sum(q.v * dy * (2 - abs(dx))) AS gy FROM px p JOIN nb ON nb.px = p.px AND nb.py = p.py JOIN px q ON q.image_id = p.image_id AND q.px = qx AND q.py = qy WHERE abs(dx) < 2 AND abs(dy) < 2 GROUP BY p.image_id, p.px, p.py),
sz AS (SELECT image_id, px, py, abs(gx) + abs(gy) AS size, (CAST(round_even(atan2(gy, gx) / (pi() / 4), 0) AS INTEGER) + 8) % 4 AS turn FROM gr),
st AS (SELECT *, CASE turn WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END AS sx, CASE turn WHEN 0 THEN 0 ELSE 1 END AS sy FROM sz),
wk AS (SELECT s.image_id, s.px, s.py, s.size FROM st s LEFT JOIN sz a ON a.image_id = s.image_id AND a.px = s.px + sx AND a.py = s.py + sy LEFT JOIN sz b ON b.image_id = s.image_id AND b.px = s.px - sx AND b.py = s.py - sy
  WHERE s.size > 50 AND s.size >= coalesce(a.size, 0) AND s.size > coalesce(b.size, 0)),
ed(image_id, px, py) AS (SELECT image_id, px, py FROM wk WHERE size > 150 UNION SELECT w.image_id, w.px, w.py FROM ed JOIN wk w ON w.image_id = ed.image_id AND abs(w.px - ed.px) < 2 AND abs(w.py - ed.py) < 2),
wd AS (SELECT DISTINCT image_id, px + i AS px, py + j AS py FROM ed, range(2) r(i), range(2) c(j))
SELECT p.image_id, string_agg(CASE WHEN wd.px IS NULL THEN '00' ELSE 'FF' END, '' ORDER BY p.py, p.px) AS mask FROM px p LEFT JOIN wd ON wd.image_id = p.image_id AND wd.px = p.px AND wd.py = p.py GROUP BY p.image_id""")
def edge_masks(spark, sf_dir):
    return images.edge_mask(gray_images(spark, sf_dir)).select("image_id", F.hex("data").alias("mask"))


@query("SELECT s_suppkey AS image_id, CAST(s_suppkey % 11 - 5 AS DOUBLE) AS angle FROM supplier")
def tilted_sheets(spark, sf_dir):
    """Strokes drawn askew by whole degrees, and what they are found to be askew by."""
    degrees = F.col("image_id") % 11 - 5
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")).repartition(spark.sparkContext.defaultParallelism)
    ys = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.round(100 + (k - 200) * F.tan(F.radians(degrees))).cast("int"))
    return images.rectify(images.drawn(e.select("image_id", ys.alias("ys")), 200, 440, 20)).select("image_id", F.round("angle").alias("angle"))


SPOTS = "m AS (SELECT vec_id AS image_id, CAST(k % 8 AS INTEGER) AS px, CAST(k // 8 AS INTEGER) AS py FROM embeddings, range(64) r(k) WHERE embedding[k + 1] > 0.03)"


def spot_masks(spark, sf_dir) -> DataFrame:
    """8 x 8 masks of scattered spots, some within holes of others."""
    on = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.03, "FF").otherwise("00"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(on, "")).alias("data"))


@query(f"""WITH RECURSIVE {SPOTS},
ways(d, dx, dy) AS (VALUES (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, -1), (4, -1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)),
nb AS (SELECT a.image_id, a.px, a.py, d, b.px AS qx, b.py AS qy FROM m a, ways JOIN m b ON b.image_id = a.image_id AND b.px = a.px + dx AND b.py = a.py + dy),
nx AS (SELECT image_id, px, py, back, min_by(d, (d - back + 15) % 8) AS d, min_by(qx, (d - back + 15) % 8) AS qx, min_by(qy, (d - back + 15) % 8) AS qy FROM nb, range(8) r(back) GROUP BY image_id, px, py, back),
st AS (SELECT a.image_id, a.px, a.py, min_by(d, (12 - d) % 8) AS back, min_by(qx, (12 - d) % 8) AS lx, min_by(qy, (12 - d) % 8) AS ly FROM m a LEFT JOIN nb USING (image_id, px, py) WHERE NOT EXISTS (FROM m l WHERE l.image_id = a.image_id AND l.px = a.px - 1 AND l.py = a.py) GROUP BY a.image_id, a.px, a.py),
wk(image_id, sx, sy, lx, ly, n, px, py, back) AS (SELECT image_id, px, py, lx, ly, 0, px, py, back FROM st
  UNION ALL SELECT w.image_id, sx, sy, lx, ly, n + 1, nx.qx, nx.qy, (nx.d + 4) % 8 FROM wk w JOIN nx ON nx.image_id = w.image_id AND nx.px = w.px AND nx.py = w.py AND nx.back = w.back WHERE NOT (nx.qx = sx AND nx.qy = sy AND w.px = lx AND w.py = ly) AND n < 500),
cells AS (SELECT image_id, x - 1 AS px, y - 1 AS py FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings), range(10) a(x), range(10) b(y) WHERE NOT EXISTS (FROM m WHERE m.image_id = vec_id AND m.px = x - 1 AND m.py = y - 1)),
sea(image_id, px, py) AS (SELECT image_id, px, py FROM cells WHERE px = -1 AND py = -1 UNION SELECT c.image_id, c.px, c.py FROM sea s JOIN cells c ON c.image_id = s.image_id AND abs(c.px - s.px) + abs(c.py - s.py) = 1),
ow AS (SELECT w.*, dense_rank() OVER (PARTITION BY w.image_id ORDER BY sy, sx) AS part FROM wk w JOIN sea ON sea.image_id = w.image_id AND sea.px = sx - 1 AND sea.py = sy WHERE (w.image_id, sx, sy) IN (SELECT image_id, sx, sy FROM wk GROUP BY image_id, sx, sy HAVING min(py * 8 + px) = sy * 8 + sx)),
sh AS (SELECT *, lead(px) OVER o AS fx, lead(py) OVER o AS fy, first_value(px) OVER o AS cx, first_value(py) OVER o AS cy FROM ow WINDOW o AS (PARTITION BY image_id, part ORDER BY n))
SELECT image_id, CAST(part AS INTEGER) AS part, n AS idx, px, py, abs(sum(px * coalesce(fy, cy) - coalesce(fx, cx) * py) OVER (PARTITION BY image_id, part)) / 2.0 AS area, round(coalesce(sum(sqrt((fx - px) * (fx - px) + (fy - py) * (fy - py))) OVER (PARTITION BY image_id, part), 0.0), 6) AS arc FROM sh""".replace("FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings), range(10)", "FROM (SELECT DISTINCT vec_id AS image_id, vec_id FROM embeddings), range(10)"))
def mask_outlines(spark, sf_dir):
    """The walks around the parts of scattered masks, with what they enclose."""
    return images.outlines(spot_masks(spark, sf_dir)).select("image_id", "part", "idx", "px", "py", "area", *r6("arc"))


SHEET_H, SHEET_W = 64, 80


@query("""WITH k AS (SELECT s_suppkey AS image_id, s_suppkey % 2 AS a, s_suppkey // 2 % 2 AS b, s_suppkey // 4 % 2 AS c FROM supplier)
SELECT image_id, corner, CAST(CASE corner WHEN 0 THEN 8 + 8 * a WHEN 1 THEN 72 - 8 * b WHEN 2 THEN 72 - 8 * c ELSE 8 + 8 * c END AS DOUBLE) AS x, CAST(CASE corner WHEN 0 THEN 8 + 8 * c WHEN 1 THEN 8 + 8 * a WHEN 2 THEN 56 - 8 * b ELSE 56 - 8 * a END AS DOUBLE) AS y, true AS near
FROM k, (VALUES (0), (1), (2), (3)) v(corner)""")
def sheet_corners(spark, sf_dir):
    """Light sheets on a dark table, each with corners of its own, in whole eights; found within two pixels."""
    i = F.col("s_suppkey")
    a, b, c = i % 2, F.floor(i / 2) % 2, F.floor(i / 4) % 2
    corners = [(8 + 8 * a, 8 + 8 * c), (72 - 8 * b, 8 + 8 * a), (72 - 8 * c, 56 - 8 * b), (8 + 8 * c, 56 - 8 * a)]
    e = table(spark, sf_dir, "supplier").select(i.alias("image_id"), F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in corners]).alias("q")).repartition(spark.sparkContext.defaultParallelism)
    side = lambda p, q, k: (q["x"] - p["x"]) * (F.floor(k / SHEET_W) - p["y"]) - (q["y"] - p["y"]) * (k % SHEET_W - p["x"]) >= 0
    at = [F.get("q", F.lit(j)) for j in range(4)]
    inside = lambda k: side(at[0], at[1], k) & side(at[1], at[2], k) & side(at[2], at[3], k) & side(at[3], at[0], k)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SHEET_H * SHEET_W - 1)), lambda k: F.when(inside(k), "DC").otherwise("1E")), ""))
    found = images.sheet_corners(e.select("image_id", F.lit(SHEET_H).alias("height"), F.lit(SHEET_W).alias("width"), F.lit(1).alias("channels"), data.alias("data")))
    eight = lambda c: F.round(F.col(c) / 8) * 8
    return found.select("image_id", "corner", eight("x").alias("x"), eight("y").alias("y"), ((F.abs(F.col("x") - eight("x")) <= 2) & (F.abs(F.col("y") - eight("y")) <= 2)).alias("near"))


@query("SELECT s_suppkey AS image_id, CAST(10 + 40 * k AS INTEGER) AS px, CAST(50 + abs((10 + 40 * k + 20 * s_suppkey) % 160 - 80) AS DOUBLE) AS py FROM supplier, range(8) r(k)")
def grid_removed(spark, sf_dir):
    """Zigzag curves under a grid of lines across and up: what is traced once the grid is painted over, in whole tens."""
    ys = F.transform(F.sequence(F.lit(0), F.lit(319)), lambda x: (50 + F.abs((x + 20 * F.col("image_id")) % 160 - 80)).cast("int"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")).repartition(spark.sparkContext.defaultParallelism)
    grid = images.ruled(images.drawn(e.select("image_id", ys.alias("ys")), 180, 320, 0, 5), 32, 2)
    at = images.trace(images.curve_mask(grid).drop("error")).where("px % 40 = 10")
    return at.select("image_id", "px", (F.round(F.col("py") / 10) * 10).alias("py"))


def _kernel_sql(place: str, i: str) -> str:
    """The weight of sample ``i`` at a place between samples, by the cubic kernel with slope -3/4."""
    d = f"abs({place} - ({i}))"
    return f"CASE WHEN {d} <= 1 THEN 1.25 * {d} * {d} * {d} - 2.25 * {d} * {d} + 1 WHEN {d} < 2 THEN -0.75 * {d} * {d} * {d} + 3.75 * {d} * {d} - 6 * {d} + 3 ELSE 0 END"


_EDGE = "greatest(0, least(7, {0}))"


@query(f"""WITH {GRAY}, w AS (SELECT o, i, {_EDGE.format('i')} AS at, {_kernel_sql('(o + 0.5) / 2 - 0.5', 'i')} AS w FROM range(16) a(o), range(-3, 11) b(i)),
c AS (SELECT image_id, CAST(h.o AS INTEGER) AS px, CAST(v.o AS INTEGER) AS py, greatest(0, least(255, round_even(sum(v.w * h.w * p.v), 0))) AS v FROM w v, w h JOIN px p ON p.px = h.at AND p.py = v.at WHERE v.w <> 0 AND h.w <> 0 GROUP BY image_id, h.o, v.o),
s AS (SELECT image_id, px // 2 AS px, py // 2 AS py, round_even(avg(v), 0) AS v FROM px GROUP BY ALL)
SELECT image_id, 'cubic' AS kind, px, py, CAST(v AS DOUBLE) AS v FROM c UNION ALL SELECT image_id, 'area', CAST(px AS INTEGER), CAST(py AS INTEGER), CAST(v AS DOUBLE) FROM s""")
def resized_images(spark, sf_dir):
    """Grey images at twice the size by the cubic kernel, and at half by means."""
    g = gray_images(spark, sf_dir)
    shown = lambda n, kind: images.gray_pixels(images.resize(g, n, n, kind).where("error is null").drop("error")).select("image_id", F.lit(kind).alias("kind"), "px", "py", "v")
    return shown(16, "cubic").unionByName(shown(4, "area"))


POINTS_AT = "at AS (SELECT DISTINCT image_id, CAST(image_id % 8 AS INTEGER) AS px FROM px)"


def _image_points(spark, sf_dir) -> DataFrame:
    """A point per row of each 8 x 8 image, in one column."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("idx"))
    return e.select("image_id", "idx", (F.col("image_id") % 8).cast("int").alias("px"), F.col("idx").alias("py"))


@query(f"""WITH {PIX}, p AS (SELECT image_id, px, py, py AS idx FROM px WHERE px = image_id % 8),
d AS (SELECT p.image_id, p.idx, p.px, p.py, arg_min(q.py, (q.v, q.py)) FILTER (WHERE q.v < 255) AS near FROM p JOIN px q ON q.image_id = p.image_id AND q.px = p.px AND q.py BETWEEN p.py - 5 AND p.py + 5 GROUP BY ALL)
SELECT image_id, idx, px, coalesce(near, py) AS py FROM d""")
def darkest_pixels(spark, sf_dir):
    return contours.darkest_near(_pixels(spark, sf_dir), _image_points(spark, sf_dir))


@query(f"WITH {PIX} SELECT image_id, round(avg(v / 255.0), 6) AS probability FROM px WHERE px = image_id % 8 GROUP BY image_id")
def curve_probability(spark, sf_dir):
    maps = _pixels(spark, sf_dir).select("image_id", "px", "py", (F.col("v") / 255.0).alias("p"))
    return merge.mean_probability(maps, _image_points(spark, sf_dir)).select("image_id", *r6("probability"))


@query(f"WITH {PIX} SELECT image_id, px, py, 'union' AS op FROM px WHERE v > 128 OR px >= py UNION ALL SELECT image_id, px, py, 'minus' FROM px WHERE v > 128 AND px < py")
def mask_sets(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    a, b = p.where("v > 128"), p.where("px >= py")
    return merge.mask_union(a, b).withColumn("op", F.lit("union")).unionAll(merge.mask_minus(a, b).withColumn("op", F.lit("minus")))


@query(f"WITH {PIX} SELECT image_id, round((2 * count_if(v > 128 AND px >= py) + 1) / (count_if(v > 128) + count_if(px >= py) + 1), 6) AS dice FROM px GROUP BY image_id")
def mask_overlap(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("a", (F.col("v") > 128).cast("int")).withColumn("b", (F.col("px") >= F.col("py")).cast("int"))
    return p.groupBy("image_id").agg(F.round(merge.dice(F.sum(F.col("a") * F.col("b")), F.sum("a"), F.sum("b")), 6).alias("dice"))


@query(f"WITH {PIX}, b AS (SELECT image_id, greatest(min(px) - 1, 0) AS x, greatest(min(py) - 1, 0) AS y, max(px) AS x1, max(py) AS y1 FROM px WHERE v > 170 GROUP BY image_id) SELECT image_id, x, y, least(x1 + 2, 8) - x AS w, least(y1 + 2, 8) - y AS h FROM b")
def bbox_autocrop(spark, sf_dir):
    return images.auto_crop(_pixels(spark, sf_dir), 170, 1, 8, 8)


@query(f"WITH {PIX} SELECT image_id, px, py, v FROM px WHERE px >= 2 AND px < 6 AND py >= 1 AND py < 4")
def region_crop(spark, sf_dir):
    return C.region_crop(_pixels(spark, sf_dir), 2, 1, 4, 3)


@query(f"""WITH RECURSIVE {PIX}, m AS (SELECT image_id, px, py, py * 8 + px AS id FROM px WHERE v > 128),
e AS (SELECT a.image_id, a.id AS s, b.id AS t FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
r(image_id, id, root) AS (SELECT image_id, id, id FROM m UNION SELECT r.image_id, e.t, r.root FROM r JOIN e ON e.image_id = r.image_id AND e.s = r.id),
c AS (SELECT image_id, id, min(root) AS root FROM r GROUP BY image_id, id),
n AS (SELECT image_id, root, count(*) AS area, row_number() OVER (PARTITION BY image_id ORDER BY root) AS component FROM c GROUP BY image_id, root)
SELECT image_id, CAST(component AS INTEGER) AS component, CAST(area AS INTEGER) AS area FROM n WHERE area >= 3""")
def small_components(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: (F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 400 + 128))).cast("int") > 128).cast("int")).alias("mask"))
    return images.array_components(e, 8, 3)


# --- contours -----------------------------------------------------------------


def _contours(spark, sf_dir) -> DataFrame:
    s = C.dedup_first(shipments(spark, sf_dir))
    return s.select(F.col("curve_id").alias("contour_id"), (F.col("curve_id") % 10).alias("image_id"), F.col("x").alias("idx"), F.col("x").cast("double").alias("x"), (F.col("y") * 4).alias("y"))


CONTOUR = SHIP + """, ct AS (SELECT curve_id AS contour_id, curve_id % 10 AS image_id, x AS idx, CAST(x AS DOUBLE) AS x, arg_min(y, idx) * 4 AS y FROM sh GROUP BY curve_id, x),
st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ct WINDOW w AS (PARTITION BY contour_id ORDER BY idx)),
cs AS (SELECT image_id, contour_id, count(*) AS n, min(x) AS l, min(y) AS t, max(x) - min(x) AS w, max(y) - min(y) AS h, coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0) AS arc FROM st GROUP BY image_id, contour_id)"""
_SCORE = "0.35 * w / 3000 + 0.25 * (1 - (t + h / 2) / 300) + 0.20 * least(w / greatest(h, 1), 5) / 5 + 0.20 * least(arc / greatest(sqrt(w * w + h * h), 1), 2) / 2"


@query(f"WITH {CONTOUR} SELECT image_id, contour_id, n, round(arc, 4) AS arc, round({_SCORE}, 6) AS score FROM cs WHERE arc >= 100 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {_SCORE} DESC, contour_id) = 1")
def contour_score(spark, sf_dir):
    m = contours.measures(_contours(spark, sf_dir), ["image_id", "contour_id"])
    return contours.best_contour(m, "image_id", "contour_id", F.lit(3000.0), F.lit(300.0)).select("image_id", "contour_id", "n", F.round("arc", 4).alias("arc"), *r6("score"))


@query(f"WITH {CONTOUR}, s AS (SELECT *, 0.4 * w / 3000 + 0.3 * (1 - t / 300) + 0.3 * least(w / greatest(h, 1), 3) / 3 AS score FROM cs) SELECT image_id, contour_id, round(score, 6) AS score FROM s QUALIFY score >= 0.5 * max(score) OVER (PARTITION BY image_id)")
def contour_isolate(spark, sf_dir):
    m = contours.measures(_contours(spark, sf_dir), ["image_id", "contour_id"])
    return contours.isolate(m, "image_id", F.lit(3000.0), F.lit(300.0)).select("image_id", "contour_id", *r6("score"))


@query(f"""WITH {CONTOUR}, j AS (SELECT contour_id, x, y, lag(y) OVER (PARTITION BY contour_id ORDER BY idx) AS y0, avg(y) OVER (PARTITION BY contour_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ys FROM ct),
a AS (SELECT contour_id, count(*) AS n, max(x) - min(x) AS span, avg(abs(y - ys)) AS dev, count_if(y > y0 + 10) AS jumps FROM j GROUP BY contour_id)
SELECT contour_id, n, round(CASE WHEN n < 5 THEN 0.0 ELSE 0.25 * least(10 * n / greatest(span, 1), 1) + 0.30 * greatest(0, 1 - dev / 50) + 0.25 * least(2 * span / 3000, 1) + 0.20 * greatest(0, 1 - jumps / n) END, 6) AS confidence FROM a""")
def extraction_confidence(spark, sf_dir):
    near = Window.partitionBy("contour_id").orderBy("idx").rowsBetween(-2, 2)
    c = _contours(spark, sf_dir).withColumn("ys", F.avg("y").over(near))
    return contours.extraction_confidence(c, ["contour_id"], F.lit(3000.0)).select("contour_id", "n", *r6("confidence"))


@query(f"""WITH {O.PTS}, s AS (SELECT curve_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY curve_id ORDER BY x, idx)),
a AS (SELECT curve_id, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM s WHERE x2 IS NOT NULL), d AS (SELECT curve_id, CASE WHEN abs(a) < 45 THEN a WHEN abs(a) > 45 THEN CASE WHEN a > 0 THEN a - 90 ELSE a + 90 END END AS dev FROM a)
SELECT curve_id, round(median(dev), 6) AS skew, count(dev) AS lines FROM d GROUP BY curve_id""")
def line_skew_median(spark, sf_dir):
    w = Window.partitionBy("curve_id").orderBy("x", "idx")
    lines = points(spark, sf_dir).select("curve_id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return contours.skew(lines, ["curve_id"]).select("curve_id", *r6("skew"), "lines")


@query(f"WITH {O.PTS}, p AS (SELECT curve_id, x, y FROM pts) SELECT curve_id, round(arg_min(x, x + y), 6) AS tl_x, round(arg_min(x, y - x), 6) AS tr_x, round(arg_max(x, x + y), 6) AS br_x, round(arg_max(x, y - x), 6) AS bl_x FROM p GROUP BY curve_id")
def corner_points(spark, sf_dir):
    c = contours.corners(points(spark, sf_dir), ["curve_id"])
    return c.select("curve_id", *[F.round(f"{n}.x", 6).alias(a) for n, a in (("top_left", "tl_x"), ("top_right", "tr_x"), ("bottom_right", "br_x"), ("bottom_left", "bl_x"))])


# --- jobs, exports --------------------------------------------------------------

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END"


def order_jobs(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("file_size"), F.col("o_orderdate").alias("created_at"))


@query(f"WITH j AS (SELECT o_orderkey AS job_id, {STATUS_SQL} AS status, o_orderdate AS created_at FROM orders) SELECT job_id, status, (SELECT count(*) FROM j WHERE status = 'completed') AS total FROM j WHERE status = 'completed' ORDER BY created_at DESC, job_id LIMIT 20")
def jobs_recent(spark, sf_dir):
    return jobs.recent(order_jobs(spark, sf_dir), 20, "completed").select("job_id", "status", "total")


@query(f"WITH j AS (SELECT {STATUS_SQL} AS status FROM orders) SELECT count(*) AS total, CAST(count_if(status = 'pending') AS BIGINT) AS pending, CAST(count_if(status = 'processing') AS BIGINT) AS processing, CAST(count_if(status = 'completed') AS BIGINT) AS completed, CAST(count_if(status = 'failed') AS BIGINT) AS failed FROM j")
def jobs_status_counts(spark, sf_dir):
    return jobs.status_counts(order_jobs(spark, sf_dir))


def order_states(orders: DataFrame) -> DataFrame:
    """Every order as a state of its customer's job."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return orders.select(F.col("o_custkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))


def _states(spark, sf_dir) -> DataFrame:
    return order_jobs(spark, sf_dir).select(F.col("owner").alias("job_id"), "status", F.col("created_at").alias("updated_at"), F.col("file_size"))


@query(f"WITH s AS (SELECT o_custkey AS job_id, {STATUS_SQL} AS status, o_orderdate AS updated_at FROM orders) SELECT job_id, arg_max(status, (updated_at, status)) AS status FROM s GROUP BY job_id")
def jobs_latest(spark, sf_dir):
    return jobs.latest(_states(spark, sf_dir)).select("job_id", "status")


@query(f"WITH s AS (SELECT o_custkey AS job_id, {STATUS_SQL} AS status, o_orderdate AS updated_at FROM orders) SELECT job_id, CASE WHEN job_id = (SELECT min(job_id) FROM s) THEN 'failed' ELSE arg_max(status, (updated_at, status)) END AS status, count(*) + CAST(job_id = (SELECT min(job_id) FROM s) AS BIGINT) AS states FROM s GROUP BY job_id")
def jobs_advanced(spark, sf_dir):
    """The states after the first job has failed."""
    s = _states(spark, sf_dir)
    moved = jobs.advance(s, s.agg(F.min("job_id")).scalar(), "failed")
    return jobs.latest(moved).join(moved.groupBy("job_id").agg(F.count(F.lit(1)).alias("states")), "job_id").select("job_id", "status", "states")


@query("SELECT DISTINCT o_custkey AS job_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def jobs_deleted(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("job_id"))
    return jobs.without(_states(spark, sf_dir), gone).select("job_id").distinct()


@query("SELECT o_orderkey AS job_id, date_diff('millisecond', o_orderdate, o_orderdate + to_milliseconds(o_custkey * 37)) AS elapsed_ms, left(CAST(o_orderkey AS VARCHAR), 8) AS short_id, round(o_totalprice / 1048576, 6) AS mb FROM orders")
def job_summaries(spark, sf_dir):
    j = order_jobs(spark, sf_dir)
    return j.select("job_id", jobs.elapsed_ms(F.col("created_at"), F.expr("timestampadd(MILLISECOND, cast(owner * 37 as int), created_at)")).alias("elapsed_ms"), T.short_id(F.col("job_id").cast("string")).alias("short_id"), F.round(T.megabytes(F.col("file_size")), 6).alias("mb"))


@query(f"WITH {O.PTS} SELECT curve_id, printf('%.3f', x) AS \"Strain (%)\", printf('%.3f', y) AS \"Stress (kN/m²)\", CASE WHEN idx % 7 = 0 THEN '' ELSE CAST(idx % 7 AS VARCHAR) END AS \"Pixel_X\", CAST(idx % 5 + 1 AS VARCHAR) AS \"Pixel_Y\" FROM pts")
def csv_export(spark, sf_dir):
    p = points(spark, sf_dir).select("curve_id", F.col("x").alias("strain"), F.col("y").alias("stress"), (F.col("idx") % 7).alias("pixel_x"), (F.col("idx") % 5 + 1).alias("pixel_y"))
    return sinks.csv_rows(p, pixels=True, decimals=3, key=["curve_id"])


@query(f"WITH {O.CV}, p AS (SELECT curve_id, row_number() OVER (PARTITION BY curve_id ORDER BY x) AS row_no, x, y FROM fp) SELECT curve_id, row_no, printf('%.3f', x) AS strain, printf('%.2f', y) AS stress FROM p WHERE row_no <= 100")
def result_page(spark, sf_dir):
    """The first hundred rows of each result, numbered from 1."""
    w = Window.partitionBy("curve_id").orderBy("x")
    p = C.dedup_first(points(spark, sf_dir)).withColumn("row_no", F.row_number().over(w)).where("row_no <= 100")
    return p.select("curve_id", F.col("row_no").cast("long").alias("row_no"), T.fixed(F.col("x"), 3).alias("strain"), T.fixed(F.col("y"), 2).alias("stress"))


@query(f"""WITH {O.FEATURES}, p AS (SELECT curve_id, x, y, row_number() OVER (PARTITION BY curve_id ORDER BY x) AS r FROM fp), h AS (SELECT curve_id, count(*) AS total_points, least(count(*), 10) AS shown, round(sum(round_even(x, 4)) FILTER (WHERE r <= 10), 3) AS strains, round(sum(round_even(y, 2)) FILTER (WHERE r <= 10), 2) AS stresses FROM p GROUP BY curve_id)
SELECT curve_id, total_points, shown, strains, stresses, round(peak_stress, 6) AS peak_stress, round(failure_strain, 6) AS failure_strain FROM h JOIN ft USING (curve_id)""")
def result_records(spark, sf_dir):
    """The JSON records of the curves, read back."""
    w = Window.partitionBy("curve_id").orderBy("x")
    p = C.dedup_first(points(spark, sf_dir)).select("curve_id", F.row_number().over(w).alias("idx"), F.col("x").alias("strain"), F.col("y").alias("stress"))
    f = features.analyze(event_curves(spark, sf_dir)).select("curve_id", "peak_stress", "failure_strain")
    j = F.from_json("json", "data_points array<struct<strain:double,stress:double>>, total_points long, features struct<peak_stress:double,failure_strain:double>")
    r = sinks.result_json(p, f).select("curve_id", j.alias("j"))
    shown = F.col("j.data_points")
    return r.select("curve_id", F.col("j.total_points").alias("total_points"), F.size(shown).cast("long").alias("shown"), F.round(A.total(shown["strain"]), 3).alias("strains"), F.round(A.total(shown["stress"]), 2).alias("stresses"), F.round("j.features.peak_stress", 6).alias("peak_stress"), F.round("j.features.failure_strain", 6).alias("failure_strain"))


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n, max(value) AS peak, min(value) AS low, arg_min(ts, (-value, ts)) AS peak_at FROM events GROUP BY ALL")
def window_curves(spark, sf_dir):
    """The streaming operator on a table: what all micro-batches together give."""
    from curvelab.streaming import arrivals

    return arrivals.window_features(table(spark, sf_dir, "events"))


@query(f"WITH {O.PTS} SELECT curve_id, CAST(round(x * 1000) AS BIGINT) AS strain, printf('%.2f', y) AS stress FROM pts")
def csv_files(spark, sf_dir):
    """CSV files with another separator, read back."""
    p = points(spark, sf_dir).select("curve_id", "idx", F.col("x").alias("strain"), F.col("y").alias("stress"))
    path = sinks.fresh(spark, "csv")
    sinks.write_csv(p.select("idx", F.format_string("%d:%d", F.col("curve_id"), F.round(F.col("strain") * 1000).cast("long")).alias("id"), "strain", "stress"), path, decimals=10, separator=";", key=["id"])
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    part = F.split("id", ":")
    return back.select(F.get(part, F.lit(0)).cast("long").alias("curve_id"), F.get(part, F.lit(1)).cast("long").alias("strain"), T.fixed(F.col(sinks.STRESS).cast("double"), 2).alias("stress"))


@query(f"""WITH {O.PTS} SELECT curve_id || '.csv' AS name, count(*) AS rows, md5('Strain (%);Stress (kN/m²)' || chr(13) || chr(10) || string_agg(printf('%.2f', x) || ';' || printf('%.2f', y) || chr(13) || chr(10), '' ORDER BY idx)) AS digest FROM pts GROUP BY curve_id""")
def job_files(spark, sf_dir):
    """A CSV file for every curve, read back: its name, its rows, and a digest of its bytes."""
    path = sinks.fresh(spark, "job-files")
    sinks.write_csv_files(points(spark, sf_dir).select("curve_id", "idx", F.col("x").alias("strain"), F.col("y").alias("stress")), path, "curve_id", decimals=2, separator=";")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    text = F.col("content").cast("string")
    return files.select(F.substring_index("path", "/", -1).alias("name"), (F.size(F.split(text, "\n")) - 2).cast("long").alias("rows"), F.md5("content").alias("digest"))


@query(f"WITH {O.PTS} SELECT CAST(curve_id AS VARCHAR) AS curve_id, count(*) AS n, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(sum(y), 4) AS y_sum FROM pts GROUP BY curve_id")
def json_points(spark, sf_dir):
    """Point lists written as JSON lines, read back by the source for them."""
    path = sinks.fresh(spark, "points")
    lists = points(spark, sf_dir).groupBy(F.col("curve_id").cast("string").alias("curve_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("x").alias("strain"), F.col("y").alias("stress")))).alias("points"))
    lists.write.json(path)
    return readers.points_json(spark, path).groupBy("curve_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("x_min"), F.round(F.max("x"), 6).alias("x_max"), F.round(F.sum("y"), 4).alias("y_sum"))


@query("SELECT o_orderkey AS job_id, replace('contour_tracing_' || lower(o_orderstatus), '_', ' ') AS method, strftime(o_orderdate, '%b %-d, %I:%M %p') AS shown, printf('%.6f%%', o_totalprice / 10000.0) AS share FROM orders")
def job_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), T.shown_method(F.concat(F.lit("contour_tracing_"), F.lower("o_orderstatus"))).alias("method"), T.shown_time(F.col("o_orderdate")).alias("shown"), T.percent(F.col("o_totalprice") / 1_000_000, 6).alias("share"))


@query("WITH c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda v: trim(v, ' ')), lambda v: v <> '') AS l FROM conversations) SELECT conv_id, turn, CAST(len(l) AS INTEGER) AS n, l[1] AS first_item, l[len(l)] AS last_item FROM c")
def comma_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.comma_list(F.col("text")).alias("l"))
    return c.select("conv_id", "turn", F.size("l").alias("n"), F.get("l", F.lit(0)).alias("first_item"), F.get("l", F.size("l") - 1).alias("last_item"))


@query(f"WITH {O.TOKENS}, d AS (SELECT DISTINCT tok FROM toks) SELECT tok, regexp_matches(tok, '^-?[0-9]+\\.?[0-9]*$') AS plain FROM d")
def plain_numbers(spark, sf_dir):
    return document_tokens(spark, sf_dir).select("tok").distinct().select("tok", T.is_plain_number(F.col("tok")).alias("plain"))


@query(f"WITH {O.CLEAN} SELECT tok, cleaned, CASE WHEN length(tok) >= 18 THEN 'A' WHEN length(tok) >= 16 THEN 'B' WHEN length(tok) >= 14 THEN 'C' WHEN length(tok) >= 12 THEN 'D' ELSE 'F' END AS grade FROM cleaned")
def sql_functions(spark, sf_dir):
    """The functions registered for SQL, over the distinct tokens."""
    register.register(spark)
    return document_tokens(spark, sf_dir).select("tok").distinct().selectExpr("tok", "clean_number(tok) AS cleaned", "grade(length(tok) / 20.0D) AS grade")


@query(f"""WITH {ROBUST} SELECT nation, 'robust' AS kind, CAST(inliers AS BIGINT) AS n, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM best WHERE rn = 1 UNION ALL
SELECT nation, 'weighted', count(*), round((sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)), 4), round((sum(w * y) - (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) * sum(w * x)) / sum(w), 4)
FROM (SELECT *, 1 + CAST(x AS BIGINT) % 3 AS w FROM t) GROUP BY nation HAVING count(DISTINCT x) > 1""")
def sql_lines(spark, sf_dir):
    """The aggregates registered for SQL, over the tick sets of nations."""
    register.register(spark)
    supplier_ticks(spark, sf_dir).createOrReplaceTempView("registered_ticks")
    return spark.sql("""SELECT nation, kind, CAST(f[0] AS BIGINT) AS n, round(f[1], 4) AS slope, round(f[2], 4) AS intercept FROM (
      SELECT nation, 'robust' AS kind, fit_robust(x, y, 5.0D) AS f FROM registered_ticks GROUP BY nation
      UNION ALL SELECT nation, 'weighted', fit_weighted(x, y, 1.0D + CAST(x AS BIGINT) % 3) FROM registered_ticks GROUP BY nation) WHERE f[1] IS NOT NULL""")


@query(ORACLE_SQL["critical_points"])
def sql_critical_points(spark, sf_dir):
    """The table function registered for SQL, over the curves."""
    register.register(spark)
    event_curves(spark, sf_dir).createOrReplaceTempView("registered_curves")
    return spark.sql("SELECT curve_id, point, round(strain, 6) AS strain, round(stress, 6) AS stress FROM registered_curves, LATERAL critical_points(xs, ys)")


@query("""WITH c AS (SELECT p_partkey AS k, 400 + p_size * 10 AS w, 300 + p_size * 7 AS h, 110 + p_partkey % 500 AS x, 60 + p_partkey % 300 AS y FROM part)
SELECT k, CAST(floor(w * 0.15) AS INTEGER) AS left_margin, CAST(h - floor(h * 0.15) AS INTEGER) AS origin_y, CAST(w - floor(w * 0.15) AS INTEGER) AS plot_width, round((x - 100) / 650.0 * 6, 6) AS strain, round((520 - y) / 470.0 * 5000, 6) AS stress FROM c""")
def plot_regions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = scale.box_mapping(110 + F.col("p_partkey") % 500, 60 + F.col("p_partkey") % 300, (100, 50, 750, 520), (0.0, 6.0), (0.0, 5000.0))
    r = scale.plot_region((400 + F.col("p_size") * 10).cast("int"), (300 + F.col("p_size") * 7).cast("int"))
    return p.select(F.col("p_partkey").alias("k"), r.alias("r"), F.round(x, 6).alias("strain"), F.round(y, 6).alias("stress")).select("k", F.col("r.x").alias("left_margin"), F.col("r.origin_y").cast("int").alias("origin_y"), F.col("r.width").cast("int").alias("plot_width"), "strain", "stress")


@query("""WITH r AS (SELECT p_partkey AS c, CAST(k AS INTEGER) AS idx, k * (5.5 / (19 + p_size)) AS x FROM part, range(70) b(k) WHERE k < 20 + p_size)
SELECT c AS curve_id, idx, round(x, 6) AS x, round(CASE WHEN x <= 2.5 THEN 4200 * pow(x / 2.5, 0.8) ELSE 4200 * (1 - 0.4 * pow((x - 2.5) / 3, 1.5)) END, 6) AS y FROM r""")
def synthetic_curves(spark, sf_dir):
    """A test curve for every part, of more points the larger the part is."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("curve_id"), (20 + F.col("p_size")).alias("points"))
    return readers.synthetic_points(p, noise=0.0).select("curve_id", "idx", *r6("x", "y"))


@query("""WITH f AS (SELECT s_suppkey AS k, CAST(4 + s_suppkey % 5 AS INTEGER) AS h, CAST(6 + s_suppkey % 3 AS INTEGER) AS w, s_suppkey % 10 = 3 AS broken, s_suppkey % 10 = 7 AS other FROM supplier)
SELECT k || CASE WHEN other THEN '.txt' ELSE '.png' END AS name, CASE WHEN broken OR other THEN 'failed' ELSE 'completed' END AS status, CASE WHEN NOT broken AND NOT other THEN h END AS height, CASE WHEN NOT broken AND NOT other THEN w END AS width,
  CASE WHEN NOT broken AND NOT other THEN round((SELECT avg((k * 7 + x) % 256) FROM range(w) r(x)), 6) END AS brightness, broken OR other AS has_error, NOT other AS accepted FROM f""")
def image_files(spark, sf_dir):
    """Image files written, and read back: some are broken, some of another type; what cannot be decoded is a row with its reason."""
    k = F.col("s_suppkey")
    h, w = (4 + k % 5).cast("int"), (6 + k % 3).cast("int")
    value = lambda i: F.lpad(F.hex((k * 7 + F.floor(i / 3) % w) % 256), 2, "0")
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), h * w * 3 - 1), value), ""))
    suppliers = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism)  # a small file is one split, and each row a file to write
    drawn = suppliers.select(k.alias("image_id"), h.alias("height"), w.alias("width"), F.lit(3).alias("channels"), pixels.alias("data"))
    name = F.concat(F.col("image_id").cast("string"), F.when(F.col("image_id") % 10 == 7, ".txt").otherwise(".png"))
    path = sinks.fresh(spark, "image-files")
    sinks.write_binary(images.png(drawn).select(name.alias("name"), F.when(F.col("image_id") % 10 == 3, F.lit(b"no image")).otherwise(F.col("content")).alias("content")), path)
    seen = sinks.stored(readers.images(spark, path), "images-read")  # files are opened once
    levels = images.gray_pixels(seen.where("status = 'completed'")).groupBy(F.col("image_id").alias("i")).agg(F.round(F.avg("v"), 6).alias("brightness"))
    errors = images.quality(seen).select(F.col("image_id").alias("e"), F.col("error").isNotNull().alias("has_error"))
    short = lambda c: F.substring_index(c, "/", -1)
    taken = readers.uploads(spark, path).where("length > 0").select(short(F.col("path")).alias("u"))
    out = seen.join(levels, F.col("image_id") == F.col("i"), "left").join(errors, F.col("image_id") == F.col("e")).withColumn("name", short(F.col("image_id")))
    return out.join(taken, F.col("name") == F.col("u"), "left").select("name", "status", "height", "width", "brightness", "has_error", F.col("u").isNotNull().alias("accepted"))


# --- the main query -------------------------------------------------------------

CHART_H, CHART_W, TICK = 200, 260, 30


def charts(spark, sf_dir) -> DataFrame:
    """Charts drawn, and read back to records: one curve each, with two to five ticks below and three at the left; some are blank and go to the network, some cannot be decoded."""
    i = F.col("vec_id")
    left, bottom = int(CHART_W * scale.MARGIN), CHART_H - int(CHART_H * scale.MARGIN)
    e = table(spark, sf_dir, "embeddings").select(i.alias("image_id"), (i % 6).cast("int").alias("a"), (i % 5).cast("int").alias("b"), (2 + i % 4).cast("int").alias("n"), (i % 11 == 5).alias("broken"), (i % 7 == 3).alias("blank")).repartition(4 * spark.sparkContext.defaultParallelism)  # so that no core waits long for another
    ys = F.transform(F.sequence(F.lit(0), F.lit(CHART_W - left - 21)), lambda x: bottom - 15 - F.round((60 + 10 * F.col("b")) * (1 - F.pow((x / (CHART_W - left - 21) - 0.5 - F.col("a") * 0.05) / 0.75, F.lit(2.0)))).cast("int") + F.when(F.col("blank"), 10_000).otherwise(0))
    drawn = images.drawn(e.select("image_id", ys.alias("ys")), CHART_H, CHART_W, left).withColumn("data", F.when(F.col("image_id") % 11 == 5, F.substring("data", 1, 100)).otherwise(F.col("data")))
    token = lambda axis, text, at: F.struct(F.lit(axis).alias("axis"), text.alias("text"), F.lit(90.0).alias("conf"), (at if axis == "x" else F.lit(0)).cast("int").alias("left"), (at if axis == "y" else F.lit(0)).cast("int").alias("top"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(1.0).alias("scale"), F.lit(0).alias("offset_x"), F.lit(0).alias("offset_y"))
    xs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: token("x", F.format_string("%.1f", k * (1 + F.col("a")) / 10.0), left + TICK * k))
    yt = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: token("y", (100 * k * (1 + F.col("b"))).cast("string"), bottom - TICK * k))
    labels = F.struct(F.when(F.col("a") < 3, "Strain (%)").otherwise("Strain [mm]").alias("x_text"), F.lit("Stress").alias("y_text"))
    return extraction.extract(drawn, rectify=False, tokens=e.select("image_id", F.concat(xs, yt).alias("tokens"), labels.alias("labels")))


@query(f"""WITH c AS (SELECT vec_id AS image_id, vec_id % 6 AS a, vec_id % 5 AS b, 2 + vec_id % 4 AS n, vec_id % 11 = 5 AS broken, vec_id % 7 = 3 AS blank FROM embeddings)
SELECT image_id, CASE WHEN broken THEN 'failed' ELSE 'completed' END AS status, CASE WHEN broken THEN NULL WHEN blank THEN 'unet_primary' ELSE 'contour_tracing' END AS method, CASE WHEN NOT broken THEN 'calibrated' END AS units,
  CASE WHEN NOT broken THEN CAST(n AS INTEGER) END AS x_count, CASE WHEN NOT broken THEN 3 END AS y_count, CASE WHEN NOT broken THEN round((1 + a) / 10.0 / {TICK}, 6) END AS x_scale, CASE WHEN NOT broken THEN round(100.0 * (1 + b) / {TICK}, 6) END AS y_scale,
  CASE WHEN NOT broken THEN round((n - 1) * (1 + a) / 10.0, 6) END AS x_max, CASE WHEN NOT broken THEN 'Strain' END AS x_label, CASE WHEN broken THEN NULL WHEN a < 3 THEN '%' ELSE 'mm' END AS x_unit, CASE WHEN NOT broken THEN 'kN/m²' END AS y_unit,
  CASE WHEN NOT broken AND NOT blank THEN CAST(95 - 10 * b AS DOUBLE) END AS top_row, CASE WHEN NOT broken AND NOT blank THEN true END AS peak_found, CASE WHEN NOT broken THEN CASE WHEN blank THEN 0 ELSE 200 END END AS points, broken AS has_error FROM c""")
def extract_charts(spark, sf_dir):
    """What the records of the charts say."""
    r = charts(spark, sf_dir)
    at = lambda c: F.round(c, 6)
    rows = F.transform("data_points", lambda p: p["pixel_y"])
    return r.select(F.col("image_id").cast("long").alias("image_id"), "status", F.col("extraction_method").alias("method"), "units", F.col("x_axis.tick_count").alias("x_count"), F.col("y_axis.tick_count").alias("y_count"), at("scale.x_scale").alias("x_scale"), at("scale.y_scale").alias("y_scale"), at("x_axis.max_value").alias("x_max"), F.col("x_axis.label").alias("x_label"), F.col("x_axis.unit").alias("x_unit"), F.col("y_axis.unit").alias("y_unit"),
                    (F.round((F.array_min(rows) + 5) / 10) * 10 - 5).alias("top_row"), (F.abs(F.col("features.peak_stress") / ((15 + 60 + 10 * (F.col("image_id").cast("long") % 5)) * F.col("scale.y_scale")) - 1) < 0.07).alias("peak_found"), (F.round(F.size("data_points") / 50) * 50).cast("int").alias("points"), F.col("error").isNotNull().alias("has_error"))


@query(f"""WITH c AS (SELECT vec_id AS image_id, vec_id % 6 AS a, vec_id % 5 AS b, 2 + vec_id % 4 AS n, vec_id % 11 = 5 AS broken, vec_id % 7 = 3 AS blank FROM embeddings)
SELECT image_id, CASE WHEN broken THEN 'failed' ELSE 'completed' END AS status, CASE WHEN NOT broken THEN round((n - 1) * (1 + a) / 10.0, 6) END AS x_max, CASE WHEN NOT broken THEN 'Strain' END AS x_label, CASE WHEN NOT broken THEN CAST(200 * (1 + b) AS DOUBLE) END AS y_min,
  NOT broken AND NOT blank AS has_features, NOT broken AS has_grade, CASE WHEN broken OR blank THEN 0 ELSE 3 END AS points_shown FROM c""")
def chart_records(spark, sf_dir):
    """The same records as JSON, with axes and confidence, read back."""
    j = sinks.chart_json(charts(spark, sf_dir), 3)
    of = lambda path: F.get_json_object("json", f"$.{path}")
    return j.select(of("image_id").cast("long").alias("image_id"), of("status").alias("status"), F.round(of("x_axis.max_value").cast("double"), 6).alias("x_max"), of("x_axis.label").alias("x_label"), of("y_axis.min_value").cast("double").alias("y_min"),
                    of("features.peak_stress").isNotNull().alias("has_features"), of("confidence.grade").isNotNull().alias("has_grade"), F.coalesce(F.json_array_length(of("data_points")), F.lit(0)).alias("points_shown"))


# --- streaming ----------------------------------------------------------------


@query(ORACLE_SQL["peak_features"])
def stream_curves(spark, sf_dir):
    """The features of events that arrive as files, taken in by one run over all that is available."""
    from curvelab.streaming import arrivals

    base = sinks.fresh(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    arrivals.run_available(stream, arrivals.batch_sink(f"{base}/events"), f"{base}/state")
    curves = C.from_points(readers.event_points(arrivals.committed(spark, f"{base}/events", schema)))
    return features.analyze(curves).select("curve_id", *r6(*FEATURES), "post_peak", "peak_index")


def _job_changes(spark, sf_dir, limit: int) -> DataFrame:
    """The newest states of jobs whose events arrive as files, with time-outs after so many seconds."""
    from curvelab.streaming import arrivals, lifecycle

    base = sinks.fresh(spark, "jobs")
    stream = spark.readStream.schema(table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders*.parquet").parquet(sf_dir)
    changes = lifecycle.newest(order_states(stream), limit)
    arrivals.run_available(changes, arrivals.batch_sink(f"{base}/changes"), f"{base}/state", "update")
    return jobs.latest(arrivals.committed(spark, f"{base}/changes", changes.schema))


@query(ORACLE_SQL["jobs_latest"])
def stream_jobs(spark, sf_dir):
    """The newest state of every job, kept by key while its events arrive."""
    return _job_changes(spark, sf_dir, 10**9).select("job_id", "status")


@query(f"""WITH s AS (SELECT o_custkey AS job_id, {STATUS_SQL} AS status, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders), j AS (SELECT job_id, arg_max(status, (t, status)) AS status, max(t) AS t FROM s GROUP BY job_id),
e AS (SELECT *, status IN ('pending', 'processing') AND t + INTERVAL 30 DAY < (SELECT max(t) FROM s) AS late FROM j)
SELECT job_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CAST(CASE WHEN late THEN t + INTERVAL 30 DAY ELSE t END AS DATE) AS since, CASE WHEN late THEN 'timed out' END AS error_message FROM e""")
def stream_job_timeouts(spark, sf_dir):
    """The same with jobs that fail thirty days after their last open state."""
    return _job_changes(spark, sf_dir, 30 * 86400).select("job_id", "status", F.col("updated_at").cast("date").alias("since"), "error_message")
