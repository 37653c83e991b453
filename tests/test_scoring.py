"""Scoring, validation, text, scales, routing, jobs and exports."""

import math

import pytest
from pyspark.sql import functions as F

from curvelab import config
from curvelab.functions import text as T
from curvelab.functions.register import register
from curvelab.operators import jobs, merge, scale, scoring, validation
from curvelab.operators import curves as C
from curvelab.sources import readers, sinks

SCORE = "curve_id string, xs array<double>, ys array<double>, ocr array<double>, x_ticks int, y_ticks int, quality double, method string, nmae double"


def test_reports(spark):
    rows = [
        ("high", [0.1 * i for i in range(50)], [100.0 * i for i in range(50)], [0.9, 0.85, 0.92, 0.88], 5, 5, 0.85, "contour_tracing", None),
        ("low", [float(i) for i in range(10)], [10.0 * i + (37 * i) % 90 - 45 for i in range(10)], [0.3, 0.4], 1, 1, 0.3, "extraction_failed", None),
        ("none", [], [], [], 0, 0, 0.0, "x", None),
        ("same", [1.0, 1.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0], [0.9], 5, 5, 0.9, "hybrid", None),
        ("truth", [0.1 * i for i in range(50)], [100.0 * i for i in range(50)], [0.9], 5, 5, 0.85, "hybrid", 0.3),
    ]
    df = spark.createDataFrame(rows, SCORE)
    got = {r.curve_id: r for r in scoring.scored(df).collect()}
    h = got["high"]
    assert (h.curve_smoothness, h.ocr_confidence, h.data_validity) == (pytest.approx(1.0), pytest.approx(0.8875), pytest.approx(1.0))
    assert h.overall == pytest.approx(0.945) and h.grade == "A" and len(h.warnings) == 1 and h.recommendations == []
    assert got["low"].overall < 0.7 and got["low"].grade in "DF" and len(got["low"].warnings) >= 5 and len(got["low"].recommendations) >= 4
    assert got["none"].grade == "F" and got["none"].curve_smoothness == 0 and got["none"].data_validity == 0
    assert got["same"].overall is None and got["same"].status == "failed" and got["same"].grade is None
    assert got["truth"].data_validity == pytest.approx(0.7)
    strict = {r.curve_id: r.overall for r in scoring.scored(df, strict=True).collect()}
    assert strict["high"] == pytest.approx(0.945) and strict["low"] == pytest.approx(0.8 * got["low"].overall)
    advice = scoring.suggestions(scoring.scored(df)).where("curve_id = 'low'").collect()
    assert {a.factor for a in advice} >= {"ocr_confidence", "axis_detection", "image_quality"}


def test_grades_and_methods(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (0.75,), (0.6,), (0.1,), (math.nan,), (None,)], "s double")
    assert [r.g for r in df.select(scoring.grade(F.col("s")).alias("g")).collect()] == ["A", "B", "C", "D", "F", None, None]
    m = spark.createDataFrame([("unet_fallback",), ("contour_tracing_failed",), ("extraction_failed",)], "m string")
    assert [r.v for r in m.select(scoring.method_score(F.col("m")).alias("v")).collect()] == [0.75, 0.5, 0.0]


def test_validation(spark):
    rows = [("same", [0.0, 1, 2, 3], [0.0, 5, 8, 2], [0.0, 1, 2, 3], [0.0, 5, 8, 2]), ("off", [0.0, 1, 2], [0.0, 10, 0], [0.0, 1, 2], [1.0, 11, 1]), ("apart", [0.0, 1], [1.0, 2], [5.0, 6], [1.0, 2]), ("zero", [0.0, 1], [0.0, 0], [0.0, 1], [1.0, 1])]
    rows = [(r[0], *([float(v) for v in a] for a in r[1:])) for r in rows]
    pairs = spark.createDataFrame(rows, "pair_id string, gt_x array<double>, gt_y array<double>, ex_x array<double>, ex_y array<double>")
    got = {r.pair_id: r for r in validation.validate(pairs).collect()}
    assert got["same"].accuracy_score == 1 and got["same"].passed and got["same"].r_squared == 1 and got["same"].within_5_percent == 1
    assert got["off"].mae == pytest.approx(1) and got["off"].accuracy_score == pytest.approx(0.9) and not got["off"].passed and got["off"].peak_stress_error == 1
    assert got["apart"].status == "no_overlap" and got["apart"].accuracy_score is None and not got["apart"].passed
    assert got["zero"].accuracy_score == 0
    n = {r.pair_id: r.nmae for r in validation.normalized_mae(pairs).collect()}
    assert n["same"] == 0 and n["off"] == pytest.approx(0.1) and n["apart"] == 1 and n["zero"] == 1


TOKENS = {"O.5": 0.5, "1,5": 1.5, "1.2.3": 1.23, "--5": -5.0, "1-2": None, "5.": 5.0, "": None, "-": None, "lO0": 100.0, "S|B": 518.0, "1-2-": 12.0, "abc": None, " Z ": 2.0, "g.G": 9.6}


def test_numbers(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "t string")
    assert {r.t: r.v for r in df.select("t", T.parse_number(F.col("t")).alias("v")).collect()} == TOKENS


def test_labels(spark):
    want = {"Strain (%)": ("Strain", "%"), "Stress [kPa] x": ("Stress", "kPa"), "Stress kN/m²": ("Stress", "kN/m²"), "kN/m2": (None, "kN/m2"), "E MPa": ("E", "MPa"), "a % b": ("a", "%"), "len mm": ("len", "mm"), "plain": ("plain", None), "": (None, None)}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: (r.a.label, r.a.unit) for r in df.select("t", T.axis_label(F.col("t")).alias("a")).collect()} == want


def test_scales(spark):
    rows = [("c", "x", p, v, 0.9, "") for p, v in ((100, 0.0), (200, 2.0), (300, 4.0))] + [("c", "y", p, v, 0.9, "") for p, v in ((500, 0.0), (400, 100.0), (300, 200.0))]
    rows += [("out", "x", p, float(p), 0.9, "") for p in range(0, 60, 10)] + [("out", "x", 70, 900.0, 0.9, "")] + [("out", "y", 0, 10.0, 0.9, ""), ("out", "y", 10, 0.0, 0.9, "")] + [("one", "x", 5, 1.0, 0.9, "")]
    t = spark.createDataFrame(rows, "chart_id string, axis string, pixel_position int, value double, confidence double, raw_text string")
    origins = spark.createDataFrame([("c", 100, 500), ("out", 0, 10), ("one", 0, 0)], "chart_id string, origin_x int, origin_y int")
    got = {r.chart_id: r for r in scale.scale_factors(t, origins).collect()}
    c = got["c"]
    assert c.is_valid and (c.x_scale, c.x_offset, c.y_scale, c.y_offset, c.x_r2) == (pytest.approx(0.02), pytest.approx(0, abs=1e-9), pytest.approx(1), pytest.approx(0, abs=1e-9), pytest.approx(1))
    assert got["out"].is_valid and got["out"].x_scale == pytest.approx(1) and got["out"].y_scale == pytest.approx(1)
    assert not got["one"].is_valid and (got["one"].x_scale, got["one"].x_offset) == (1, 0)
    px = spark.createDataFrame([("c", 0, 150, 450), ("one", 0, 7, 8), ("lost", 0, 1, 2)], "chart_id string, idx int, px int, py int")
    m = {r.chart_id: r for r in scale.map_units(px, scale.scale_factors(t, origins)).collect()}
    assert (m["c"].strain, m["c"].stress, m["c"].units) == (pytest.approx(1), pytest.approx(50), "calibrated")
    assert (m["one"].strain, m["one"].stress, m["one"].units) == (7, 8, "pixel") and m["lost"].units == "pixel"


def test_ticks(spark):
    rows = [("c", "x", "1O", 80.0, 10, 5, 9, 4), ("c", "y", "2", 49.0, 0, 0, 1, 1), ("c", "y", " ", 99.0, 0, 0, 1, 1), ("c", "y", "ab", 99.0, 0, 0, 1, 1), ("c", "y", "7", 50.0, 3, 20, 5, 9), ("c", "y", "7", -1.0, 3, 20, 5, 9)]
    t = spark.createDataFrame(rows, "chart_id string, axis string, text string, conf double, left int, top int, width int, height int")
    assert sorted((r.axis, r.pixel_position, r.value) for r in scale.ticks(t).collect()) == [("x", 14, 10.0), ("y", 24, 7.0)]
    image = t.withColumn("scale", F.lit(2)).withColumn("offset_x", F.lit(100)).withColumn("offset_y", F.lit(50))
    assert sorted(r.pixel_position for r in scale.ticks(image, frame="image").collect()) == [62, 107]
    a = {r.axis: r for r in scale.axes(scale.ticks(t)).collect()}
    assert a["x"].tick_count == 1 and not a["x"].is_valid


def test_merge_and_routes(spark):
    a = spark.createDataFrame([("c", 1, 10), ("c", 2, 20), ("d", 1, 7)], "curve_id string, x int, y int")
    b = spark.createDataFrame([("c", 2, 31), ("c", 3, 5), ("d", 1, 99), ("d", 2, 1)], "curve_id string, x int, y int")
    w = spark.createDataFrame([("c", 0.75, 0.25), ("d", 0.0, 0.0)], "curve_id string, conf_a double, conf_b double")
    assert {tuple(r) for r in merge.merge_weighted(a, b, w).collect()} == {("c", 1, 10), ("c", 2, 22), ("c", 3, 5), ("d", 1, 7)}
    best = lambda *v: spark.range(1).select(merge.best_method(*map(F.lit, v)).alias("m")).first().m.method
    assert best(0.5, 9, 0.5, 9) == "contour_tracing" and best(0.5, 0, 0.1, 9) == "unet_segmentation" and best(0.0, 9, 0.9, 0) == "extraction_failed"
    go = lambda q, c, u, **k: spark.range(1).select(merge.route(F.lit(q), F.lit(c), F.lit(5), F.lit(u), F.lit(5), **k).alias("m")).first().m.method
    assert [go(0.7, 0.7, 0.1), go(0.7, 0.6, 0.1), go(0.6, 0.9, 0.1), go(0.6, 0.9, 0.1, both=True), go(0.1, 0.9, 0.1, method="contour")] == ["contour_tracing", "unet_fallback", "unet_primary", "contour_tracing", "contour_tracing"]
    with pytest.raises(ValueError):
        go(0.1, 0.1, 0.1, method="other")


def test_jobs(spark):
    e = spark.createDataFrame([("a", "pending", 1), ("a", "completed", 3), ("b", "failed", 2), ("c", "pending", 5)], "job_id string, status string, t int").select("job_id", "status", F.timestamp_seconds("t").alias("updated_at"), F.timestamp_seconds("t").alias("created_at"))
    assert {r.job_id: r.status for r in jobs.latest(e).collect()} == {"a": "completed", "b": "failed", "c": "pending"}
    assert [(r.job_id, r.total) for r in jobs.recent(jobs.latest(e), 2).collect()] == [("c", 3), ("a", 3)]
    assert {r.job_id for r in jobs.without(jobs.latest(e), spark.createDataFrame([("a",)], "job_id string")).collect()} == {"b", "c"}
    assert jobs.latest(jobs.advance(e, "c", "processing")).where("job_id = 'c'").first().status == "processing"
    for bad in (lambda: jobs.recent(e, 0), lambda: jobs.recent(e, 101), lambda: jobs.recent(e, 5, "x"), lambda: jobs.advance(e, "a", "x")):
        with pytest.raises(ValueError):
            bad()


def test_exports_and_sources(spark, tmp_path):
    p = spark.createDataFrame([("c", 0, 0.5, 1.25, 0, 7), ("c", 1, 1.0, 2.0, 3, 0)], "curve_id string, idx int, strain double, stress double, pixel_x int, pixel_y int")
    sinks.write_csv(p.coalesce(1), f"file://{tmp_path}/csv", pixels=True, decimals=2)
    (out,) = (tmp_path / "csv").glob("*.csv")
    assert out.read_bytes().decode() == "Strain (%),Stress (kN/m²),Pixel_X,Pixel_Y\r\n0.50,1.25,\"\",7\r\n1.00,2.00,3,\"\"\r\n"
    with pytest.raises(ValueError):
        sinks.csv_rows(p, decimals=11)
    f = spark.createDataFrame([("c", 2.0)], "curve_id string, peak_stress double")
    assert '"total_points":2' in sinks.result_json(p, f).first().json
    (tmp_path / "in.json").write_text('{"curve_id": "a", "points": [{"strain": 1.0, "stress": 2.0}, {"strain": 2.0, "stress": 3.0, "pixel_x": 4}]}\n')
    assert [(r.idx, r.x, r.y, r.pixel_x) for r in readers.points_json(spark, f"file://{tmp_path}/in.json").collect()] == [(0, 1.0, 2.0, None), (1, 2.0, 3.0, 4)]
    s = C.from_points(readers.synthetic_curves(spark, 2, noise=0.0)).first()
    assert len(s.xs) == 200 and max(s.ys) == pytest.approx(4200, rel=1e-2)


def test_settings_and_sql_functions(spark, tmp_path):
    (tmp_path / ".env").write_text("DEBUG=true\n# no\nmodel_path='m.h5'\n")
    s = config.load({"Smoothing_Window": "21"}, str(tmp_path / ".env"))
    assert (s.debug, s.model_path, s.smoothing_window) == (True, "m.h5", 21)
    register(spark)
    assert spark.sql("SELECT grade(0.85) AS g, clean_number('1,S.2') AS c, clean_number('--5') AS d").first() == ("B", "1.52", "-5")
    rows = spark.sql("SELECT * FROM critical_points(array(0D, 1D, 2D), array(0D, 5D, 10D))").collect()
    assert [(r.point, r.strain) for r in rows] == [("Peak", 2.0), ("50% Peak", 1.0)]
