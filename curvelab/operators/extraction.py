"""The main query: chart images to result records.

One pass over the images makes what needs pixels (levelled image, mask, traced and
smoothed curve, tokens that a recogniser reads beside the axes); it is written, so that
an image is processed and its regions are read once. All else is expressions over
one row an image: ticks, scales, units, features, confidence, record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab import config
from curvelab.functions import arrays as A
from curvelab.functions import pixels as P
from curvelab.functions import text as T
from curvelab.operators import curves as C
from curvelab.operators import features, images, merge, scale, scoring
from curvelab.sources import sinks

# fixed values
X_UNIT, Y_UNIT = "%", "kN/m²"
TOKEN = "struct<axis:string,text:string,conf:double,left:int,top:int,width:int,height:int,scale:double,offset_x:int,offset_y:int>"
POINT = "struct<px:int,py:int>"
SEEN = f"image_id string, width int, height int, angle double, quality double, noise double, points array<{POINT}>, smoothed array<{POINT}>, contour double, network array<{POINT}>, network_conf double, tokens array<{TOKEN}>, x_text string, y_text string, error string"

_STRUCTS = {s: pa.struct([(n, images._KINDS[k]) for n, k in (f.split(":") for f in s[7:-1].split(","))]) for s in (TOKEN, POINT)}
#: The columns' Arrow types.
_SEEN = {n: pa.list_(_STRUCTS[k[6:-1]]) if k.startswith("array") else images._KINDS[k] for n, k in (f.split() for f in SEEN.split(", "))}
#: Images whose rows leave a task together.
SEEN_AT_ONCE = 256

#: Reads (text, conf, left, top, width, height) tokens of an image; kind is x, y, x_label or y_label.
Reader = Callable[[np.ndarray, str], list[tuple]]


def axis_regions(image: np.ndarray, margin: float = scale.MARGIN) -> dict[str, tuple[np.ndarray, int, int]]:
    """What lies below and left of the plot: {kind: (part, its left, its top)} for ticks and labels of both axes."""
    h, w = image.shape[:2]
    mx, my = int(w * margin), int(h * margin)
    return {
        "x": (image[h - my :, mx:], mx, h - my), "y": (image[: h - my, :mx], 0, 0),
        "x_label": (image[h - my // 2 :, :], 0, h - my // 2), "y_label": (image[:, : mx // 2], 0, 0),
    }


def read_axes(image: np.ndarray, reader: Reader | None) -> tuple[list[dict], str, str]:
    """(tick tokens of both axes, text of the x label, text of the y label); a region that cannot be read is empty."""
    tokens, labels = [], {"x_label": "", "y_label": ""}
    for kind, (part, left, top) in axis_regions(image).items() if reader else ():
        if not part.size:
            continue
        ready = P.for_reading(part)
        try:
            found = reader(ready, kind)
        except Exception:  # a recogniser's failure leaves the region empty
            continue
        if kind in labels:
            labels[kind] = " ".join(str(t[0]) for t in found)
        else:
            names = ("text", "conf", "left", "top", "width", "height")
            tokens += [{"axis": kind, **dict(zip(names, t, strict=True)), "scale": float(ready.shape[0] / part.shape[0]), "offset_x": left, "offset_y": top} for t in found]
    return tokens, labels["x_label"], labels["y_label"]


def contour_confidence(points: list[tuple[int, int]], smoothed: list[tuple[int, int]], width: int) -> float:
    """Density, closeness to the smoothed curve, coverage of the width, few jumps; 0 for fewer than five points."""
    if len(points) < 5:
        return 0.0
    x, y = np.array(points, float).T
    span = float(np.ptp(x))
    close = max(0.0, 1 - float(np.abs(y - np.array(smoothed, float)[:, 1]).mean()) / 50) if len(points) == len(smoothed) else 0.5
    jumps = int((np.diff(y) > 10).sum())
    return 0.25 * min(10 * len(x) / max(span, 1), 1) + 0.30 * close + 0.25 * min(2 * span / width, 1) + 0.20 * max(0.0, 1 - jumps / len(x))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow column; lists of (x, y) as one run of numbers."""
    if kind != _SEEN["points"]:
        return pa.array(values, kind, from_pandas=True)
    ends = np.cumsum([0, *(len(v or ()) for v in values)]).astype(np.int32)
    x, y = np.array([p for v in values for p in v or ()], np.int32).reshape(-1, 2).T
    flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x, y)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), flat, type=kind, mask=pa.array([v is None for v in values]))


TRACES = ("columns", "outline")


def digitised(df: DataFrame, reader: Reader | None = None, segment: Callable[[np.ndarray], np.ndarray] | None = None, rectify: bool = True, trace: str = "columns", refine: bool = False) -> DataFrame:
    """A row per image (image_id, height, width, channels, data) with all that needs its pixels; a failure is a row with its reason.

    trace: ``columns`` takes the middle of the curve in every column, ``outline`` the points that its simplified outline needs. With ``refine``
    traced points move to the darkest pixel near them before they are smoothed.
    """
    if trace not in TRACES:
        raise ValueError(f"trace is one of {', '.join(TRACES)}")

    def one(a: np.ndarray) -> tuple:
        level, angle = P.rectified(a) if rectify else (a, 0.0)
        mask, noise = P.filtered(level)
        region = axis_regions(level)
        mx, top = region["x"][1:]
        mask = mask[:top, mx:]  # the plot region
        points = [(x + mx, y) for x, y in (P.traced(mask) if trace == "columns" else P.traced_outline(mask)[0])]
        if refine:
            points = P.refined(P.gray(level), points)
        smoothed = P.smoothed_curve(points)
        network, network_conf = [], 0.0
        if segment is not None:
            p = segment(level)
            network = P.traced(P.thinned(np.where(p > 0.5, 255, 0).astype(np.uint8)))
            network_conf = float(np.mean([p[y, x] for x, y in network])) if network else 0.0
        tokens, x_text, y_text = read_axes(level, reader)
        return (level.shape[1], level.shape[0], float(angle), float(P.quality(level)["overall"]), float(noise), points, smoothed,
                float(contour_confidence(points, smoothed, level.shape[1])), network, network_conf, tokens, x_text, y_text, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(images.ARENA, np.uint8)
        for b in batches:
            ids, found = [str(i) for i in b.column(0).to_pylist()], []
            for n, image in enumerate(images._images(b), 1):
                try:
                    found.append(one(images._shaped(*image)))
                except Exception as e:  # one bad image is a row, not a lost task
                    found.append((*[None] * (len(_SEEN) - 2), f"{type(e).__name__}: {e}"))
                if len(found) == SEEN_AT_ONCE or n == len(ids):
                    columns = [ids[n - len(found) : n], *map(list, zip(*found, strict=True))]
                    yield pa.record_batch([_column(c, t) for c, t in zip(columns, _SEEN.values(), strict=True)], names=list(_SEEN))
                    found = []

    return df.select("image_id", "height", "width", "channels", "data").mapInArrow(run, SEEN)


def _ticks(tokens: Column, axis: str, frame: str, min_confidence: float) -> Column:
    """The axis' numbers as an array of (x place, y value, w confidence), by place."""
    near, size, off = ("left", "width", "offset_x") if axis == "x" else ("top", "height", "offset_y")
    at = lambda t: t[near] + F.floor(t[size] / 2)
    place = (lambda t: at(t) / t["scale"] + t[off]) if frame == "image" else at
    kept = F.filter(tokens, lambda t: (t["axis"] == axis) & (F.trim(t["text"]) != "") & (t["conf"] / 100 >= min_confidence))
    read = F.transform(kept, lambda t: F.struct(F.floor(place(t)).cast("double").alias("x"), T.parse_number(t["text"]).alias("y"), (t["conf"] / 100).alias("w")))
    return F.array_sort(F.filter(read, lambda t: t["y"].isNotNull()))


def _axis(ticks: Column, text: Column, unit: str) -> Column:
    label = T.axis_label(text)
    value = lambda i: F.get(ticks, i)["y"]
    shown = F.when(F.coalesce(label["unit"], F.lit("")) != "", label["unit"]).otherwise(F.lit(unit))
    return F.struct(label["label"].alias("label"), shown.alias("unit"), value(F.lit(0)).alias("min_value"), value(F.size(ticks) - 1).alias("max_value"), F.size(ticks).alias("tick_count"))


def extract(
    df: DataFrame, reader: Reader | None = None, segment: Callable[[np.ndarray], np.ndarray] | None = None, method: str = "auto", apply_smoothing: bool = True,
    smoothing_window: int | None = None, frame: str = "reference", min_confidence: float = scale.MIN_CONFIDENCE, rectify: bool = True, tokens: DataFrame | None = None, strict: bool = False, trace: str = "columns", refine: bool = False,
) -> DataFrame:
    """A result record per image: (image_id, status, data_points, features, critical_points, confidence, x_axis, y_axis,
    extraction_method, units, angle, error).

    ``reader`` recognises text, or ``tokens`` (image_id, tokens[, labels (x_text, y_text)]) has it recognised already; ``segment`` maps an image to
    probabilities. Without either the axes stay uncalibrated (points are pixels), and no network is asked. frame ``image``
    sets tick places back into the image's frame; ``reference`` leaves them as they were recognised. An image that cannot be
    processed has status failed, null results and its reason. trace and refine are those of ``digitised``; refined contours are of the method
    ``contour_tracing_refined``. The images are processed when this is called, once; what is returned reads what they gave. The smoothed curve's places are whole pixels; of equal ones the
    first is analysed and scored, where a slope between them would be undefined.
    """
    if frame not in ("reference", "image"):
        raise ValueError("frame is reference or image")
    window = features.window_for(apply_smoothing, smoothing_window or config.settings().smoothing_window)
    seen = sinks.stored(digitised(df, reader, segment, rectify, trace, refine), "digitised")  # every image is processed here, once
    good = seen.where("error is null").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")  # by number: rows are few and their analysis is long
    if tokens is not None:
        has = "labels" in tokens.columns
        labels = [F.col(f"labels.{c}").alias(c) if has else F.lit("").alias(c) for c in ("x_text", "y_text")]
        given = tokens.select(F.col("image_id").cast("string").alias("image_id"), F.col("tokens").cast(f"array<{TOKEN}>").alias("tokens"), *labels)
        good = good.drop("tokens", "x_text", "y_text").join(given, "image_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast(f"array<{TOKEN}>")))
    routed = merge.route(F.col("quality"), F.col("contour"), F.size("points"), F.col("network_conf"), F.size("network"), method=method)
    mx, my = F.floor(F.col("width") * scale.MARGIN), F.floor(F.col("height") * scale.MARGIN)
    made = A.settled(good, m=routed, x_ticks=_ticks(F.col("tokens"), "x", frame, min_confidence), y_ticks=_ticks(F.col("tokens"), "y", frame, min_confidence), ox=mx.cast("int"), oy=(F.col("height") - my).cast("int"))
    traced = F.when(F.size("smoothed") > 0, F.col("smoothed")).otherwise(F.col("points"))
    used = F.when(F.col("m.method") == "contour_tracing", traced).otherwise(F.col("network"))
    made = A.settled(made, used=used, x_line=scale.axis_line(F.col("x_ticks")), y_line=scale.axis_line(F.col("y_ticks")))
    made = A.settled(made, f=scale.factors(F.col("x_line"), F.col("y_line"), F.col("ox"), F.col("oy")))
    f, valid = F.col("f"), F.col("f.is_valid")
    strain = lambda p: F.when(valid, f["x_offset"] + (p["px"] - F.col("ox")) * f["x_scale"]).otherwise(p["px"].cast("double"))
    stress = lambda p: F.when(valid, f["y_offset"] + (F.col("oy") - p["py"]) * f["y_scale"]).otherwise(p["py"].cast("double"))
    mapped = F.sort_array(F.transform("used", lambda p, i: F.struct(strain(p).alias("strain"), i.alias("i"), stress(p).alias("stress"), p["px"].alias("pixel_x"), p["py"].alias("pixel_y"))))
    made = A.settled(made, mapped=mapped)
    made = A.settled(made, d=F.when(F.size("mapped") > 0, C._keep_first(F.transform("mapped", lambda p: p["strain"]), F.transform("mapped", lambda p: p["stress"]))))
    none = F.array().cast("array<double>")
    # an image's curve is analysed in its row
    curves = made.select(F.col("image_id").alias("curve_id"), "quality", "angle", "x_text", "y_text", "x_ticks", "y_ticks", "m", "f", "mapped", "d", F.coalesce("d.xs", none).alias("xs"), F.coalesce("d.ys", none).alias("ys"))
    got = features.analyze(curves, window).withColumnRenamed("curve_id", "image_id").withColumn("features", F.struct("peak_stress", "failure_strain", "initial_modulus", "secant_modulus_50", "energy_to_peak", "post_peak", "confidence"))
    report = got.select(
        "image_id", "quality", "angle", "x_text", "y_text", "x_ticks", "y_ticks", "m", "f", "mapped", "features", "critical_points", F.coalesce("d.xs", none).alias("xs"), F.coalesce("d.ys", none).alias("ys"), F.transform(F.concat("x_ticks", "y_ticks"), lambda t: t["w"]).alias("ocr"),
        F.col("m.method").alias("method"), F.lit(None).cast("double").alias("nmae"),
    ).withColumn("n_x", F.size("x_ticks")).withColumn("n_y", F.size("y_ticks"))
    scored = scoring.scored(report.withColumn("xt", F.col("x_ticks")).withColumn("yt", F.col("y_ticks")).withColumn("x_ticks", F.col("n_x")).withColumn("y_ticks", F.col("n_y")), strict)
    confidence = F.struct("overall", "grade", *scoring.WEIGHTS, "warnings", "recommendations")
    shown = F.transform("mapped", lambda p: F.struct(p["strain"].alias("strain"), p["stress"].alias("stress"), p["pixel_x"].alias("pixel_x"), p["pixel_y"].alias("pixel_y")))
    out = scored.select(
        "image_id", F.when(F.col("status") == "ok", "completed").otherwise("failed").alias("status"), shown.alias("data_points"), F.when(F.size("mapped") > 0, F.col("features")).alias("features"), "critical_points",
        confidence.alias("confidence"), _axis(F.col("xt"), F.col("x_text"), X_UNIT).alias("x_axis"), _axis(F.col("yt"), F.col("y_text"), Y_UNIT).alias("y_axis"),
        (F.when(F.col("m.method") == "contour_tracing", "contour_tracing_refined").otherwise(F.col("m.method")) if refine else F.col("m.method")).alias("extraction_method"), F.when(F.col("f.is_valid"), "calibrated").otherwise("pixel").alias("units"), F.struct("f.*").alias("scale"), "angle", F.lit(None).cast("string").alias("error"),
    )
    types = {x.name: x.dataType for x in out.schema}
    bad = seen.where("error is not null")
    nulls = [F.lit(None).cast(types[c]).alias(c) for c in out.columns[2:-1]]
    return out.unionByName(bad.select("image_id", F.lit("failed").alias("status"), *nulls, "error"))
