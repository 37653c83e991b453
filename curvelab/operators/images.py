"""Image operators over DataFrames: (image_id, height, width, channels, data) rows through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelab.functions import parts
from curvelab.functions import pixels as P
from curvelab.functions.resampling import rescaled

Image = np.ndarray


def _shaped(height: int, width: int, channels: int, data) -> Image:
    if data is None:
        raise ValueError("the image is not decoded")
    shape = (height, width) if channels == 1 else (height, width, channels)
    a = np.frombuffer(data, np.uint8).reshape(shape)
    return a[..., :3] if a.ndim == 3 else a


def _array(row) -> Image:
    if row.data is None:
        raise ValueError("the image is not decoded")
    return _shaped(int(row.height), int(row.width), int(row.channels), row.data)  # beside rows without a size they come as floats


def _images(b: pa.RecordBatch) -> Iterator[tuple]:
    """(height, width, channels, data) of each row of a batch; an image's bytes stay where they lie."""
    data = b.column(4)
    for i, size in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
        yield *size, data[i].as_buffer() if data[i].is_valid else None


#: Arrow's types by their names in schemas.
_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
#: Rows, and bytes of images, that are held before they go on.
ROWS, BYTES = 4096, 1 << 20


#: Bytes taken and given back once by a task, after which the C library keeps arrays up to that size for the next image instead of returning each to the system.
ARENA = 1 << 24


def made(b: pa.RecordBatch, make: Callable[[Image], list[tuple] | dict], fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """make's rows for the images of a batch. Rows of small images go on together, a few thousand or a megabyte and those of one image at most."""
    binary = [k for k, t in enumerate(fields.values()) if t == _KINDS["binary"]]
    held, at, errors, size = [[] for _ in fields], [], [], 0  # columns, the image of each row, reasons, bytes

    def out() -> pa.RecordBatch:
        columns = [pa.chunked_array(c, t).combine_chunks() for c, t in zip(held, fields.values(), strict=True)]
        return pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *columns, pa.array(errors, pa.string())], names=["image_id", *fields, "error"])

    for i, image in enumerate(_images(b)):
        try:
            rows, error = make(_shaped(*image)), None
            columns = [rows[n] for n in fields] if isinstance(rows, dict) else [list(c) for c in zip(*rows, strict=True)] or [[]] * len(fields)
            arrays = [pa.array(c, t, from_pandas=True) for c, t in zip(columns, fields.values(), strict=True)]
        except Exception as e:  # one bad image is a row, not a lost task
            columns, error = [[None]] * len(fields), f"{type(e).__name__}: {e}"
            arrays = [pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)]
        for c, x in zip(held, arrays, strict=True):
            c.append(x)
        n = len(arrays[0])
        at += [i] * n
        errors += [error] * n
        size += sum(len(v) for k in binary for v in columns[k] if v is not None)
        if len(at) >= ROWS or size >= BYTES:
            yield out()
            held, at, errors, size = [[] for _ in fields], [], [], 0
    if at:
        yield out()


def _each(df: DataFrame, make: Callable[[Image], list[tuple] | dict], schema: str) -> DataFrame:
    """make's rows for every image, after its image_id: tuples, or columns by name; a failure is a row of nulls with its reason."""
    fields = {n: _KINDS[k] for n, k in (f.split() for f in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(ARENA, np.uint8)
        for b in batches:
            yield from made(b, make, fields)

    kind = df.schema["image_id"].dataType.simpleString()
    return df.select("image_id", "height", "width", "channels", "data").mapInArrow(run, f"image_id {kind}, {schema}, error string")


def quality(df: DataFrame) -> DataFrame:
    return _each(df, lambda a: [tuple(float(v) for v in P.quality(a).values())], "blur double, noise double, contrast double, overall double")


def noise(df: DataFrame) -> DataFrame:
    return _each(df, lambda a: [(float(P.noise_level(a)),)], "noise double")


def gray_pixels(df: DataFrame, size: int | None = None) -> DataFrame:
    """(image_id, px, py, v) of every pixel's brightness, or with ``size`` of its mean over size x size pixels."""

    def make(a: Image) -> dict:
        g = P.gray(a) if size is None else P.box_mean(P.gray(a), size)
        py, px = np.indices(g.shape, np.int32)
        return {"px": px.ravel(), "py": py.ravel(), "v": g.ravel().astype(np.float64)}

    return _each(df, make, "px int, py int, v double").drop("error")


def skeleton(df: DataFrame) -> DataFrame:
    """(image_id, px, py) of each mask's thinned pixels."""
    return _each(df, lambda a: [(int(x), int(y)) for y, x in np.argwhere(P.thinned(a) > 0)], "px int, py int").where("error is null").drop("error")


#: Images that are drawn before they go on.
DRAWN = 16


def drawn(curves: DataFrame, height: int, width: int, left: int, thick: int = 3) -> DataFrame:
    """(image_id, height, width, channels, data): images of curves (image_id, ys), whose y are pixel rows from the column ``left`` on, black on white."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), DRAWN):
                part = pdf.iloc[s : s + DRAWN]
                out = [(i, height, width, 1, P.drawn(np.asarray(ys), height, width, left, thick).tobytes()) for i, ys in zip(part["image_id"], part["ys"], strict=True)]
                yield pd.DataFrame(out, columns=["image_id", "height", "width", "channels", "data"])

    kind = curves.schema["image_id"].dataType.simpleString()
    return curves.select("image_id", "ys").mapInPandas(run, f"image_id {kind}, height int, width int, channels int, data binary")


def ruled(df: DataFrame, every: int, thick: int) -> DataFrame:
    """Images in grey with black lines across and up at every so many pixels."""

    def make(a: Image) -> list[tuple]:
        g = P.gray(a).copy()
        for k in range(thick):
            g[every // 2 + k :: every] = 0
            g[:, every // 2 + k :: every] = 0
        return [(g.shape[0], g.shape[1], 1, g.tobytes())]

    return _each(df, make, "height int, width int, channels int, data binary").where("error is null").drop("error")


def rectify(df: DataFrame) -> DataFrame:
    def make(a: Image) -> list[tuple]:
        out, angle = P.rectified(a)
        return [(out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], out.tobytes(), float(angle))]

    return _each(df, make, "height int, width int, channels int, data binary, angle double")


def curve_mask(df: DataFrame, watermark: bool = False) -> DataFrame:
    def make(a: Image) -> list[tuple]:
        mask, noise = P.filtered(a, watermark=watermark)
        return [(mask.shape[0], mask.shape[1], 1, mask.tobytes(), float(noise))]

    return _each(df, make, "height int, width int, channels int, data binary, noise double")


def edge_mask(df: DataFrame) -> DataFrame:
    """A mask of each image's edges, for tracing without a threshold."""

    def make(a: Image) -> list[tuple]:
        mask = P.edge_mask(a)
        return [(mask.shape[0], mask.shape[1], 1, mask.tobytes())]

    return _each(df, make, "height int, width int, channels int, data binary")


_models: dict[str, object] = {}


def cached_model(path: str, load: Callable[[str], object]) -> object:
    """What ``load`` makes of a model file, once per worker process; for use in a segment_fn."""
    if path not in _models:
        _models[path] = load(path)
    return _models[path]


def outlines(df: DataFrame, outside: bool = True) -> DataFrame:
    """(image_id, part, idx, px, py, area, arc): the outer outline of every part of each mask, in the order of a walk around it, with what it encloses and the length of the walk."""

    def make(a: Image) -> dict:
        walks = parts.outlines(a, outside)
        of = lambda f, t: np.repeat(np.array([f(w) for w in walks], t), [len(w) for w in walks])
        xy = np.concatenate([np.zeros((0, 2), int), *walks]).astype(np.int32)
        idx = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(w), dtype=np.int32) for w in walks)])
        return {"part": np.repeat(np.arange(1, len(walks) + 1, dtype=np.int32), [len(w) for w in walks]), "idx": idx, "px": xy[:, 0], "py": xy[:, 1], "area": of(parts.area, np.float64), "arc": of(parts.length, np.float64)}

    return _each(df, make, "part int, idx int, px int, py int, area double, arc double").where("error is null").drop("error")


def png(df: DataFrame) -> DataFrame:
    """(image_id, content, error): images as PNG files."""
    return _each(df, lambda a: [(P.png(a),)], "content binary")


def sheet_corners(df: DataFrame) -> DataFrame:
    """(image_id, corner, x, y): the four vertices of the sheet or frame in each image, clockwise from the top left; none where there is no such outline."""
    return _each(df, lambda a: [(k, float(x), float(y)) for k, (x, y) in enumerate(q)] if (q := P.quad(a)) is not None else [], "corner int, x double, y double").where("error is null").drop("error")


def without_grid(df: DataFrame) -> DataFrame:
    """Images in grey whose grid lines are painted over from their surroundings."""

    def make(a: Image) -> list[tuple]:
        g = P.without_grid(P.gray(a))
        return [(g.shape[0], g.shape[1], 1, g.tobytes())]

    return _each(df, make, "height int, width int, channels int, data binary")


def resize(df: DataFrame, height: int, width: int, kind: str = "cubic") -> DataFrame:
    """kind: cubic, linear, or area (each new pixel is the mean of what it covers)."""

    def make(a: Image) -> list[tuple]:
        out = P.resized(a, height, width, kind)
        return [(height, width, 1 if out.ndim == 2 else out.shape[2], out.tobytes())]

    return _each(df, make, "height int, width int, channels int, data binary")


def trace(df: DataFrame) -> DataFrame:
    """(image_id, idx, px, py) of the curve in each mask."""
    return _each(df, lambda a: [(i, x, y) for i, (x, y) in enumerate(P.traced(a))], "idx int, px int, py int").where("error is null").drop("error")


def smooth_trace(points: DataFrame, n: int = 200) -> DataFrame:
    """Each image's points, their y smoothed, on a spline of n points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("idx")
        out = P.smoothed_curve(list(zip(p["px"].tolist(), p["py"].tolist(), strict=True)), n)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "idx": range(len(out)), "px": [x for x, _ in out], "py": [y for _, y in out]})

    kind = points.schema["image_id"].dataType.simpleString()
    return points.groupBy("image_id").applyInPandas(run, f"image_id {kind}, idx int, px int, py int")


def read_text(df: DataFrame, ocr_fn: Callable[[Image], list[tuple]] | None = None) -> DataFrame:
    """Tokens (text, conf, left, top, width, height) by a pluggable recogniser; without one there are none."""
    return _each(df, lambda a: ocr_fn(P.for_reading(a)) if ocr_fn else [], "text string, conf double, left int, top int, width int, height int")


def segment(df: DataFrame, segment_fn: Callable[[Image], Image] | None = None, threshold: float = 0.5, size: int | None = None) -> DataFrame:
    """(image_id, idx, px, py, confidence) by a pluggable model that maps an image to probabilities; without one there are no points.

    With ``size`` the model sees means over a grid of size x size, and its probabilities are set back to the image's grid.
    """

    def make(a: Image) -> list[tuple]:
        if segment_fn is None:
            return []
        p = segment_fn(a) if size is None else rescaled(segment_fn(P.resized(a, size, size, "area")), *a.shape[:2], "linear")
        points = P.traced(P.thinned(np.where(p > threshold, 255, 0).astype(np.uint8)))
        return [(i, x, y, float(p[y, x])) for i, (x, y) in enumerate(points)]

    return _each(df, make, "idx int, px int, py int, confidence double")


def pixels(df: DataFrame, data: Column, width: Column) -> DataFrame:
    """(image_id, px, py, v) of an array column of values in rows of ``width``."""
    return df.select("image_id", width.alias("w"), F.posexplode(data).alias("k", "v")).select("image_id", (F.col("k") % F.col("w")).alias("px"), F.floor(F.col("k") / F.col("w")).cast("int").alias("py"), "v")


def auto_crop(px: DataFrame, least: float, padding: int, width: int, height: int) -> DataFrame:
    """(image_id, x, y, w, h) of the pixels over ``least``, padded, within the image."""
    box = px.where(F.col("v") > least).groupBy("image_id").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    x, y = F.greatest(F.col("x0") - padding, F.lit(0)), F.greatest(F.col("y0") - padding, F.lit(0))
    return box.select("image_id", x.alias("x"), y.alias("y"), (F.least(F.col("x1") + 1 + padding, F.lit(width)) - x).alias("w"), (F.least(F.col("y1") + 1 + padding, F.lit(height)) - y).alias("h"))


def array_components(df: DataFrame, width: int, least: int) -> DataFrame:
    """(image_id, component, area) of 8-connected parts of at least so many pixels; mask is an array of 0 and 1 in rows of ``width``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image_id, mask in zip(pdf["image_id"], pdf["mask"], strict=True):
                _, areas = P.components(np.array(mask, np.uint8).reshape(-1, width))
                out += [(image_id, k + 1, int(a)) for k, a in enumerate(areas.tolist()) if a >= least]
            yield pd.DataFrame(out, columns=["image_id", "component", "area"])

    kind = df.schema["image_id"].dataType.simpleString()
    return df.select("image_id", "mask").mapInPandas(run, f"image_id {kind}, component int, area int")
