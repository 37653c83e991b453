"""Axis ticks and scales: from recognised tokens to calibrated units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curvelab.functions import arrays as A
from curvelab.functions.lines import SAMPLE, SEED, best_line, pairs, sums_near
from curvelab.functions.text import parse_number

MIN_CONFIDENCE, RESIDUAL, MIN_TICKS, MIN_R2 = 0.5, 5.0, 2, 0.9
MARGIN = 0.15


def ticks(tokens: DataFrame, min_confidence: float = MIN_CONFIDENCE, frame: str = "reference") -> DataFrame:
    """(chart_id, axis, pixel_position, value, confidence, raw_text) of the tokens that are numbers.

    tokens have text, conf (percent), left, top, width, height. The position is
    the token's middle along its axis. frame ``image`` undoes the enlargement
    (scale) and adds the region's offset; ``reference`` leaves positions as
    they were recognised.
    """
    near, size, off = (F.when(F.col("axis") == "x", F.col(a)).otherwise(F.col(b)) for a, b in (("left", "top"), ("width", "height"), ("left", "top")))
    at = near + F.floor(size / 2)
    if frame == "image":
        at = at / F.col("scale") + F.when(F.col("axis") == "x", F.col("offset_x")).otherwise(F.col("offset_y"))
    elif frame != "reference":
        raise ValueError("frame is reference or image")
    kept = tokens.where((F.trim("text") != "") & (F.col("conf") / 100 >= min_confidence))
    read = A.settled(kept, value=parse_number(F.col("text"))).where(F.col("value").isNotNull())
    return read.select("chart_id", "axis", at.cast("int").alias("pixel_position"), "value", (F.col("conf") / 100).alias("confidence"), F.trim("text").alias("raw_text"))


def in_range(t: DataFrame, low: float, high: float) -> DataFrame:
    """The ticks with low <= value <= high."""
    return t.where(F.col("value").between(low, high))


def axes(t: DataFrame) -> DataFrame:
    """One row per chart and axis: tick count, validity, first and last tick by place."""
    return t.groupBy("chart_id", "axis").agg(F.count(F.lit(1)).alias("tick_count"), (F.count(F.lit(1)) >= MIN_TICKS).alias("is_valid"), F.min_by("value", "pixel_position").alias("first_tick_value"), F.max_by("value", "pixel_position").alias("last_tick_value"))


def plot_region(width: Column, height: Column) -> Column:
    """struct(x, y, width, height, origin_x, origin_y) inside fixed margins left and below."""
    mx, my = F.floor(width * MARGIN).cast("int"), F.floor(height * MARGIN).cast("int")
    return F.struct(mx.alias("x"), F.lit(0).alias("y"), (width - mx).alias("width"), (height - my).alias("height"), mx.alias("origin_x"), (height - my).alias("origin_y"))


def r_squared(total: Column, residual: Column) -> Column:
    """1 - residual/total; without any variance 1 if the fit is perfect, else 0."""
    return F.when(total > 1e-12, 1 - residual / total).otherwise(F.when(residual <= 1e-12, 1.0).otherwise(0.0))


def fit_ols(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least squares per group: slope, intercept, r2."""
    sums = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.count(F.lit(1)).alias("n"))
    residual = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return sums.select(*by, "n", "slope", "intercept", r_squared(F.col("syy"), residual).alias("r2"))


def fit_weighted(df: DataFrame, by: list[str], x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted least squares per group by its five sums."""
    X, Y, Wt = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*by).agg(F.sum(Wt).alias("sw"), F.sum(Wt * X).alias("sx"), F.sum(Wt * Y).alias("sy"), F.sum(Wt * X * X).alias("sxx"), F.sum(Wt * X * Y).alias("sxy"), F.count(F.lit(1)).alias("n"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.withColumn("slope", slope).select(*by, "n", "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("sw")).alias("intercept"))


def _sums(points: Column, x0: Column, y0: Column, weight, keep=None) -> Column:
    """Weighted sums over points (x, y, w), about (x0, y0), as a struct."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "w", "x", "y", "xx", "xy", "yy")])

    def add(a: Column, p: Column) -> Column:
        w, x, y = weight(p), p["x"] - x0, p["y"] - y0
        more = {"n": F.lit(1.0), "w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}
        new = F.struct(*[(a[c] + v).alias(c) for c, v in more.items()])
        return new if keep is None else F.when(keep(p), new).otherwise(a)

    return F.aggregate(points, zero, add)


def _line(s: Column, x0: Column, y0: Column) -> Column:
    """struct(slope, intercept, total, residual) of the least-squares line of such sums; null slope without two different x."""
    sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / s["w"], s["xy"] - s["x"] * s["y"] / s["w"], s["yy"] - s["y"] * s["y"] / s["w"]
    slope = F.when(sxx > 1e-12, F.try_divide(sxy, sxx))
    return F.struct(slope.alias("slope"), (y0 + s["y"] / s["w"] - slope * (x0 + s["x"] / s["w"])).alias("intercept"), syy.alias("total"), F.greatest(syy - slope * sxy, F.lit(0.0)).alias("residual"))


LINE = "struct<inliers:int,r2:double,i:int,j:int,slope:double,intercept:double>"


def robust_line(points: Column, residual: float = RESIDUAL) -> Column:
    """Of an array of points (x, y, w) the line through a pair with most inliers (then the best fit on them, then the first
    pair in the order of x, y), refitted to its inliers: struct(inliers, r2, i, j, slope, intercept); i and j are negative places.

    Every pair is tried, instead of random ones; a row's pairs stay in the row. Null without two different x.
    """

    def body(p: Column) -> Column:
        n = F.size(p)
        x0, y0 = F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"]

        def pair(i: Column, j: Column) -> Column:
            a, b = F.get(p, i), F.get(p, j)
            near = lambda m: lambda q: F.abs(q["y"] - (m * q["x"] + (a["y"] - m * a["x"]))) <= residual
            sums = A.let(F.try_divide(b["y"] - a["y"], b["x"] - a["x"]), lambda m: _sums(p, x0, y0, lambda q: F.lit(1.0), near(m)))
            named = lambda s: A.let(_line(s, x0, y0), lambda f: F.struct(s["n"].cast("int").alias("inliers"), F.round(r_squared(f["total"], f["residual"]), 9).alias("r2"), (-i).alias("i"), (-j).alias("j"), f["slope"].alias("slope"), f["intercept"].alias("intercept")))
            return F.when(a["x"] != b["x"], A.let(sums, named))

        pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: pair(i, j))))
        return F.when(n >= 2, F.array_max(F.filter(pairs, lambda f: f["slope"].isNotNull()))).otherwise(F.lit(None).cast(LINE))

    return A.let(F.array_sort(points), body)


#: Points that a task counts together.
DEALT = 50_000


def _same(keys: list[str], a: str, b: str) -> Column:
    """Equal keys, null ones too."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _hash(*columns: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[c.cast("string") for c in columns]))


def fit_robust(t: DataFrame, by: list[str], x: str = "x", y: str = "y", residual: float = RESIDUAL, sample: int | None = SAMPLE, dealt: int = DEALT) -> DataFrame:
    """The robust line of each group's points; groups without two different x have none.

    The lines tried go through all pairs of ``sample`` different points, chosen by hash: of a group of no more points that is every pair, the
    exact search. All points of the group count for each line. They are dealt over tasks, equal ones as one with its number, and
    each task adds up what its points say for every line, so no task gets a whole group; the line with most inliers (then the best fit on them,
    then the first pair in the order of x, y) is refitted to its inliers. Without a ``sample`` every pair of a group of any size is tried, by ``robust_of_all_pairs``.
    """
    if sample is None:
        return robust_of_all_pairs(t, by, x, y, residual)
    keys = [f"g{i}" for i in range(len(by))]
    x0, y0 = F.col(x).cast("double"), F.col(y).cast("double")
    points = t.where(x0.isNotNull() & y0.isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x0.alias("x"), y0.alias("y"))
    points = points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy(*keys).orderBy(_hash(F.col("x"), F.col("y")), "x", "y")
    chosen = points.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    groups = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y")).alias("o"))
    picked = chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))  # ``sample`` points at most
    groups = groups.alias("g").join(picked.alias("p"), _same(keys, "g", "p"))
    parts = F.greatest(F.ceil(F.col("n") / dealt), F.lit(1)).cast("int")
    groups = groups.select(*[F.col(f"g.{k}").alias(k) for k in keys], parts.alias("parts"), "o", "p.p")
    tried = groups.select(*keys, "o", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    placed = points.alias("q").join(groups.select(*keys, "parts").alias("g"), _same(keys, "q", "g")).select(*[F.col(f"q.{k}").alias(k) for k in keys], "x", "y", "m", F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int").alias("part"))
    fields = {k: t.schema[c].dataType.simpleString() for c, k in zip(by, keys, strict=True)}
    schema = ", ".join(f"{k} {v}" for k, v in fields.items()) + ", i int, j int, ox double, oy double, n long, sx double, sy double, sxx double, sxy double, syy double"

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        """What some points of a group say for each of its lines: how many are near, and their sums about the group's first point."""
        if not right.num_rows or not left.num_rows:
            return pa.table({f: [] for f in [*keys, "i", "j", "ox", "oy", "n", "sx", "sy", "sxx", "sxy", "syy"]}, schema=pa.schema([left.schema.field(k) for k in keys] + [("i", pa.int32()), ("j", pa.int32()), ("ox", pa.float64()), ("oy", pa.float64()), ("n", pa.int64())] + [(c, pa.float64()) for c in ("sx", "sy", "sxx", "sxy", "syy")]))
        chosen, first = right.column("p")[0].as_py(), right.column("o")[0].as_py()
        px, py = np.array([c["x"] for c in chosen]), np.array([c["y"] for c in chosen])
        i, j, slope, cut = pairs(px, py)
        x, y, m = (left.column(c).to_numpy() for c in ("x", "y", "m"))
        dx, dy = x - first["x"], y - first["y"]
        terms = np.stack([m, m * dx, m * dy, m * dx * dx, m * dx * dy, m * dy * dy], axis=1)
        sums = np.concatenate([np.zeros((0, 6)), *sums_near(slope, cut, x, y, terms, residual)])
        hit = sums[:, 0] > 0
        key = [pa.array([left.column(k)[0].as_py()] * int(hit.sum()), left.schema.field(k).type) for k in keys]
        n = int(hit.sum())
        return pa.table([*key, pa.array(i[hit].astype(np.int32)), pa.array(j[hit].astype(np.int32)), pa.array([first["x"]] * n, pa.float64()), pa.array([first["y"]] * n, pa.float64()), pa.array(np.rint(sums[hit, 0]).astype(np.int64)), *[pa.array(sums[hit, c]) for c in range(1, 6)]], names=[*keys, "i", "j", "ox", "oy", "n", "sx", "sy", "sxx", "sxy", "syy"])

    told = placed.groupBy(*keys, "part").cogroup(tried.groupBy(*keys, "part")).applyInArrow(counted, schema)
    lines = told.groupBy(*keys, "i", "j", "ox", "oy").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")])
    sums = F.struct(F.col("n").cast("double").alias("w"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sxx").alias("xx"), F.col("sxy").alias("xy"), F.col("syy").alias("yy"))
    lines = lines.select(*keys, "i", "j", "n", _line(sums, F.col("ox"), F.col("oy")).alias("f")).where("f.slope is not null")
    r2 = F.round(r_squared(F.col("f.total"), F.col("f.residual")), 9)
    best = lines.groupBy(*keys).agg(F.max(F.struct(F.col("n").cast("int").alias("inliers"), r2.alias("r2"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), F.col("f.slope").alias("slope"), F.col("f.intercept").alias("intercept"))).alias("b"))
    return best.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "b.inliers", "b.slope", "b.intercept", "b.r2")


#: Points times lines' first points that a task of ``robust_of_all_pairs`` is given at a time.
LOOKED_UP = 5_000_000


def robust_of_all_pairs(t: DataFrame, by: list[str], x: str = "x", y: str = "y", residual: float = RESIDUAL, looked_up: int = LOOKED_UP) -> DataFrame:
    """The line of each group that ``fit_robust`` says, of those through all pairs of its points, however many it has.

    The points that lines start from are dealt over tasks, so many that a task's work is bounded; each also gets the group's points, equal ones as one with its number
    (24 bytes a point), for any of them may lie near a line. What a task does grows with a group's points and their logarithm for each point lines start from, in all with their square.
    """
    keys = [f"g{i}" for i in range(len(by))]
    x0, y0 = F.col(x).cast("double"), F.col(y).cast("double")
    points = t.where(x0.isNotNull() & y0.isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], x0.alias("x"), y0.alias("y"))
    groups = points.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("m")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "m"))).alias("p"))
    step = F.greatest(F.floor(F.lit(looked_up) / F.size("p")), F.lit(1)).cast("int")
    parts = groups.select(*keys, step.alias("step"), "p").select(*keys, "step", F.explode(F.sequence(F.lit(0), F.size("p") - 1, F.col("step"))).alias("start"), "p")
    dealt = parts.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: rows are few and their work is long
    kinds = [f"{k} {t.schema[c].dataType.simpleString()}" for c, k in zip(by, keys, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                p = one.column("p").flatten()
                px, py, m = (p.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                start = one.column("start")[0].as_py()
                best = best_line(px, py, m, residual, start, min(start + one.column("step")[0].as_py(), len(px)))
                if best is not None:
                    n, r2, i, j, slope, intercept = best[:6]
                    made = [pa.array([v], k) for v, k in ((n, pa.int32()), (r2, pa.float64()), (-i, pa.int32()), (-j, pa.int32()), (slope, pa.float64()), (intercept, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*[one.column(k) for k in keys], *made], [*keys, "inliers", "r2", "i", "j", "slope", "intercept"])

    lines = dealt.mapInArrow(run, ", ".join([*kinds, "inliers int, r2 double, i int, j int, slope double, intercept double"]))
    best = lines.groupBy(*keys).agg(F.max(F.struct("inliers", "r2", "i", "j", "slope", "intercept")).alias("b"))
    return best.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "b.inliers", "b.slope", "b.intercept", "b.r2")


def axis_line(ticks: Column, robust: bool = True) -> Column:
    """struct(slope, intercept, r2) of an axis' ticks (x place, y value, w confidence): robust from three on, weighted by confidence
    for two (or always, without ``robust``); null for fewer than two."""

    def weighted(p: Column) -> Column:
        x0, y0 = F.get(p, F.lit(0))["x"], F.get(p, F.lit(0))["y"]
        fit = lambda s: _line(s, x0, y0)
        off = lambda f: F.aggregate(p, F.lit(0.0), lambda a, q: a + (q["y"] - f["slope"] * q["x"] - f["intercept"]) * (q["y"] - f["slope"] * q["x"] - f["intercept"]))
        total = A.variance(F.transform(p, lambda q: q["y"])) * F.size(p)
        shown = lambda f: F.when(f["slope"].isNotNull(), F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), r_squared(total, off(f)).alias("r2")))
        return A.let(A.let(_sums(p, x0, y0, lambda q: F.greatest(q["w"], F.lit(1e-9))), fit), shown)

    few = F.when(F.size(ticks) >= MIN_TICKS, A.let(ticks, weighted))
    if not robust:
        return few
    many = A.let(robust_line(ticks), lambda f: F.when(f.isNotNull(), F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), f["r2"].alias("r2"))))
    return F.when(F.size(ticks) >= 3, many).otherwise(few)


def factors(x: Column, y: Column, origin_x: Column, origin_y: Column) -> Column:
    """struct(x_scale, x_offset, y_scale (up is positive), y_offset, x_r2, y_r2, is_valid) from both axes' lines.

    An axis without a line has defaults; a zero counts as missing there.
    """
    either = lambda v, d: F.when(v.isNull() | (v == 0), F.lit(d)).otherwise(v)
    good = (x["r2"] > MIN_R2) & (y["r2"] > MIN_R2) & (x["slope"] > 0) & y["slope"].isNotNull()
    return F.struct(
        either(x["slope"], 1.0).alias("x_scale"), either(x["slope"] * origin_x + x["intercept"], 0.0).alias("x_offset"),
        either(-y["slope"], 1.0).alias("y_scale"), either(y["slope"] * origin_y + y["intercept"], 0.0).alias("y_offset"),
        F.coalesce(x["r2"], F.lit(0.0)).alias("x_r2"), F.coalesce(y["r2"], F.lit(0.0)).alias("y_r2"), F.coalesce(good, F.lit(False)).alias("is_valid"),
    )


def scale_factors(t: DataFrame, origins: DataFrame, robust: bool = True) -> DataFrame:
    """One row per chart of ``origins`` (chart_id, origin_x, origin_y): its scale by ``factors`` from its ticks."""
    tick = F.struct(F.col("pixel_position").cast("double").alias("x"), F.col("value").alias("y"), F.col("confidence").alias("w"))
    of = lambda axis: F.collect_list(F.when(F.col("axis") == axis, tick))
    grouped = t.groupBy("chart_id").agg(of("x").alias("x_ticks"), of("y").alias("y_ticks"))
    lines = A.settled(origins.join(grouped, "chart_id", "left"), x=axis_line(F.col("x_ticks"), robust), y=axis_line(F.col("y_ticks"), robust))
    out = A.settled(lines, f=factors(F.col("x"), F.col("y"), F.col("origin_x"), F.col("origin_y")))
    return out.select("chart_id", "origin_x", "origin_y", "f.*")


def map_units(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """(chart_id, idx, strain, stress, pixel_x, pixel_y, units) by each chart's scale; with an invalid scale the pixels stand for themselves, y downwards."""
    s = scales.withColumnRenamed("chart_id", "sid")
    strain = F.col("x_offset") + (F.col("px") - F.col("origin_x")) * F.col("x_scale")
    stress = F.col("y_offset") + (F.col("origin_y") - F.col("py")) * F.col("y_scale")
    ok = F.coalesce(F.col("is_valid"), F.lit(False))
    return pixels.join(s, F.col("chart_id") == F.col("sid"), "left").select(
        "chart_id", "idx", F.when(ok, strain).otherwise(F.col("px").cast("double")).alias("strain"), F.when(ok, stress).otherwise(F.col("py").cast("double")).alias("stress"),
        F.col("px").alias("pixel_x"), F.col("py").alias("pixel_y"), F.when(ok, "calibrated").otherwise("pixel").alias("units"),
    )


def box_mapping(px: Column, py: Column, box: tuple[int, int, int, int], x_range: tuple[float, float], y_range: tuple[float, float]) -> tuple[Column, Column]:
    """(x, y) of a pixel in a known axis box (left, top, right, bottom), both ends included."""
    left, top, right, bottom = box
    return x_range[0] + (px - left) / (right - left) * (x_range[1] - x_range[0]), y_range[0] + (bottom - py) / (bottom - top) * (y_range[1] - y_range[0])


def mapping_issues(xs: Column, ys: Column, x_range: tuple[float, float] = (0, 10), y_range: tuple[float, float] = (0, 50_000)) -> Column:
    """What is implausible about a mapped curve, as an array of strings."""
    m = F.floor(F.size(ys) / 4).cast("int")
    falls = F.filter(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))), lambda i: F.get(ys, i) < F.get(ys, i - 1))
    return F.array_compact(F.array(
        F.when(F.size(xs) == 0, "no points"),
        F.when((F.array_min(xs) < x_range[0]) | (F.array_max(xs) > x_range[1]), "x out of range"),
        F.when((F.array_min(ys) < y_range[0]) | (F.array_max(ys) > y_range[1]), "y out of range"),
        F.when((m > 1) & (F.size(falls) > 0), "y falls in the first quarter"),
    ))
