"""Image kernels in numpy: grey, blur, morphology, edges, thinning, tracing, levelling.

Images are uint8 arrays (h, w) or (h, w, 3) in blue-green-red order. Borders are
mirrored without repeating the edge unless said otherwise. Parts and outlines are
in ``parts``, other grids and painting over in ``resampling``.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

from curvelab.functions.parts import area as enclosed
from curvelab.functions.parts import components, corners, length, outlines, simplified
from curvelab.functions.resampling import painted_over, resized, rotated, straightened


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.int32) for k in range(3))
    return ((114 * b + 587 * g + 299 * r + 500) // 1000).astype(np.uint8)


def _padded(a: np.ndarray, ry: int, rx: int) -> np.ndarray:
    h, w = a.shape
    if h <= ry or w <= rx:
        return np.pad(a, ((ry, ry), (rx, rx)), mode="edge")
    out = np.empty((h + 2 * ry, w + 2 * rx), a.dtype)
    out[ry : ry + h, rx : rx + w] = a
    out[:ry, rx : rx + w], out[ry + h :, rx : rx + w] = a[ry:0:-1], a[-2 : -ry - 2 : -1]
    out[:, :rx], out[:, rx + w :] = out[:, 2 * rx : rx : -1], out[:, rx + w - 2 : w - 2 : -1] if rx else out[:, w:]
    return out


#: Rows that are convolved at a time: so many stay near the processor.
BAND = 64


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    (ky, kx), (h, w) = kernel.shape, a.shape
    p, out, term = _padded(a.astype(np.float64), ky // 2, kx // 2), np.zeros(a.shape), np.empty((BAND, w))
    taps = [(i, j, kernel[i, j]) for i in range(ky) for j in range(kx) if kernel[i, j]]
    low, high, busy = p.min(axis=1), p.max(axis=1), np.zeros(h, bool)
    for i in range(ky):
        busy |= (low[i : i + h] != high[i : i + h]) | (low[i : i + h] != low[:h])
    level, total = low[:h][~busy], np.zeros(h - busy.sum())
    for _, _, k in taps:  # rows of one brightness, as above and below a chart, have the same sum everywhere
        total += k * level
    out[~busy] = total[:, None]
    edges = np.flatnonzero(np.diff(busy, prepend=False, append=False)).tolist()
    for begin, end in zip(edges[::2], edges[1::2], strict=True):
        for s in range(begin, end, BAND):
            part = out[s : min(s + BAND, end)]
            n = len(part)
            for i, j, k in taps:
                part += np.multiply(p[s + i : s + i + n, j : j + w], k, out=term[:n])
    return out


def laplacian(a: np.ndarray) -> np.ndarray:
    if a.dtype != np.uint8:
        return convolve(a, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))
    p = _padded(a.astype(np.int16), 1, 1)  # whole numbers: exact in either kind
    out = p[1:-1, 1:-1] * np.int16(-4)
    for beside in (p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]):
        out += beside
    return out.astype(np.float64)


def _box_sum(a: np.ndarray, size: int, kind: type) -> np.ndarray:
    """The sum of size x size windows, in whole numbers of a kind: down, then across."""
    (h, w), p = a.shape, _padded(a.astype(kind), size // 2, size // 2)
    down = p[:h].copy()
    for k in range(1, size):
        down += p[k : k + h]
    out = down[:, :w].copy()
    for k in range(1, size):
        out += down[:, k : k + w]
    return out


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """The mean of size x size windows, from an integral image; of few bytes from their sums."""
    if a.dtype == np.uint8 and size < 10:
        return _box_sum(a, size, np.int16) / size**2
    r = size // 2
    p = _padded(a.astype(np.float64), r, r)
    if size % 2 == 0:
        p = p[:-1, :-1] if p.shape[0] > size else p
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = a.shape
    return (s[size : size + h, size : size + w] - s[:h, size : size + w] - s[size : size + h, :w] + s[:h, :w]) / size**2


def gaussian_blur(a: np.ndarray, size: int = 5) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    k /= k.sum()
    out = convolve(convolve(a, k[None, :]), k[:, None])
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def quality(image: np.ndarray) -> dict[str, float]:
    """blur, noise, contrast, overall: sharpness is the Laplacian's variance, noise the mean of the local mean squares about the local mean, contrast the deviation."""
    g = gray(image)
    blur = 1 - min(laplacian(g).var() / 500, 1)
    if g.dtype == np.uint8:  # whole numbers, as all that follows
        off = g - (_box_sum(g, 5, np.int16) + 12) // 25
        spread = _box_sum(np.square(off, dtype=np.int32), 5, np.int32) / 25
    else:
        spread = box_mean((g - np.rint(box_mean(g, 5))) ** 2, 5)
    noise = min(float(spread.mean()) / 1000, 1)
    contrast = min(g.astype(np.float64).std() / 60, 1)
    return {"blur": blur, "noise": noise, "contrast": contrast, "overall": 0.35 * (1 - blur) + 0.35 * (1 - noise) + 0.30 * contrast}


def noise_level(image: np.ndarray) -> float:
    return min(laplacian(gray(image)).var() / 1000, 1.0)


def adaptive_mask(g: np.ndarray, size: int = 11, offset: float = 2) -> np.ndarray:
    """255 where a pixel is darker than its Gaussian neighbourhood by more than ``offset``."""
    return np.where(gaussian_blur(g, size).astype(np.int16) - g < math.ceil(offset), np.uint8(0), np.uint8(255))  # whole numbers


def _extreme(a: np.ndarray, ky: int, kx: int, pick, fill: int) -> np.ndarray:
    """Extremes of windows, down and then across, of windows twice as long each time."""
    p = np.full((a.shape[0] + ky - 1, a.shape[1] + kx - 1), fill, a.dtype)
    p[ky // 2 : ky // 2 + a.shape[0], kx // 2 : kx // 2 + a.shape[1]] = a
    for axis, size in enumerate((ky, kx)):
        has = 1
        while has < size:
            step = min(has, size - has)
            p = pick(p[:-step], p[step:]) if axis == 0 else pick(p[:, :-step], p[:, step:])
            has += step
    return p


def dilate(a: np.ndarray, ky: int = 3, kx: int = 3) -> np.ndarray:
    return _extreme(a, ky, kx, np.maximum, 0)


def erode(a: np.ndarray, ky: int = 3, kx: int = 3) -> np.ndarray:
    return _extreme(a, ky, kx, np.minimum, 255)


def opened(a: np.ndarray, ky: int = 3, kx: int = 3) -> np.ndarray:
    return dilate(erode(a, ky, kx), ky, kx)


def closed(a: np.ndarray, ky: int = 3, kx: int = 3) -> np.ndarray:
    return erode(dilate(a, ky, kx), ky, kx)


def without_small(mask: np.ndarray, least: int = 50) -> np.ndarray:
    labels, areas = components(mask)
    if (areas >= least).all():
        return mask.astype(np.uint8)
    keep = np.concatenate(([False], areas >= least))
    return np.where(keep[labels], mask, 0).astype(np.uint8)


def _run_lengths(on: np.ndarray) -> np.ndarray:
    """For each pixel that is on, how many successive ones of its column are, itself included."""
    h = on.shape[0]
    row = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(on, -1, row), axis=0)
    below = np.minimum.accumulate(np.where(on, h, row)[::-1], axis=0)[::-1]
    return np.where(on, below - above - 1, 0)


def without_grid(g: np.ndarray, length: int = 15, share: float = 0.01) -> np.ndarray:
    """Long level and upright strokes, where there are many, painted over from their surroundings.

    Where more than the stroke is dark across it, something crosses it, which stays.
    """
    dark = 255 - g
    again = opened if length % 2 == 0 else lambda a, *_: a  # by an odd length a second opening takes nothing away
    across, up = (again(opened(dark, ky, kx), ky, kx) > 127 for ky, kx in ((1, length), (length, 1)))
    for lines, others, turn in ((across, up, lambda a: a), (up, across, np.transpose)):
        if lines.mean() > share:
            lines, others = turn(lines), dilate(turn(others).astype(np.uint8), 3, 3) > 0
            run = _run_lengths(turn(g < 128) & ~others)
            crossing = run > np.median(run[lines]) + 1
            over = (dilate((lines & ~crossing).astype(np.uint8), 7, 3) > 0) & ~crossing  # with what a blur has spread of them
            g = painted_over(g, turn(over))
    return g


def filtered(image: np.ndarray, min_area: int = 50, watermark: bool = False) -> tuple[np.ndarray, float]:
    """(mask of the curve, noise level): blur, grid removal, watermark removal if asked for, adaptive threshold, opening, closing, small parts out."""
    g = without_grid(gaussian_blur(gray(image), 5))
    mask = adaptive_mask(without_watermark(g) if watermark else g)
    return without_small(closed(opened(mask, 2, 2), 3, 3), min_area), noise_level(g)


def auto_crop(image: np.ndarray, least: int = 10, padding: int = 5) -> tuple[int, int, int, int]:
    """(x, y, w, h) of the pixels over ``least``, padded; the whole image if there are none."""
    ys, xs = np.nonzero(gray(image) > least)
    h, w = image.shape[:2]
    if not len(ys):
        return 0, 0, w, h
    x0, y0 = max(0, int(xs.min()) - padding), max(0, int(ys.min()) - padding)
    return x0, y0, min(w, int(xs.max()) + 1 + padding) - x0, min(h, int(ys.max()) + 1 + padding) - y0


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges by gradient, thinning across it, and hysteresis."""
    f = g.astype(np.float64)
    gx = convolve(f, np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float))
    gy = convolve(f, np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]], float))
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    turn = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    h, w = g.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    peak = np.zeros(g.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak |= (turn == k) & (size >= at(dy, dx)) & (size > at(-dy, -dx))
    weak = (peak & (size > low)).astype(np.uint8)
    labels, areas = components(weak)
    strong = np.zeros(len(areas) + 1, bool)
    strong[np.unique(labels[(size > high) & (weak > 0)])] = True
    strong[0] = False
    return np.where(strong[labels], 255, 0).astype(np.uint8)


def _longest(at: np.ndarray, gap: float) -> tuple[int, int]:
    """First and last place, in the order of ``at``, of its longest stretch without a gap over ``gap``."""
    cuts = np.flatnonzero(np.diff(at) > gap)
    first, last = np.concatenate(([0], cuts + 1)), np.append(cuts, len(at) - 1)
    k = int((at[last] - at[first]).argmax())
    return int(first[k]), int(last[k])


def skew_angle(image: np.ndarray, votes: int = 100, length: float = 100, gap: float = 10) -> float:
    """The median deviation from level or upright of straight edges, in degrees: lines of a Hough transform in steps of one degree, the
    strongest first; on each the longest stretch without a gap over ``gap`` counts from ``length`` pixels on, by the slope fitted
    to it, and its pixels count no more for weaker lines."""
    ys, xs = np.nonzero(edges(gray(image)))
    if not len(ys):
        return 0.0
    theta = np.deg2rad(np.arange(180))
    rho = np.rint(np.cos(theta)[:, None] * xs + np.sin(theta)[:, None] * ys).astype(int)
    span = int(np.hypot(*image.shape[:2])) + 1
    table = np.zeros((180, 2 * span + 1), int)
    np.add.at(table, (np.arange(180)[:, None], rho + span), 1)
    lines = np.argwhere(table >= votes)
    ranks, ends = np.argsort(rho, axis=1, kind="stable"), np.cumsum(table, axis=1)  # a bin's pixels are successive in its angle's order
    free, dev = np.ones(len(xs), bool), []
    for t, r in lines[np.argsort(-table[tuple(lines.T)], kind="stable")].tolist():
        on = ranks[t, ends[t, r - 1] - table[t, r - 1] : ends[t, min(r + 1, 2 * span)]]  # with the bins beside it, over which stairs spread
        on = on[free[on]]
        if len(on) < votes:
            continue
        c, s = np.cos(theta[t]), np.sin(theta[t])
        along = ys[on] * c - xs[on] * s
        order = np.argsort(along, kind="stable")
        i, j = _longest(along[order], gap)
        if along[order[j]] - along[order[i]] >= length - 1:
            part = order[i : j + 1]
            free[on[part]] = False
            m = np.polyfit(along[part], xs[on[part]] * c + ys[on[part]] * s, 1)[0]
            dev.append((np.rad2deg(np.arctan2(c + m * s, m * c - s)) + 45) % 90 - 45)
    return float(np.median(dev)) if dev else 0.0


def rectified(image: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, float]:
    """(image, angle): set level if it is askew by more than ``least`` degrees, a photographed sheet straightened, then cropped."""
    angle = skew_angle(image)
    out = rotated(image, angle) if abs(angle) > least else image
    sheet = quad(out)
    if sheet is not None:
        out = straightened(out, sheet)
    x, y, w, h = auto_crop(out)
    return out[y : y + h, x : x + w], angle


def quad(image: np.ndarray, share: float = 0.25) -> np.ndarray | None:
    """The corners (top left, top right, bottom right, bottom left) of a sheet or frame: the largest outline among the edges, where it has four vertices and encloses a share of the image."""
    found = corners(dilate(edges(gray(image))))  # wider, so that gaps close
    if found is None:
        return None
    x, y = found.T
    return found if abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 > share * image.shape[0] * image.shape[1] else None


def thinned(mask: np.ndarray) -> np.ndarray:
    """The morphological skeleton: what openings take away from ever smaller erosions. A mask without any background has none."""
    a, out = mask.copy(), np.zeros_like(mask)
    cross = lambda x, pick, fill: pick(_extreme(x, 3, 1, pick, fill), _extreme(x, 1, 3, pick, fill))
    while a.any():
        small = cross(a, np.minimum, 255)
        if (small == a).all():
            break
        out |= a & ~cross(small, np.maximum, 0)
        a = small
    return out


def traced(mask: np.ndarray) -> list[tuple[int, int]]:
    """(x, median y) of every column of the largest-scoring part of a mask; sorted by x."""
    labels, areas = components(mask)
    if not len(areas):
        return []
    ys, xs = np.nonzero(labels)
    part = labels[ys, xs]
    order = np.lexsort((ys, xs, part))
    ys, xs, part = ys[order], xs[order], part[order]
    best, chosen = -1.0, None
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x, y = xs[s:e], ys[s:e]
        first = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
        n = np.diff(np.append(first, len(x)))
        middle = (y[first + (n - 1) // 2] + y[first + n // 2]) / 2  # a column's rows are sorted
        score = _part_score(x, y, middle, mask.shape)
        if score > best:
            best, chosen = score, list(zip(x[first].tolist(), middle.astype(int).tolist(), strict=True))
    return chosen


def traced_outline(mask: np.ndarray, epsilon: float = 1.0, least: float = 100) -> tuple[list[tuple[int, int]], float, float]:
    """(points, enclosed area, length) of the outline that looks most like the curve, among those of at least some length: simplified to within ``epsilon``, the median y of every x, sorted by x."""
    best, chosen = -1.0, None
    for walk in outlines(mask):
        arc = length(walk)
        if arc < least:
            continue
        x, y = walk.T
        score = _score(np.ptp(x) + 1, np.ptp(y) + 1, int(y.min()), arc, mask.shape)
        if score > best:
            best, chosen = score, walk
    if chosen is None:
        return [], 0.0, 0.0
    p = simplified(chosen, epsilon)
    xs = np.unique(p[:, 0])
    return [(int(x), int(np.median(p[p[:, 0] == x, 1]))) for x in xs], enclosed(chosen), length(chosen)


def _score(bw: int, bh: int, top: int, arc: float, shape: tuple[int, int]) -> float:
    h, w = shape
    return 0.35 * bw / w + 0.25 * (1 - (top + bh / 2) / h) + 0.20 * min(bw / max(bh, 1), 5) / 5 + 0.20 * min(arc / max(np.hypot(bw, bh), 1), 2) / 2


def _part_score(xs: np.ndarray, ys: np.ndarray, middle: np.ndarray, shape: tuple[int, int]) -> float:
    return _score(int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, int(ys.min()), len(middle) + np.abs(np.diff(middle)).sum(), shape)


def spline(points: list[tuple[float, float]], n: int) -> list[tuple[int, int]]:
    """n points, cut to whole numbers, of the interpolating cubic spline (third derivative continuous at the second and the last
    but one point) through the points by chord length; fewer than four stay as they are."""
    if len(points) < 4:
        return [(int(x), int(y)) for x, y in points]
    p = np.array(points, float)
    u = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
    keep = np.concatenate(([True], np.diff(u) > 0))
    p, u = p[keep], u[keep]
    if len(p) < 4:
        return [(int(x), int(y)) for x, y in points]
    h, k = np.diff(u), len(p)
    rhs = 6 * np.diff(np.diff(p, axis=0) / h[:, None], axis=0)
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()  # the three diagonals, of the inner points
    a, b = h[0] / h[1], h[-1] / h[-2]
    mid[0], high[0] = mid[0] + h[0] * (1 + a), high[0] - h[0] * a
    mid[-1], low[-1] = mid[-1] + h[-1] * (1 + b), low[-1] - h[-1] * b
    low, mid, high, rx, ry = (c.tolist() for c in (low, mid, high, *rhs.T))
    d, x, y = mid[0], rx[0], ry[0]
    done = [(d, x, y)]
    for below, here, above, vx, vy in zip(low[1:], mid[1:], high, rx[1:], ry[1:]):  # eliminated downwards
        f = below / d
        d, x, y = here - f * above, vx - f * x, vy - f * y
        done.append((d, x, y))
    x, y = x / d, y / d
    back = [(x, y)]
    for (d, vx, vy), above in zip(done[-2::-1], high[-2::-1]):  # and put in upwards
        x, y = (vx - above * x) / d, (vy - above * y) / d
        back.append((x, y))
    m = np.zeros((k, 2))
    m[1:-1] = back[::-1]
    m[0], m[-1] = (1 + a) * m[1] - a * m[2], (1 + b) * m[-2] - b * m[-3]
    t = np.linspace(0, u[-1], n)
    i = np.clip(np.searchsorted(u, t, side="right") - 1, 0, k - 2)
    l, r, hi = (t - u[i])[:, None], (u[i + 1] - t)[:, None], h[i][:, None]
    out = (m[i] * r**3 + m[i + 1] * l**3) / (6 * hi) + (p[i] / hi - m[i] * hi / 6) * r + (p[i + 1] / hi - m[i + 1] * hi / 6) * l
    return [(x, y) for x, y in np.round(out, 9).astype(np.int64).tolist()]


def smoothed_curve(points: list[tuple[int, int]], n: int | None = None, sigma: float = 2.0) -> list[tuple[int, int]]:
    """A traced curve whose y are smoothed (mirrored ends, whole numbers), on a spline of n points, as many as there are by default."""
    if len(points) < 4:
        return points
    y, r = np.array([p[1] for p in points], float), int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    at = (np.arange(len(y))[:, None] + np.arange(-r, r + 1)) % (2 * len(y))
    smooth = (y[np.where(at < len(y), at, 2 * len(y) - 1 - at)] * (taps / taps.sum())).sum(axis=1)
    return spline([(x, int(v)) for (x, _), v in zip(points, np.round(smooth, 9), strict=True)], n or len(points))


def refined(g: np.ndarray, points: list[tuple[int, int]], reach: int = 5) -> list[tuple[int, int]]:
    """Points moved to the darkest pixel above or below (the first of equals from the top); unmoved where all are white."""
    if not points:
        return []
    x, y = np.array(points).T
    near = y[:, None] + np.arange(-reach, reach + 1)
    inside = (near >= 0) & (near < g.shape[0])
    v = np.where(inside, g[np.clip(near, 0, g.shape[0] - 1), x[:, None]], 255)
    k = v.argmin(axis=1)
    rows = np.arange(len(x))
    return list(zip(x.tolist(), np.where(v[rows, k] < 255, near[rows, k], y).tolist(), strict=True))


def for_reading(image: np.ndarray) -> np.ndarray:
    """Enlarged, thresholded, dark on light: what text recognition likes."""
    g = gray(image)
    scale = max(1, 300 // max(1, min(g.shape)))
    if scale > 1:
        g = resized(g, g.shape[0] * scale, g.shape[1] * scale, "cubic")
    mask = 255 - adaptive_mask(bilateral(g))
    return 255 - mask if mask.mean() < 127 else mask


def equalized(g: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: a clipped histogram per tile, blended between tile centres."""
    h, w = g.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(g, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(float)
            limit = max(clip * th * tw / 256, 1)
            over = np.maximum(n - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, limit) + over / 256) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], g]
    return np.clip(np.rint((1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))), 0, 255).astype(np.uint8)


def bilateral(g: np.ndarray, size: int = 9, color: float = 75, space: float = 75) -> np.ndarray:
    """An average over near pixels of like brightness. Two pixels weigh the same for each other, so a weight is looked up once for both."""
    r, (h, w) = size // 2, g.shape
    like = np.exp(-(np.arange(256.0) ** 2) / (2 * color**2)).astype(np.float32)
    p = _padded(g, r, r).astype(np.int16)
    f = p.astype(np.float32)
    top, bottom = f.copy(), np.ones(p.shape, np.float32)
    for dy in range(r + 1):
        for dx in range(-r, r + 1):
            if (dy, dx) <= (0, 0) or dy * dy + dx * dx > r * r:
                continue
            here = (slice(0, p.shape[0] - dy), slice(max(0, -dx), p.shape[1] - max(0, dx)))
            there = (slice(dy, p.shape[0]), slice(max(0, dx), p.shape[1] - max(0, -dx)))
            k = like[np.abs(p[here] - p[there])]
            k *= np.float32(np.exp(-(dy * dy + dx * dx) / (2 * space**2)))
            top[here] += k * f[there]
            bottom[here] += k
            top[there] += k * f[here]
            bottom[there] += k
    inner = (slice(r, r + h), slice(r, r + w))
    return np.rint(top[inner] / bottom[inner]).astype(np.uint8)


def without_watermark(g: np.ndarray, size: int = 50, flat: float = 15, share: float = 0.05) -> np.ndarray:
    """Where much of the equalised image hardly differs from its surroundings, as under a watermark, the image is smoothed within brightness."""
    e = equalized(g)
    off = np.abs(e.astype(np.float64) - box_mean(e, min(size, *g.shape) // 2 * 2 + 1)) < flat
    # the mask's values, not its pixels, are weighed against the share: a fiftieth of a percent is enough
    return bilateral(e) if off.sum() * 255 > share * g.size else e


def drawn(ys: np.ndarray, height: int, width: int, left: int, thick: int = 3) -> np.ndarray:
    """A white image with a black stroke through (left + k, ys[k])."""
    a = np.full((height, width), 255, np.uint8)
    for k, (y, z) in enumerate(zip(ys.tolist(), [*ys[1:].tolist(), int(ys[-1])], strict=True)):
        lo, hi = min(y, z), max(y, z)
        a[max(0, lo - thick // 2) : hi + thick // 2 + 1, left + k] = 0
    return a


def edge_mask(image: np.ndarray) -> np.ndarray:
    """Edges made two pixels wide, for tracing without a threshold."""
    return dilate(edges(gray(image)), 2, 2)


def png(image: np.ndarray) -> bytes:
    """An image as a PNG file."""
    a = image[..., ::-1] if image.ndim == 3 else image
    h, w = a.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
