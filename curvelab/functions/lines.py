"""Lines through most of a group's points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Different points of a group whose pairs make the lines that are tried; what their choice by hash begins with.
SAMPLE, SEED = 64, "robust-1"


def pairs(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, slope, intercept) of the lines through two points of different x; points are in the order of x, y."""
    i, j = np.triu_indices(len(px), 1)
    i, j = i[px[i] != px[j]], j[px[i] != px[j]]
    slope = (py[j] - py[i]) / (px[j] - px[i])
    return i, j, slope, py[i] - slope * px[i]


def sums_near(slope: np.ndarray, cut: np.ndarray, x: np.ndarray, y: np.ndarray, terms: np.ndarray, residual: float) -> Iterator[np.ndarray]:
    """For some lines at a time, the sums of ``terms`` (a row a point) over the points within ``residual`` of each."""
    step = max(1, 2_000_000 // max(len(x), 1))
    for s in range(0, len(slope), step):
        yield (np.abs(y[None, :] - (slope[s : s + step, None] * x[None, :] + cut[s : s + step, None])) <= residual) @ terms


def _counter(dx: np.ndarray, dy: np.ndarray, m: np.ndarray, width: float):
    """For lines through the point that ``dx`` and ``dy`` are taken from: a function of slopes that gives how many points lie within ``width`` of each, and
    what tells the same points apart. A point is near for slopes from one to another; the ends are sorted once for all lines."""
    aside = dx != 0
    ends = (dy[aside] + np.array([[-width], [width]])) / dx[aside]
    low, high, m_aside = ends.min(axis=0), ends.max(axis=0), m[aside]
    by_low, by_high = np.argsort(low), np.argsort(high)
    low, high = low[by_low], high[by_high]
    begun, ended = (np.concatenate(([0], np.cumsum(m_aside[o]))) for o in (by_low, by_high))
    upright = m[~aside][np.abs(dy[~aside]) <= width].sum()

    def of(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(low, slope, side="right"), np.searchsorted(high, slope, side="left")
        return upright + begun[a] - ended[b], a, b

    return of


def best_line(x: np.ndarray, y: np.ndarray, m: np.ndarray, residual: float, first: int = 0, last: int | None = None) -> tuple | None:
    """(inliers, r2, i, j, slope, intercept, the line's own slope, its own cut) of the line with most points within ``residual`` (of equals the one that fits its points
    best, then the first) through a point i of [first, last) and any j after it; None without two different x. The last but two are fitted to the inliers.

    Points are different, in the order of x, y, each there m times. All pairs are tried: for a point i the others' slopes are sorted, so a line's points are counted by
    looking its slope up. Bounds that allow for rounding say which lines can be best; those are counted by the distances themselves.
    """
    best, most, known = None, 0, set()
    top, far = np.abs(y).max(initial=0), np.abs(x).max(initial=0)
    for i in range(first, len(x) if last is None else last):
        after = np.flatnonzero(x[i + 1 :] != x[i]) + i + 1
        if not len(after):
            continue
        slope = (y[after] - y[i]) / (x[after] - x[i])
        blur = 1e-13 * (top + np.abs(slope) * far)  # what rounding can do to a distance
        steep = blur > 1e-3 * residual  # such lines are counted one by one
        j, s = after[~steep], slope[~steep]
        tried = list(zip(after[steep].tolist(), slope[steep].tolist(), strict=True))
        if len(j):
            dx, dy, wide = x - x[i], y - y[i], blur[~steep].max()
            at_most = _counter(dx, dy, m, residual + wide)
            up, a, b = at_most(s)
            k = int(up.argmax())
            most = max(most, int(m[np.abs(y - (s[k] * x + (y[i] - s[k] * x[i]))) <= residual].sum()))
            fine = up >= most
            j, s, up, a, b = j[fine], s[fine], up[fine], a[fine], b[fine]
            if len(j) > 1:
                sure = _counter(dx, dy, m, residual - wide)(s)[0] == up
                _, one = np.unique(np.where(sure, a * (len(x) + 1) + b, -1 - np.arange(len(j))), return_index=True)  # of lines with the same points the first
                j, s = j[np.sort(one)], s[np.sort(one)]
            tried += zip(j.tolist(), s.tolist(), strict=True)
        for k, v in sorted(tried):
            cut = y[i] - v * x[i]
            if (v, cut) in known:  # the same line, through points before these
                continue
            near = np.abs(y - (v * x + cut)) <= residual
            n = int(m[near].sum())
            if n < most:
                continue
            most = n
            known.add((v, cut))
            w, px, py = m[near], x[near], y[near]
            mx, my = (w * px).sum() / n, (w * py).sum() / n
            sxx, sxy, syy = (w * (px - mx) ** 2).sum(), (w * (px - mx) * (py - my)).sum(), (w * (py - my) ** 2).sum()
            if sxx <= 1e-12:
                continue
            rest = max(syy - sxy * sxy / sxx, 0.0)
            r2 = 1 - rest / syy if syy > 1e-12 else float(rest <= 1e-12)
            found = (n, round(float(r2), 9), -i, -k, float(sxy / sxx), float(my - sxy / sxx * mx), float(v), float(cut))
            best = found if best is None or found[:4] > best[:4] else best
    return None if best is None else (*best[:2], -best[2], -best[3], *best[4:])


def robust_inliers(x: np.ndarray, y: np.ndarray, residual: float) -> np.ndarray:
    """Which points lie within ``residual`` of the line through two of them that most lie near (of equals the one that fits them best, then the first); every pair is tried."""
    points, m = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    best = best_line(*points.T, m, residual)
    if best is None:
        return np.zeros(len(x), bool)
    return np.abs(y - (best[6] * x + best[7])) <= residual
