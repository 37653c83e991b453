"""Connected parts of masks and their outlines as ordered points; polylines with fewer points."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Steps in the eight directions, counter-clockwise as seen, from right on: (dx, dy).
STEPS = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]


def components(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels, areas) of connected parts, 0 for the background; labels in reading order. With ``corners`` pixels that touch at a corner are connected. Runs of pixels are joined, not pixels."""
    h, w = mask.shape
    on = np.zeros((h, w + 2), bool)
    on[:, 1:-1] = mask > 0
    turns = np.flatnonzero(on[:, 1:] != on[:, :-1])
    starts, ends = turns[::2], turns[1::2]  # places in rows of w + 1; runs in reading order
    n = len(starts)
    if not n:
        return np.zeros((h, w), np.int64), np.empty(0, np.int64)
    # runs of the next row that touch a run are successive
    lo, hi = np.searchsorted(ends, starts + w + 1, side="left" if corners else "right"), np.searchsorted(starts, ends + w + 1, side="right" if corners else "left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    label = np.arange(n)
    while True:  # minima over touching runs, then over labels' labels
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, new[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    _, number = np.unique(label, return_inverse=True)
    out = np.zeros(h * w, np.int64)
    row = starts // (w + 1)
    size = ends - starts
    places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts - row, size)
    out[places] = np.repeat(number + 1, size)
    return out.reshape(h, w), np.bincount(number, weights=size).astype(np.int64)


@cache
def _turns() -> list[int]:
    """By 8 x (bits of a pixel's neighbours) + (direction it was reached from, looking back): the first neighbour counter-clockwise of there."""
    return [next((d % 8 for d in range(back + 1, back + 9) if around >> d % 8 & 1), -1) for around in range(256) for back in range(8)]


def outlines(mask: np.ndarray, outside: bool = True) -> list[np.ndarray]:
    """The outer outline of every part (8-connected), in reading order of the parts: its border pixels (x, y) in the order of a walk around it.

    A walk begins at the part's first pixel and goes down its left side first; where a part is one pixel
    wide the walk comes back over the same pixels. With ``outside`` parts within holes of others have none.
    """
    h, w = mask.shape
    on = np.zeros((h + 2, w + 2), np.uint8)
    on[1:-1, 1:-1] = mask > 0
    around = np.zeros_like(on)
    for d, (dx, dy) in enumerate(STEPS):
        around[1:-1, 1:-1] |= on[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] << d
    labels = components(on)[0].ravel()
    filled = np.flatnonzero(labels)
    first = filled[np.unique(labels[filled], return_index=True)[1]]
    if outside and len(first):
        sea = components(1 - on, corners=False)[0].ravel()
        first = first[sea[first - 1] == sea[0]]
    width, near, turn = w + 2, around.ravel().tolist(), _turns()
    offsets = [dy * width + dx for dx, dy in STEPS]
    out = []
    for start in first.tolist():
        # the last pixel of the walk: the first neighbour clockwise from the left
        last = next((d % 8 for d in range(12, 4, -1) if near[start] >> d % 8 & 1), None)
        walk, at, back = [start], start, last
        if last is not None:
            end = start + offsets[last]
            while True:
                d = turn[8 * near[at] + back]
                to = at + offsets[d]
                if to == start and at == end:
                    break
                walk.append(to)
                at, back = to, (d + 4) % 8
        y, x = np.divmod(np.array(walk), width)
        out.append(np.stack([x - 1, y - 1], axis=1))
    return out


def area(points: np.ndarray) -> float:
    """What a closed walk encloses."""
    x, y = points[:, 0].astype(np.float64), points[:, 1].astype(np.float64)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def length(points: np.ndarray, closed: bool = False) -> float:
    p = np.vstack([points, points[:1]]) if closed else points
    return float(np.hypot(*np.diff(p.astype(np.float64), axis=0).T).sum())


def simplified(points: np.ndarray, epsilon: float, closed: bool = False) -> np.ndarray:
    """The points (x, y) that a polyline needs to stay within ``epsilon`` of all of them, in order.

    Between two kept points the one farthest from their line is kept if it is farther than that (the first of equals), and
    both sides are looked at in turn. A closed one is begun at the point farthest from its first, and halved at the point farthest from that.
    """
    p = np.asarray(points, np.float64)
    n = len(p)
    if n < 3:
        return np.asarray(points)
    far = lambda q: int(((p - q) ** 2).sum(axis=1).argmax())
    order = np.arange(n)
    spans = [(0, n - 1)]
    if closed:
        begin = far(p[0])
        order = np.r_[begin:n, 0 : begin + 1]
        half = (far(p[begin]) - begin) % n
        spans = [(0, half), (half, n)]
    p = p[order]
    keep = np.zeros(len(p), bool)
    keep[[e for s in spans for e in s]] = True
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        (dx, dy), rel = p[b] - p[a], p[a + 1 : b] - p[a]
        off, limit = (rel**2).sum(axis=1), epsilon**2
        if dx or dy:
            off, limit = (rel[:, 0] * dy - rel[:, 1] * dx) ** 2, epsilon**2 * (dx * dx + dy * dy)
        k = int(off.argmax())
        if off[k] > limit:
            k += a + 1
            keep[k] = True
            spans += [(a, k), (k, b)]
    kept = np.flatnonzero(keep)
    return np.asarray(points)[order[kept[:-1] if closed else kept]]


def corners(mask: np.ndarray, share: float = 0.02) -> np.ndarray | None:
    """The outline of the largest enclosed area as four corners (top left, top right, bottom right, bottom left), if it has exactly four
    once it is simplified to a share of its perimeter."""
    walks = outlines(mask)
    if not walks:
        return None
    largest = max(walks, key=area)
    four = simplified(largest, share * length(largest, closed=True), closed=True)
    if len(four) != 4:
        return None
    s, d = four.sum(axis=1), four[:, 1] - four[:, 0]
    return four[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]].astype(np.float64)
