"""Images on other grids: separable kernels, affine and projective maps, and values for pixels that are to be painted over."""

from __future__ import annotations

import numpy as np

#: The cubic kernel's slope at distance 1; a fixed value of the usual imaging library.
CUBIC = -0.75


def cubic_weights(t: np.ndarray) -> np.ndarray:
    """Weights of the four samples at -1, 0, 1, 2 around a place at t in [0, 1)."""
    t, a = np.asarray(t, np.float64)[..., None], CUBIC
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    wide = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.concatenate([wide(t + 1), near(t), near(1 - t), wide(2 - t)], axis=-1)


def _matrix(n: int, m: int, kind: str) -> np.ndarray:
    """m x n weights that turn n samples into m; beyond the ends the last sample is repeated."""
    out, rows = np.zeros((m, n)), np.arange(m)
    if kind == "area":  # each new sample is the mean of what it covers
        edge = np.arange(m + 1) * (n / m)
        cover = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(cover, 0) / (n / m)
    at = (rows + 0.5) * (n / m) - 0.5
    low = np.floor(at).astype(int)
    t = at - low
    weights = {"cubic": lambda: cubic_weights(t), "linear": lambda: np.stack([1 - t, t], axis=-1)}[kind]()
    first = -1 if kind == "cubic" else 0
    for k in range(weights.shape[1]):
        np.add.at(out, (rows, np.clip(low + first + k, 0, n - 1)), weights[:, k])
    return out


def _bytes(a: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def rescaled(values: np.ndarray, height: int, width: int, kind: str = "cubic") -> np.ndarray:
    """Values on a grid of another size. kind: cubic, linear, or area (each new one is the mean of what it covers)."""
    down, across = _matrix(values.shape[0], height, kind), _matrix(values.shape[1], width, kind)
    return np.einsum("ih,hw...,jw->ij...", down, values.astype(np.float64), across, optimize=True)


def resized(image: np.ndarray, height: int, width: int, kind: str = "cubic") -> np.ndarray:
    """An image of another size, of whole brightnesses."""
    return _bytes(rescaled(image, height, width, kind))


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, kind: str = "linear", border: int | None = None) -> np.ndarray:
    """The image at places (x, y); beyond its edge its last pixels, or the value ``border``."""
    h, w = image.shape[:2]
    f = image.astype(np.float64)
    if border is not None:
        f = np.pad(f, [(2, 2), (2, 2), *[(0, 0)] * (image.ndim - 2)], constant_values=border)
        x, y, h, w = x + 2, y + 2, h + 4, w + 4
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    reach = range(-1, 3) if kind == "cubic" else range(2)
    wx, wy = (cubic_weights(x - x0), cubic_weights(y - y0)) if kind == "cubic" else (np.stack([1 - (x - x0), x - x0], -1), np.stack([1 - (y - y0), y - y0], -1))
    out = 0.0
    for i, dy in enumerate(reach):
        row = np.clip(y0 + dy, 0, h - 1)
        for j, dx in enumerate(reach):
            weight = wy[..., i] * wx[..., j]
            out = out + (weight[..., None] if image.ndim == 3 else weight) * f[row, np.clip(x0 + dx, 0, w - 1)]
    return _bytes(out)


def rotated(image: np.ndarray, degrees: float, kind: str = "cubic") -> np.ndarray:
    """Turned about its middle on a canvas that holds all of it; the edge is repeated outwards."""
    h, w = image.shape[:2]
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    nw, nh = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    yy, xx = np.mgrid[0:nh, 0:nw]
    return sampled(image, c * (xx - nw / 2) - s * (yy - nh / 2) + w / 2, s * (xx - nw / 2) + c * (yy - nh / 2) + h / 2, kind)


def straightened(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral of four corners (top left, top right, bottom right, bottom left) as a rectangle, by the projective map between them; bilinear, black outside."""
    tl, tr, br, bl = corners
    w, h = int(max(np.hypot(*(br - bl)), np.hypot(*(tr - tl)))), int(max(np.hypot(*(tr - br)), np.hypot(*(tl - bl))))
    target = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    rows, rhs = [], []
    for (u, v), (x, y) in zip(target, corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        rhs += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1).reshape(3, 3)
    vv, uu = np.mgrid[0:h, 0:w]
    z = m[2, 0] * uu + m[2, 1] * vv + 1
    return sampled(image, (m[0, 0] * uu + m[0, 1] * vv + m[0, 2]) / z, (m[1, 0] * uu + m[1, 1] * vv + m[1, 2]) / z, "linear", 0)


#: Pixels of a front whose surroundings are weighed at a time: so many stay near the processor.
AT_ONCE = 512


def painted_over(g: np.ndarray, mask: np.ndarray, radius: int = 3) -> np.ndarray:
    """``g`` with values for the pixels of a mask, from a front that marches in from their edge.

    The front arrives at a pixel when the distance equation says so from the pixels around that it has reached. In order of arrival,
    pixels of one step at once, a pixel gets the mean of the known ones within the radius, weighed by how near they are, how much they lie
    along the front's way, and how near their arrival is; each is continued to the pixel by its own gradient.
    """
    todo = mask > 0
    if not todo.any() or todo.all():
        return g.copy()
    far = 1e6
    pad = radius + 1
    value, known, when = np.pad(np.where(todo, 0.0, g), pad), np.pad(~todo, pad), np.pad(np.where(todo, far, 0.0), pad, constant_values=far)
    w = value.shape[1]
    value, known, when = value.ravel(), known.ravel(), when.ravel()
    waiting = np.pad(todo, pad).ravel()
    inside = np.flatnonzero(waiting | known)
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    reach, vy, vx = np.array([[dy * w + dx] for dy, dx in disc]), *(-np.array(c, np.float64)[:, None] for c in zip(*disc, strict=True))
    size2 = vy * vy + vx * vx
    size, sides = np.sqrt(size2), np.array([-w, -1, 1, w])

    def slope(f: np.ndarray, there: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """The gradient at some pixels, from the neighbours that are there."""
        after, before, here = f[at + step], f[at - step], f[at]
        a, b = there[at + step], there[at - step]
        return np.where(a & b, (after - before) / 2, np.where(a, after - here, np.where(b, here - before, 0)))

    # what is asked of all the pixels around is kept, as it changes beside the front only: gradients, and when a pixel was known, never for the others
    across, down, since = np.zeros(len(value)), np.zeros(len(value)), np.where(known, 0.0, np.inf)
    across[inside], down[inside] = slope(value, known, inside, 1), slope(value, known, inside, w)
    gone, place, left = known.copy(), np.zeros(len(value), np.int64), np.flatnonzero(waiting)
    left = left[known[left + sides[:, None]].any(axis=0)]  # pixels beside what the front has reached; others wait
    waiting[left] = False
    while len(left):
        a, b = np.minimum(when[left - 1], when[left + 1]), np.minimum(when[left - w], when[left + w])
        low, gap = np.minimum(a, b), np.abs(a - b)
        arrival = np.where(gap < 1, (a + b + np.sqrt(np.maximum(2 - gap * gap, 0))) / 2, low + 1)
        front = arrival <= arrival.min() + 0.5
        now, left = left[front], left[~front]
        when[now] = arrival[front]
        gone[now] = True
        tx, ty, made = slope(when, gone, now, 1), slope(when, gone, now, w), np.empty(len(now))
        for s in range(0, len(now), AT_ONCE):
            part = slice(s, s + AT_ONCE)
            near = reach + now[part]
            weight = vx * tx[part]
            weight += vy * ty[part]
            np.maximum(np.abs(weight, out=weight), 1e-6, out=weight)
            weight /= size
            weight /= size2
            late = since.take(near)
            late -= when[now[part]]
            np.abs(late, out=late)
            late += 1
            weight /= late  # 0 for pixels that are not known
            v, shift, more = value.take(near), across.take(near), down.take(near)
            shift *= vx
            more *= vy
            shift += more
            shift += v
            shift *= weight
            high = v.max(axis=0)
            v[weight == 0] = np.inf
            made[part] = np.clip(shift.sum(axis=0) / weight.sum(axis=0), v.min(axis=0), high)
        value[now], known[now], since[now] = made, True, when[now]
        for f, step in ((across, 1), (down, w)):
            beside = np.concatenate([now - step, now, now + step])
            f[beside] = slope(value, known, beside, step)
        beside = (now + sides[:, None]).ravel()
        beside = beside[waiting[beside]]
        place[beside] = count = np.arange(len(beside))
        beside = beside[place[beside] == count]  # each once
        waiting[beside] = False
        left = np.concatenate([left, beside])
    return _bytes(value.reshape(-1, w)[pad:-pad, pad:-pad])
