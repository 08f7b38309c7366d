"""NumPy kernels for what relational operators can't say: connectivity, outlines, distances, thinning, filters.

All take and return small 2-D arrays; operators run them per frame inside Arrow-batched groups.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

CROSS = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]], bool)
SQUARE = np.ones((3, 3), bool)


def disk(radius: int) -> np.ndarray:
    y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
    return y * y + x * x <= radius * radius


def _slices(n: int, d: int) -> tuple[slice, slice]:
    return (slice(max(d, 0), n + min(d, 0)), slice(max(-d, 0), n + min(-d, 0)))


def _spread(a: np.ndarray, shape: np.ndarray, outside: bool, all_: bool) -> np.ndarray:
    cy, cx = shape.shape[0] // 2, shape.shape[1] // 2
    out = np.full(a.shape, all_)
    for dy, dx in np.argwhere(shape) - (cy, cx):
        moved = np.full(a.shape, outside)
        (sy, ty), (sx, tx) = _slices(a.shape[0], dy), _slices(a.shape[1], dx)
        if sy.start < sy.stop and sx.start < sx.stop:
            moved[ty, tx] = a[sy, sx]
        out = out & moved if all_ else out | moved
    return out


def dilate(a: np.ndarray, shape: np.ndarray = CROSS, times: int = 1) -> np.ndarray:
    for _ in range(times):
        a = _spread(a.astype(bool), shape, False, False)
    return a


def erode(a: np.ndarray, shape: np.ndarray = CROSS, times: int = 1, border: bool = True) -> np.ndarray:
    """border: what lies beyond the edge counts as foreground."""
    for _ in range(times):
        a = _spread(a.astype(bool), shape, border, True)
    return a


def label(a: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Components numbered 1.. in raster order of their first pixels; 0 is background."""
    a = a.astype(bool)
    h, w = a.shape
    if not a.any():
        return np.zeros((h, w), np.int64)
    number = np.zeros((h, w), np.int64)
    number[a] = np.arange(int(a.sum()))
    parent = number[a]
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    left, right = [], []
    for dy, dx in steps:
        (sy, ty), (sx, tx) = _slices(h, dy), _slices(w, dx)
        both = a[sy, sx] & a[ty, tx]
        left.append(number[sy, sx][both])
        right.append(number[ty, tx][both])
    p, q = np.concatenate(left), np.concatenate(right)
    while len(p):  # hook larger roots to smaller ones, then shorten
        rp, rq = parent[p], parent[q]
        open_ = rp != rq
        p, q, rp, rq = p[open_], q[open_], rp[open_], rq[open_]
        np.minimum.at(parent, np.maximum(rp, rq), np.minimum(rp, rq))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    out = np.zeros((h, w), np.int64)  # a root is its component's first pixel
    out[a] = np.cumsum(parent == np.arange(len(parent)))[parent]
    return out


def sizes(labels: np.ndarray) -> np.ndarray:
    return np.bincount(labels.ravel())


def largest(a: np.ndarray) -> np.ndarray:
    """The largest 8-connected component; of equals the first in raster order."""
    n = label(a)
    s = sizes(n)
    if len(s) < 2:
        return np.zeros(a.shape, bool)
    s[0] = 0
    return n == int(s.argmax())


def by_size(a: np.ndarray) -> np.ndarray:
    """Components numbered from the largest on; of equals the later in raster order comes first."""
    n = label(a)
    s = sizes(n)
    order = np.argsort(s[1:], kind="stable")[::-1] + 1
    rank = np.zeros(len(s), np.int64)
    rank[order] = np.arange(1, len(s))
    return rank[n]


def touching(a: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Components that share a pixel with the reference."""
    n = label(a)
    hit = np.unique(n[ref.astype(bool)])
    return np.isin(n, hit[hit > 0])


def holes(a: np.ndarray, connectivity: int = 4) -> np.ndarray:
    """Background components that don't reach the edge."""
    n = label(~a.astype(bool), connectivity)
    edge = np.unique(np.concatenate([n[0], n[-1], n[:, 0], n[:, -1]]))
    return (n > 0) & ~np.isin(n, edge)


def close_holes(a: np.ndarray) -> np.ndarray:
    return a.astype(bool) | holes(a, 8)


def euler(a: np.ndarray) -> int:
    """Components minus outlines, inner ones included: minus the number of holes."""
    return -(int(label(holes(a)).max()) if a.any() else 0)


def outline(a: np.ndarray) -> np.ndarray:
    return a.astype(bool) & ~erode(a, CROSS, border=False)


_RING = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def trace(a: np.ndarray) -> np.ndarray:
    """Outer border of the first component in raster order, as (y, x) points in order, clockwise."""
    pad = np.pad(a.astype(bool), 1)
    points = np.argwhere(pad)
    if not len(points):
        return np.zeros((0, 2), np.int64)
    start = tuple(points[0])
    here, back = start, 4  # the pixel to the left is background
    path, first = [start], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            there = (here[0] + _RING[d][0], here[1] + _RING[d][1])
            if pad[there]:
                break
        else:
            break
        if here == start:
            if first is None:
                first = d
            elif d == first:
                path.pop()
                break
        path.append(there)
        here, back = there, (d + 4) % 8
    return np.array(path) - 1


def closed_length(points: np.ndarray) -> float:
    if len(points) < 2:
        return 0.0
    return float(np.sqrt(((points - np.roll(points, -1, 0)) ** 2).sum(1)).sum())


def polygon_area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, without points on its edges."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def half(seq):
        out: list = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_box(points: np.ndarray) -> tuple[float, float]:
    """Sides of the rotated rectangle of least area round a hull."""
    h = points.astype(float)
    if len(h) < 3:
        return (float(np.ptp(h, 0).max()) if len(h) else 0.0, 0.0)
    best = (math.inf, 0.0, 0.0)
    for a, b in zip(h, np.roll(h, -1, 0)):
        d = (b - a) / np.hypot(*(b - a))
        u, v = h @ d, h @ np.array([-d[1], d[0]])
        best = min(best, (np.ptp(u) * np.ptp(v), np.ptp(u), np.ptp(v)))
    return best[1], best[2]


def distance(a: np.ndarray) -> np.ndarray:
    """Euclidean distance of each foreground pixel to the nearest background pixel, in two passes of minima."""
    a = a.astype(bool)
    h, w = a.shape
    far = float(h + w)
    g = np.where(a, far, 0.0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    x = np.arange(w)
    gap = (x[:, None] - x[None, :]) ** 2
    return np.sqrt(np.stack([(gap + row[None, :] ** 2).min(1) for row in g])) * a


def distance_field(a: np.ndarray, most: float | None = None) -> np.ndarray:
    """Grows towards the shape: most minus the distance to it, 0 from `most` on; the shape itself has the most."""
    d = distance(~a.astype(bool)) if a.any() else np.full(a.shape, float(sum(a.shape)))
    top = float(d.max()) if most is None else float(most)
    return np.where(d >= top, 0.0, top - d)


def ring_field(a: np.ndarray, most: int) -> np.ndarray:
    """The same with rounds of cross dilation in place of distances."""
    out, now = np.zeros(a.shape, np.int64), a.astype(bool)
    for k in range(most, 0, -1):
        grown = dilate(now)
        out[grown & ~now] = k
        now = grown
    return out


def line(a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
    """Pixels of a straight line, both ends included."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    t = np.arange(n + 1) / max(n, 1)
    return np.column_stack([np.floor(a[0] + (b[0] - a[0]) * t + 0.5), np.floor(a[1] + (b[1] - a[1]) * t + 0.5)]).astype(np.int64)


def sun(a: np.ndarray, reach: float = 4.0) -> np.ndarray:
    """Numbered rays from the outline of a shape outwards, away from its centre."""
    out = np.zeros(a.shape, np.int64)
    points = trace(a)
    if not len(points):
        return out
    c = np.argwhere(a).mean(0)
    radius = math.sqrt(a.sum() / math.pi) * reach
    for k, p in enumerate(points, 1):
        d = p - c
        far = p + d / max(np.hypot(*d), 1e-9) * radius
        ray = line(tuple(p), tuple(np.rint(far).astype(int)))
        ray = ray[(ray >= 0).all(1) & (ray < a.shape).all(1)]
        out[ray[:, 0], ray[:, 1]] = k
    return out


# -- filters ----------------------------------------------------------------


def convolve(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    """2-D correlation with mirrored edges, of one frame or an array of them."""
    py, px = k.shape[0] // 2, k.shape[1] // 2
    p = np.pad(a.astype(float), [(0, 0)] * (a.ndim - 2) + [(py, py), (px, px)], mode="symmetric")
    out = np.zeros(a.shape)
    for i, j in np.ndindex(k.shape):
        if k[i, j]:
            out += k[i, j] * p[..., i : i + a.shape[-2], j : j + a.shape[-1]]
    return out


def gaussian_1d(sigma: float, order: int = 0) -> np.ndarray:
    r = max(int(4 * sigma + 0.5), 1)
    x = np.arange(-r, r + 1)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    if order == 1:
        return -x / sigma**2 * g
    if order == 2:
        return (x**2 / sigma**4 - 1 / sigma**2) * g
    return g


@lru_cache(maxsize=256)
def _along(n: int, sigma: float, order: int) -> np.ndarray:
    """The 1-D filter on columns of n pixels as a matrix."""
    return convolve(np.eye(n), gaussian_1d(sigma, order)[::-1, None])


def gaussian(a: np.ndarray, sigma: float, order: tuple[int, int] = (0, 0)) -> np.ndarray:
    if max(a.shape[-2:]) <= 128:
        return _along(a.shape[-2], float(sigma), order[0]) @ a @ _along(a.shape[-1], float(sigma), order[1]).T
    return convolve(convolve(a, gaussian_1d(sigma, order[0])[::-1, None]), gaussian_1d(sigma, order[1])[None, ::-1])


def median(a: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    p = np.pad(a.astype(float), [(0, 0)] * (a.ndim - 2) + [(r, r)] * 2, mode="symmetric")
    return np.median(np.stack([p[..., i : i + a.shape[-2], j : j + a.shape[-1]] for i in range(size) for j in range(size)]), 0)


def butterworth(a: np.ndarray, cutoff: float = 0.005, order: float = 2.0) -> np.ndarray:
    """High-pass in the frequency domain."""
    fy, fx = np.fft.fftfreq(a.shape[-2])[:, None], np.fft.rfftfreq(a.shape[-1])[None, :]
    q = (np.hypot(fy, fx) / max(cutoff, 1e-9)) ** (2 * order)
    return np.fft.irfft2(np.fft.rfft2(a) * (q / (1 + q)), s=a.shape[-2:])


def hessian(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the scale-normalised second derivatives, by size of their amounts.

    First derivatives are taken twice at sigma over root 2, so that what is flat gives 0 at any scale.
    """
    half = sigma / math.sqrt(2)
    dy, dx = gaussian(a, half, (1, 0)), gaussian(a, half, (0, 1))
    yy, xx, yx = (gaussian(d, half, o) * sigma**2 for d, o in ((dy, (1, 0)), (dx, (0, 1)), (dy, (0, 1))))
    mid, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
    low, high = mid - root, mid + root
    turned = np.abs(low) > np.abs(high)
    return np.where(turned, high, low), np.where(turned, low, high)


def frangi(a: np.ndarray, sigmas, beta: float = 1.0, gamma: float | None = 1.0, black: bool = True) -> np.ndarray:
    out = np.zeros(a.shape)
    for s in sigmas:
        small, big = hessian(a if black else -a.astype(float), s)
        ratio = (small / np.where(big == 0, 1e-10, big)) ** 2
        power = small**2 + big**2
        g = gamma if gamma else np.maximum(np.sqrt(power.max((-2, -1), keepdims=True)) / 2, 1e-10)
        v = np.exp(-ratio / (2 * beta**2)) * (1 - np.exp(-power / (2 * g**2)))
        out = np.maximum(out, np.where(big > 0, v, 0.0))
    return out


def sato(a: np.ndarray, sigmas, black: bool = True) -> np.ndarray:
    out = np.zeros(a.shape)
    for s in sigmas:
        e = np.maximum(*hessian(a if black else -a.astype(float), s))
        out = np.maximum(out, np.maximum(e, 0))
    return out


def meijering(a: np.ndarray, sigmas, black: bool = True) -> np.ndarray:
    out = np.zeros(a.shape)
    for s in sigmas:
        small, big = hessian(a if black else -a.astype(float), s)
        v = np.maximum(big - small / 3, 0)
        top = v.max((-2, -1), keepdims=True)
        out = np.maximum(out, v / np.where(top > 0, top, 1.0))
    return out


# Gradient stencils.
STENCILS = {
    "Sobel": np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]]) / 4,
    "Scharr": np.array([[3, 10, 3], [0, 0, 0], [-3, -10, -3]]) / 16,
    "Prewitt": np.array([[1, 1, 1], [0, 0, 0], [-1, -1, -1]]) / 3,
    "Farid": np.outer([0.109604, 0.276691, 0.0, -0.276691, -0.109604], [0.030320, 0.249724, 0.439911, 0.249724, 0.030320]),
}


def edges(a: np.ndarray, name: str) -> np.ndarray:
    """Gradient amount by a pair of stencils."""
    if name == "Roberts":
        u, v = convolve(a, np.array([[0, 0, 0], [0, 1, 0], [0, 0, -1]])), convolve(a, np.array([[0, 0, 0], [0, 0, 1], [0, -1, 0]]))
    else:
        u, v = convolve(a, STENCILS[name]), convolve(a, STENCILS[name].T)
    return np.sqrt((u * u + v * v) / 2)


def apply_filter(a: np.ndarray, name: str, p: float = 1.0, q: float | None = None) -> np.ndarray:
    """Filters by name, of one frame or an array of them; p and q are sigma, or the first and last of three sigmas, or cutoff and order. No name: unfiltered."""
    if not name:
        return a.astype(float)
    sigmas = np.linspace(p, q if q is not None else p, 3)
    if name == "Gaussian":
        return gaussian(a, p)
    if name == "Median":
        return median(a, max(int(p) | 1, 3))
    if name == "Butterworth":
        return butterworth(a, p, q or 2.0)
    if name in ("Frangi", "Sato", "Meijering"):
        return {"Frangi": frangi, "Sato": sato, "Meijering": meijering}[name](a, sigmas)
    if name == "Hessian":
        v = frangi(a, sigmas)
        return np.where(v <= 0, 1.0, v)
    if name == "Laplace":
        return convolve(a, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]]))
    if name == "Sharpen":
        return convolve(a, np.array([[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]]))
    if name == "Mexican hat":
        return -(gaussian(a, p, (2, 0)) + gaussian(a, p, (0, 2)))
    if name in STENCILS or name == "Roberts":
        return edges(a, name)
    raise ValueError(f"no such filter: {name}")


FILTERS = ("Gaussian", "Median", "Butterworth", "Frangi", "Sato", "Meijering", "Hessian", "Laplace", "Sharpen", "Mexican hat", "Farid", "Prewitt", "Roberts", "Scharr", "Sobel")


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Threshold of greatest variance between classes, a bin's middle."""
    v = np.asarray(values, float).ravel()
    low, high = v.min(), v.max()
    if low == high:
        return float(low)
    n, edge = np.histogram(v, bins, (low, high))
    mid = (edge[:-1] + edge[1:]) / 2
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * mid) / np.maximum(w1, 1), (np.cumsum((n * mid)[::-1]) / np.maximum(w2[::-1], 1))[::-1]
    return float(mid[int((w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2).argmax())])


def rolling_otsu(a: np.ndarray, size: int = 10) -> np.ndarray:
    """Pixels above the Otsu thresholds of more than half of the windows over them; windows overlap by half, flat ones have nothing."""
    half = size // 2
    places = [np.floor(np.linspace(half, n - half, max(math.ceil(n / half) - 1, 1))).astype(int) for n in a.shape]
    votes, count = np.zeros(a.shape), np.zeros(a.shape)
    for y in places[0]:
        for x in places[1]:
            window = (slice(max(y - half, 0), y + half), slice(max(x - half, 0), x + half))
            v = a[window]
            count[window] += 1
            if v.max() > 0 and np.ptp(v) > 0.5:
                votes[window] += v > otsu(v)
    return votes > 0.5 * count


# -- skeletons ----------------------------------------------------------------


def _removable() -> np.ndarray:
    """By the code of a pixel's ring: whether taking it away keeps the shape's connections, and it isn't a tip."""
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1
    off = 1 - ring
    # Rising steps of the background over the four sides, counted so that a corner alone doesn't part it.
    turns = sum(off[:, k] - off[:, k] * off[:, (k + 1) % 8] * off[:, (k + 2) % 8] for k in (0, 2, 4, 6))
    return (turns == 1) & (ring.sum(1) > 1)


_REMOVABLE = _removable()


def skeleton(a: np.ndarray) -> np.ndarray:
    """Thinning from the four sides in turn until nothing goes.

    Pixels go in four fields that hold no two neighbours, so each is judged as if it went alone and the
    shape stays connected as it was.
    """
    s = np.pad(a.astype(bool), 1)
    inner = s[1:-1, 1:-1]
    moved = lambda d: s[1 + d[0] : s.shape[0] - 1 + d[0], 1 + d[1] : s.shape[1] - 1 + d[1]]
    y, x = np.indices(a.shape)
    while True:
        before = int(inner.sum())
        for side in (6, 2, 4, 0):  # up, down, left, right in ring order
            open_ = inner & ~moved(_RING[side])
            for field in range(4):
                code = sum(moved(d).astype(np.int64) << k for k, d in enumerate(_RING))
                inner[open_ & _REMOVABLE[code] & (y % 2 * 2 + x % 2 == field)] = False
        if int(inner.sum()) == before:
            return inner.copy()


def neighbours(a: np.ndarray, connectivity: int = 8) -> np.ndarray:
    p = np.pad(a.astype(int), 1)
    steps = _RING if connectivity == 8 else _RING[::2]
    return sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy, dx in steps) * a.astype(int)


def fill_small_loops(s: np.ndarray) -> np.ndarray:
    """Fills one-pixel loops and thins again."""
    gap = (neighbours(~s) == 0) & ~s if s.any() else np.zeros(s.shape, bool)
    p = np.pad(s.astype(int), 1)
    four = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy, dx in _RING[::2])
    gap |= ~s & (four == 4)
    return skeleton(s | gap) if gap.any() else s
