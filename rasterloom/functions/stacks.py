"""The kernels for many frames at once: pixels of whole frames side by side, told apart by `own`, the frame of each."""

from __future__ import annotations

import math

import numpy as np

from . import kernels as K


class Stack:
    """Frames of any size as flat pixels, frame by frame in raster order; on a canvas they lie one below the other, a row apart."""

    def __init__(self, own: np.ndarray, y: np.ndarray, x: np.ndarray):
        self.own, self.first = own, np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        self.n, self.size = len(self.first), np.diff(np.append(self.first, len(own)))
        self.top, self.left = np.minimum.reduceat(y, self.first), np.minimum.reduceat(x, self.first)
        self.y, self.x = y - self.top[own], x - self.left[own]
        self.height, self.width = (np.maximum.reduceat(v, self.first) + 1 for v in (self.y, self.x))
        self.base = np.concatenate([[0], np.cumsum(self.height + 1)])

    def by_size(self, v: np.ndarray):
        """Frames of one size at a time: (which frames, their values as (frames, height, width), which pixels, (frame, y, x) of these in the array). What a frame lacks is 0."""
        sizes, group = np.unique(np.stack([self.height, self.width]), axis=1, return_inverse=True)
        for k in range(sizes.shape[1]):
            at = np.flatnonzero(group.ravel() == k)
            place = np.full(self.n, -1)
            place[at] = np.arange(len(at))
            some = np.flatnonzero(place[self.own] >= 0)
            where = place[self.own[some]], self.y[some], self.x[some]
            a = np.zeros((len(at), *sizes[:, k]))
            a[where] = v[some]
            yield at, a, some, where

    def label(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(component of each pixel that is on, numbered from 0 through all frames; frame of each component)."""
        wide = int(self.width.max())
        at = (self.base[self.own] + self.y)[on] * wide + self.x[on]
        canvas = np.zeros(int(self.base[-1]) * wide, bool)
        canvas[at] = True
        number = K.label(canvas.reshape(-1, wide)).ravel()[at] - 1
        own = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
        own[number] = self.own[on]
        return number, own

    def otsu(self, v: np.ndarray) -> np.ndarray:
        """Each frame's Otsu threshold."""
        return _otsu_rows(v.reshape(self.n, -1)) if (self.size == self.size[0]).all() else otsu_of(v, self.own, self.n)

    def segmented(self, v: np.ndarray) -> np.ndarray:
        """Pixels above their frame's threshold; those not above it where they'd be half of all or more."""
        on = v > self.otsu(v)[self.own]
        return on != (2 * np.bincount(self.own[on], minlength=self.n) >= self.size)[self.own]

    def features(self, on: np.ndarray) -> dict[str, np.ndarray]:
        """By frame: components, area, and how far boxes' widths and heights and the areas spread."""
        number, own = self.label(on)
        x, y, m = self.x[on], self.y[on], len(own)
        area = np.bincount(number, minlength=m)
        ends = np.zeros((4, m))
        ends[0], ends[2] = np.inf, np.inf
        for k, v in ((0, x), (2, y)):
            np.minimum.at(ends[k], number, v)
            np.maximum.at(ends[k + 1], number, v)
        n = np.bincount(own, minlength=self.n)

        def spread(v):
            mean = np.bincount(own, v, self.n) / np.maximum(n, 1)
            return np.sqrt(np.bincount(own, (v - mean[own]) ** 2, self.n) / np.maximum(n, 1)).round(9)  # so that equal ones rank equal

        return {"components": n, "area": np.bincount(own, area, self.n).astype(np.int64), "width_spread": spread(ends[1] - ends[0]), "height_spread": spread(ends[3] - ends[2]), "area_spread": spread(area)}


def otsu_of(v: np.ndarray, own: np.ndarray, n: int, bins: int = 256) -> np.ndarray:
    """Threshold of greatest variance between classes for each of n groups, a bin's middle, the first of equals; the value itself where there is only one, NaN without any."""
    low, high = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(low, own, v)
    np.maximum.at(high, own, v)
    out = np.where(low <= high, low, np.nan)
    some = np.flatnonzero(high > low)
    step = 1 << 12  # groups whose histograms are held at once
    place = np.full(n, -1)
    place[some] = np.arange(len(some))
    p = place[own]
    for a in range(0, len(some), step):
        g = some[a : a + step]
        here = (p >= a) & (p < a + step) if len(some) > step else p >= 0
        w, q = v[here], p[here] - a
        lo, span = low[g], high[g] - low[g]
        with np.errstate(over="ignore", invalid="ignore"):
            b = np.minimum(np.nan_to_num(np.floor((w - lo[q]) * bins / span[q])), bins - 1).astype(np.int64)
        count = np.bincount(q * bins + b, minlength=len(g) * bins).reshape(-1, bins)
        mid = lo[:, None] + (np.arange(bins) + 0.5) * span[:, None] / bins
        w1, s1 = count.cumsum(1), (count * mid).cumsum(1)
        w2, s2 = w1[:, -1:] - w1, s1[:, -1:] - s1
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.where((w1 > 0) & (w2 > 0), w1 * w2 * (s1 / w1 - s2 / w2) ** 2, -1.0)
        # Bins without pixels have the variance of the bin before them but for rounding.
        out[g] = np.take_along_axis(mid, np.where(count > 0, var, -1.0).argmax(1)[:, None], 1)[:, 0]
    return out


def _otsu_rows(v: np.ndarray, bins: int = 256) -> np.ndarray:
    """The same of each row."""
    n, size = v.shape
    if size > bins:
        return otsu_of(v.ravel(), np.repeat(np.arange(n), size), n, bins)
    # With no more pixels than bins the filled bins alone are gone through, in order.
    low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
    span = np.where(high > low, high - low, 1.0)
    b = np.sort(np.minimum(np.floor((v - low) * bins / span), bins - 1), 1)
    mid = low + (b + 0.5) * span / bins
    s1, w1 = mid.cumsum(1), np.arange(1.0, size + 1)
    w2, s2 = np.maximum(w1[-1] - w1, 1), s1[:, -1:] - s1
    var = w1 * w2 * (s1 / w1 - s2 / w2) ** 2
    var[:, :-1][b[:, :-1] == b[:, 1:]] = -1.0
    var[:, -1] = -1.0
    return np.where(high > low, np.take_along_axis(mid, var.argmax(1)[:, None], 1), low)[:, 0]


# -- frames of one size, as an array (frames, height, width) ----------------------------------------------------------------


def largest(a: np.ndarray) -> np.ndarray:
    """The largest component of each frame; of equals the first in raster order."""
    n, h, w = a.shape
    labels = K.label(np.pad(a, ((0, 0), (0, 1), (0, 0))).reshape(-1, w)).reshape(n, h + 1, w)[:, :h]
    size = np.bincount(labels.ravel())
    size[0] = 0
    best = np.zeros(n, np.int64)
    own = np.zeros(len(size), np.int64)
    f, y, x = a.nonzero()
    own[labels[f, y, x]] = f
    order = np.lexsort((-np.arange(len(size)), size))  # the last that is written is the largest, and the first of equals
    order = order[size[order] > 0]
    best[own[order]] = order
    return (labels == best[:, None, None]) & a


def outline_lengths(a: np.ndarray) -> np.ndarray:
    """Length of the closed path along each frame's first component's outer border."""
    n, h, w = a.shape
    pad = np.pad(a, ((0, 0), (1, 1), (1, 1)))
    flat, wide = pad.ravel(), w + 2
    start = pad.reshape(n, -1).argmax(1) + np.arange(n) * pad[0].size
    some = flat[start]
    step = np.array([dy * wide + dx for dy, dx in K._RING])
    length = np.array([1.0, math.sqrt(2)])
    out = np.zeros(n)
    live = np.flatnonzero(some)
    here, back, first = start[live], np.full(len(live), 4), np.full(len(live), -1)
    while len(live):
        turn = (back[:, None] + np.arange(1, 9)) % 8
        open_ = flat[here[:, None] + step[turn]]
        k = open_.argmax(1)
        d = turn[np.arange(len(k)), k]
        done = ~open_.any(1) | ((here == start[live]) & (d == first))
        first = np.where((here == start[live]) & (first < 0), d, first)
        stay = ~done
        live, here, d, first = live[stay], here[stay], d[stay], first[stay]
        out[live] += length[d % 2]
        here, back = here + step[d], (d + 4) % 8
    return out


def above_otsu(a: np.ndarray) -> np.ndarray:
    n = len(a)
    return a > _otsu_rows(a.reshape(n, -1)).reshape(n, 1, 1)


def rolling_otsu(a: np.ndarray, size: int = 10) -> np.ndarray:
    """Pixels above the Otsu thresholds of more than half of the windows over them; windows overlap by half, flat ones have nothing."""
    half = size // 2
    places = [np.floor(np.linspace(half, n - half, max(math.ceil(n / half) - 1, 1))).astype(int) for n in a.shape[1:]]
    votes, count = np.zeros(a.shape), np.zeros(a.shape)
    for y in places[0]:
        for x in places[1]:
            window = (slice(None), slice(max(y - half, 0), y + half), slice(max(x - half, 0), x + half))
            v = a[window]
            count[window] += 1
            votes[window] += above_otsu(v) & ((v.max((1, 2)) > 0) & (np.ptp(v, (1, 2)) > 0.5))[:, None, None]
    return votes > 0.5 * count
