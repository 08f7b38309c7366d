"""Search for the colour combination or filter that segments an image best: all candidates side by side, then ranked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions import kernels as K
from ..functions.stacks import Stack
from ..operators import filters, frames

LOW = ("components", "width_spread", "height_spread", "area_spread")
HIGH = ("area",)


def channels(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, v): the plain sum and every single channel of every space of a pixel, in the order of the candidates."""
    s = color.spaces(F.col("b"), F.col("g"), F.col("r"))
    values = [F.col("b") + F.col("g") + F.col("r")] + [c for name in color.SPACES for c in s[name]]
    return df.select(*keys, "y", "x", F.array(*[v.cast("short") for v in values]).alias("v"))


_FEATURES = "candidate int, components long, area long, width_spread double, height_spread double, area_spread double"


def _rows(stack: Stack, candidate: int, on: np.ndarray):
    """(frames, candidate, features) of those that have any component."""
    f = stack.features(on)
    some = np.flatnonzero(f["components"])
    return some, np.full(len(some), candidate), *(f[n.split()[0]][some] for n in _FEATURES.split(", ")[1:])


def channel_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, candidate, components, area, spreads) of every channel's Otsu segmentation: all candidates of a frame where its pixels are, which are shuffled once."""

    def kernel(stack, values):
        for c, v in enumerate(values):
            yield _rows(stack, c, stack.segmented(v))

    return frames.run_stacks(channels(df, keys), keys, "v", kernel, _FEATURES)


def rank(features: DataFrame, keys: Sequence[str], k: int = 20, most_area: float | None = None) -> DataFrame:
    fair = filters.fair_candidates(features, most_area=most_area)
    return filters.best_candidates(filters.score_candidates(fair, LOW, HIGH, keys), keys, k)


def search_channels(df: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """The k best single-channel candidates by image: (keys, candidate, features, score, place)."""
    return rank(channel_features(df, keys), keys, k)


def filter_features(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """(keys, candidate, components, area, spreads) of the Otsu segmentation under every filter of the grid, and without any (candidate -1): a frame's pixels are shuffled once for all of them."""
    grid = [(-1, ("", None, None)), *enumerate(filters.filter_grid())]

    def kernel(stack, v):
        parts, done = list(stack.by_size(v)), {}
        for c, (name, p, q) in grid:
            own = (name, None, None) if name == "Laplace" else (name, p, q)  # its size changes nothing
            if own not in done:
                out = np.empty(len(v))
                for _, a, some, where in parts:
                    out[some] = filters.rescaled(K.apply_filter(a, name, 1.0 if p is None else p, q))[where]
                kept = stack.features(stack.segmented(out))
                done = done if name != "Laplace" else {own: kept}
            else:
                kept = done[own]
            some = np.flatnonzero(kept["components"])
            yield some, np.full(len(some), c), *(kept[n.split()[0]][some] for n in _FEATURES.split(", ")[1:])

    return frames.run_stacks(df, keys, value, kernel, _FEATURES)


def search_filters(df: DataFrame, keys: Sequence[str], k: int = 20, most_area: float | None = None) -> DataFrame:
    """The k best filters by image: (keys, candidate, features, score, place); candidate is a place in `filters.filter_grid`."""
    return rank(filter_features(df, keys), keys, k, most_area)


AND, OR = 100, 101


def search_logical(df: DataFrame, keys: Sequence[str], best: DataFrame) -> DataFrame:
    """And and Or of an image's two best candidates, with their features: candidate 100 is And, 101 is Or."""
    top = best.where("place <= 2").groupBy(*keys).agg(F.collect_list("candidate").alias("top"))

    def kernel(stack, values, heads):
        n = np.zeros(len(stack.own), np.int64)
        chosen = np.array([[c in (h or ()) for c in range(len(values))] for h in heads])
        for c in np.flatnonzero(chosen.any(0)).tolist():
            n += stack.segmented(values[c]) & chosen[stack.own, c]
        yield _rows(stack, AND, n == 2)
        yield _rows(stack, OR, n > 0)

    return frames.run_stacks(channels(df, keys), keys, "v", kernel, _FEATURES, top)


def _segmented(v: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Otsu's foreground of the pixels inside, turned over where it would be half of them or more; its components and area."""
    y, x = inside.nonzero()
    stack = Stack(np.zeros(len(y), np.int64), y, x)
    on = np.zeros(inside.shape, bool)
    on[inside] = stack.segmented(v[inside])
    return on, len(stack.label(on[inside])[1]), int(on.sum())


def stacked_sums(stack: Stack, values: np.ndarray, best: Sequence[Sequence[tuple[int, int, int]]]):
    """Combinations of each frame: (frames, kind, start, channels, factors, components, area), arrays with an entry a combination.

    values: every candidate's value of every pixel; best: by frame (candidate, components, area) of each
    space's best channel. kind "add": from each of these over all the others with factors 2 and 1; what
    leaves fewer components and over nine tenths of the area stays in, what doesn't is passed over.
    "subtract": all of them, without those whose removal helps in the same way, in rounds. "pca": the first
    component of the standardised b, g and r. Frames take the same steps at the same time, each with its
    own weights.
    """
    n, wide = stack.n, max(map(len, best), default=0)
    found = np.full((n, wide, 3), -1)
    for i, b in enumerate(best):
        found[i, : len(b)] = np.reshape(b, (-1, 3))
    have, every = found[:, :, 0] >= 0, np.arange(n)
    chosen = np.stack([values[np.maximum(found[:, s, 0], 0)[stack.own], np.arange(len(stack.own))] for s in range(wide)]) if wide else values[:0]

    def measure(weights, of=chosen):
        v = np.zeros(len(stack.own))
        for s in range(weights.shape[1]):
            if weights[:, s].any():
                v += weights[stack.own, s] * of[s]
        on = stack.segmented(v)
        return np.bincount(stack.label(on)[1], minlength=n), np.bincount(stack.own[on], minlength=n)

    def helps(now, before):
        return (now[0] < before[0]) & (now[1] > 0.9 * before[1])

    def rows(kind, ok, start, weights, rank, got, names=None):
        """rank: the order in which a combination lists its channels."""
        i = np.flatnonzero(ok)
        order = rank[i].argsort(1, kind="stable")
        w = np.take_along_axis(weights[i], order, 1)
        c = np.take_along_axis(found[i, :, 0] if names is None else names[i], order, 1)
        off = np.append(0, (w != 0).sum(1).cumsum()).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(a[w != 0])) for a in (c, w)]
        first = pa.nulls(len(i), pa.int32()) if start is None else pa.array(start[i].astype(np.int32))
        return i, pa.array([kind] * len(i), pa.string()), first, *lists, *(g[i].astype(np.int64) for g in got)

    slots = np.tile(np.arange(wide), (n, 1))
    for s in range(wide):
        on = have[:, s]
        weights, rank = np.zeros((n, wide)), np.full((n, wide), wide + 1)
        weights[on, s], rank[:, s], step = 1.0, 0, 0
        before = [found[:, s, 1].copy(), found[:, s, 2].copy()]
        yield rows("add", on, found[:, s, 0], weights, rank, before)
        for o in reversed(range(wide)):
            if o == s:
                continue
            own, step = weights.copy(), step + 1
            for factor in (2.0, 1.0):
                tried = own.copy()
                tried[:, o] = factor
                got = measure(tried)
                ok = on & have[:, o] & helps(got, before)
                weights[ok], rank[ok, o] = tried[ok], step
                for b, g in zip(before, got):
                    b[ok] = g[ok]
                yield rows("add", ok, found[:, s, 0], weights, rank, got)
    left, going = have.astype(float), np.ones(n, bool)
    for r in range(wide - 1):
        going &= (left.sum(1) > 1) & (r < have.sum(1) - 1)
        if not going.any():
            break
        before, gone = [b.copy() for b in measure(left)], np.zeros((n, wide), bool)
        for c in range(wide):
            tried = left.copy()
            tried[:, c] = 0
            got = measure(tried)
            ok = going & (left[:, c] > 0) & helps(got, before)
            for b, g in zip(before, got):
                b[ok] = g[ok]
            gone[ok, c] = True
            yield rows("subtract", ok, None, tried, slots, got)
        going &= gone.any(1)
        left[gone] = 0
    bgr = values[1:4]
    mean = np.stack([np.bincount(stack.own, v, n) for v in bgr]) / stack.size
    z = bgr - mean[:, stack.own]
    spread = np.sqrt(np.stack([np.bincount(stack.own, v * v, n) for v in z]) / stack.size)
    spread = np.where(spread > 0, spread, 1.0)
    z /= spread[:, stack.own]
    shared = np.stack([[np.bincount(stack.own, p * q, n) for q in z] for p in z]).transpose(2, 0, 1)
    weights = np.linalg.eigh(shared)[1][:, :, -1] / spread.T
    got = measure(weights, bgr)
    three = np.tile(np.array([1, 2, 3]), (n, 1))
    yield rows("pca", got[0][every] > 0, None, weights, three, got, three)


def sums(values: np.ndarray, inside: np.ndarray, best: Sequence[tuple[int, int, int]]):
    """The same of one image, values being (candidate, y, x): (kind, start, channels, factors, components, area)."""
    y, x = inside.nonzero()
    for _, *cols in stacked_sums(Stack(np.zeros(len(y), np.int64), y, x), values[:, inside], [best]):
        yield from zip(*(c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in cols))


def search_sums(df: DataFrame, keys: Sequence[str], best: DataFrame) -> DataFrame:
    """Sums of channels by image, each that is worth keeping: (keys, kind, start, channels, factors, components, area), see `stacked_sums`.

    best: ranked single channels of an image (search_channels), of which each colour space's first is taken.
    """
    space = F.greatest(F.floor((F.col("candidate") - 1) / 3), F.lit(0))
    first = best.groupBy(*keys, space.alias("space")).agg(F.min_by(F.struct("candidate", "components", "area"), "place").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("best"))

    def kernel(stack, values, heads):
        yield from stacked_sums(stack, values, [[tuple(b.values()) for b in h or ()] for h in heads])

    return frames.run_stacks(channels(df, keys), keys, "v", kernel, "kind string, start int, channels array<int>, factors array<double>, components long, area long", first)
