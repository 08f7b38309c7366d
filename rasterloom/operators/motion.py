"""The per-arena pipeline: segmentation through time, growth states, leaving cells, distant shapes, oscillations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import series
from . import frames, pixels


@dataclass(frozen=True)
class Rules:
    """How states follow one another."""

    mode: str = "grow"  # grow, move and grow, or move
    vote: bool = True  # pixels on in two of three frames
    largest_share: float = 0.5  # more foreground than this is noise
    growth_factor: float = 1.0  # as is more than this times growth over the largest so far
    close_radius: int = 1
    max_distance: int = 0  # distant shapes up to here are joined
    least_shape: int | None = None
    most_shape: int | None = None
    fading: float = 0.0  # how far a left pixel's intensity has come back
    lighter_background: bool = True
    lost_frames: int = 0


def connect(new: np.ndarray, old: np.ndarray, rules: Rules) -> np.ndarray:
    """The old shape with the new shapes that touch it, or that lie within the distance and the size limits, bridged in straight lines."""
    both = new | old
    n = K.label(both)
    main = np.unique(n[old & (n > 0)])
    out = np.isin(n, main[main > 0])
    if not rules.max_distance or not out.any():
        return out
    size = K.sizes(n)
    todo = [k for k in range(1, len(size)) if k not in set(main.tolist()) and (rules.least_shape is None or size[k] >= rules.least_shape) and (rules.most_shape is None or size[k] <= rules.most_shape)]
    while todo:  # nearest first; a joined shape can bring others within reach
        at = np.argwhere(K.outline(out))
        best = None
        for k in todo:
            p = np.argwhere(n == k)
            d = ((p[:, None, :] - at[None, :, :]) ** 2).sum(2)
            i, j = np.unravel_index(d.argmin(), d.shape)
            if best is None or d[i, j] < best[0]:
                best = (d[i, j], k, tuple(p[i]), tuple(at[j]))
        if best[0] > rules.max_distance**2:
            break
        out |= n == best[1]
        bridge = K.line(best[2], best[3])
        out[bridge[:, 0], bridge[:, 1]] = True
        todo.remove(best[1])
    return out


def leave(new: np.ndarray, covering: np.ndarray, before: np.ndarray, grey: np.ndarray, fading: float, lighter_background: bool, protect: np.ndarray | None = None) -> np.ndarray:
    """Takes pixels off the shape's inner ring whose intensity came back, component by component, unless the shape would split."""
    ring = before & ~K.erode(before, K.SQUARE, border=False)
    back = grey > covering * (1 - fading) if lighter_background else grey < covering * (1 + fading)
    gone = ring & new & back
    if protect is not None:
        gone &= ~protect
    out, whole = new.copy(), int(K.label(new).max())
    n = K.label(gone)
    for k in range(1, int(n.max()) + 1):
        less = out & ~(n == k)
        if int(K.label(less).max()) <= whole and less.any():
            out = less
    return out


class Arena:
    """One arena's states in the order of its frames.

    Without joins across a distance a state is final at once. With them, the frames since a distant
    shape appeared are rewritten when it is joined: its bridge then grows gradually, so states are
    given out when the arena ends.
    """

    def __init__(self, rules: Rules, origin: np.ndarray | None = None):
        self.rules, self.state, self.origin = rules, origin, origin
        self.recent: list[np.ndarray] = []
        self.greys: list[np.ndarray] = []
        self.covering: np.ndarray | None = None
        self.most = 0
        self.held: list[tuple[int, np.ndarray]] = []
        self.drafts: list[np.ndarray] = []

    def _candidates(self, draft: np.ndarray) -> np.ndarray:
        self.recent = [*self.recent[-5:], draft]
        r = self.rules
        now = sum(x.astype(int) for x in self.recent[-3:]) >= 2 if r.vote and len(self.recent) > 2 else draft
        limit = r.largest_share * draft.size
        if self.most:
            limit = min(limit, max(self.most * (1 + r.growth_factor), 1))
        for older in [None, *self.recent[-2::-1]]:
            if older is not None:
                now = older
            if now.sum() <= limit:
                return now
        return np.logical_and.reduce(self.recent)

    def step(self, t: int, draft: np.ndarray, grey: np.ndarray | None = None) -> np.ndarray:
        r = self.rules
        now = self._candidates(draft)
        if r.close_radius:
            shape = K.disk(r.close_radius)
            now = K.erode(K.dilate(now, shape), shape)
        if self.state is None:
            self.state = now if now.any() else None
            if self.state is None:
                return now
        before = self.state
        if r.mode != "move":
            joined = connect(now, before, r)
            now = joined | before
        if r.mode == "move and grow" and grey is not None and self.covering is not None:
            self.greys = [*self.greys[-r.lost_frames :], grey] if r.lost_frames else [grey]
            now = leave(now, self.covering, before, self.greys[0], r.fading, r.lighter_background, self.origin)
        if grey is not None:
            fresh = now & ~before if self.covering is not None else now
            if self.covering is None:
                self.covering = np.where(now, grey, 0.0)
            self.covering = np.where(fresh, grey, self.covering)
        self.most = max(self.most, int(now.sum()))
        self.state = now
        return now

    def frame(self, t: int, draft: np.ndarray, grey=None):
        on = draft > 0 if draft.dtype != bool else draft
        now = self.step(t, on, grey)
        if not self.rules.max_distance:
            yield from ((t, int(y), int(x)) for y, x in zip(*now.nonzero()))
        else:
            self.held.append((t, now))
            self.drafts.append(on)

    def close(self):
        if not self.rules.max_distance:
            return
        for t, now in gradual(self.held, self.drafts):
            yield from ((t, int(y), int(x)) for y, x in zip(*now.nonzero()))


def gradual(states: list[tuple[int, np.ndarray]], drafts: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Spreads bridges back in time: bridge pixels, which no draft has, come on one after another, nearest to the shape first, between a distant shape's first sight and its join."""
    out = [(t, s.copy()) for t, s in states]
    for k in range(1, len(states)):
        new = states[k][1] & ~states[k - 1][1]
        bridge = new & ~drafts[k]
        n = K.label(bridge)
        for b in range(1, int(n.max()) + 1):
            part = n == b
            far = K.touching(new & ~part, K.dilate(part, K.SQUARE))
            first = k
            while first and (drafts[first - 1] & far).any():
                first -= 1
            if first == k:
                continue
            at = np.argwhere(part)
            d = K.distance(~states[k - 1][1])[at[:, 0], at[:, 1]]
            share = (np.argsort(np.argsort(d, kind="stable"), kind="stable") + 1) / len(at)
            for m in range(first, k):
                early = at[share <= (m - first + 1) / (k - first + 1)]
                out[m][1][early[:, 0], early[:, 1]] = True
    return out


class _Leaving:
    """An arena that gets each frame's intensities too, so that pixels can be left."""

    def __init__(self, rules: Rules):
        self.arena = Arena(rules)

    def frame(self, t, grey, ys, xs):
        draft = np.zeros(grey.shape, bool)
        draft[ys or [], xs or []] = True
        yield from self.arena.frame(t, draft, grey)

    def close(self):
        yield from self.arena.close()


def track_shapes(draft: DataFrame, arena: Sequence[str], height: int, width: int, rules: Rules | None = None, all_frames: DataFrame | None = None, grey: DataFrame | None = None) -> DataFrame:
    """(arena, t, y, x) of the states that follow from a draft segmentation (arena, t, y, x).

    Cells leave pixels only in the mode "move and grow", and only with the intensities: grey (arena, t, y, x, v).
    """
    own = rules or Rules()
    keys = [*arena, "t"]
    if grey is not None and own.mode == "move and grow":
        on = frames.pack(draft, keys).withColumnsRenamed({"ys": "oys", "xs": "oxs"})
        both = frames.pack(grey, keys, "v").join(on, keys, "left")
        if all_frames is not None:
            both = frames.with_empty_frames(both, all_frames, keys)
        return frames.run_ordered(both, arena, "t", lambda key: _Leaving(own), "t int, y int, x int", height, width, ("oys", "oxs"))
    packed = frames.pack(draft, keys)
    if all_frames is not None:
        packed = frames.with_empty_frames(packed, all_frames, keys)
    return frames.run_ordered(packed, arena, "t", lambda key: Arena(own), "t int, y int, x int", height, width)


def frame_ranges(frames_: DataFrame, arena: Sequence[str]) -> DataFrame:
    """(arena, n, step, still): short videos are still; long ones are stepped through by a twentieth."""
    n = frames_.groupBy(*arena).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("step", F.when(F.col("n") >= 40, F.floor(F.col("n") / 20)).otherwise(1).cast("int")).withColumn("still", F.col("n") < 2)


def slopes(df: DataFrame, arena: Sequence[str], step: int = 1, smooth: int = 1, repeats: int = 1, value: str = "v") -> DataFrame:
    """(arena, t, y, x, slope): temporal gradient of intensity over its frame's mean, smoothed per pixel."""
    mean = F.avg(value).over(Window.partitionBy(*arena, "t"))
    d = df.withColumn("__v", F.col(value) / F.when(mean != 0, mean))
    if smooth > 1:
        for _ in range(repeats):
            d = series.edge_padded_mean(d, [*arena, "y", "x"], "t", "__v", smooth, "__s").withColumn("__v", F.col("__s")).drop("__s")
    return d.select(*arena, "t", "y", "x", series.gradient([*arena, "y", "x"], "t", "__v", step).alias("slope"))


def oscillation_signs(df: DataFrame, arena: Sequence[str], period: int = 2, value: str = "v") -> DataFrame:
    """Sign of each pixel's slope: 1 thickens, -1 thins."""
    s = slopes(df, arena, max(int(period), 2), value=value)
    return s.where("slope is not null").select(*arena, "t", "y", "x", F.signum("slope").cast("int").alias("sign"))


def oscillating_zones(signs: DataFrame, arena: Sequence[str], least: int = 2) -> DataFrame:
    """(arena, t, y, x, phase 1 or 2): pixels of which over four neighbours share a sign, in zones of `least` pixels."""
    from . import components as C

    out = None
    for phase, sign in ((1, 1), (2, -1)):
        n = pixels.neighbour_counts(signs, [*arena, "t"], F.col("sign") == sign).where("count > 4").select(*arena, "t", "y", "x")
        zone = C.keep_sizes(C.components(n, [*arena, "t"]), [*arena, "t"], least).select(*arena, "t", "y", "x", F.lit(phase).alias("phase"))
        out = zone if out is None else out.unionByName(zone)
    return out
