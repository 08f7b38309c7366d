"""Where growth starts and how fast it covers: origins, covering times, slopes, holes filled back in time, network states."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import frames, motion, pixels, segmentation


def origin_component(stats: DataFrame, keys: Sequence[str], height: int, width: int, how: str = "largest") -> DataFrame:
    """(keys, component, area, substantial): the largest component, or the one whose centre is nearest to the image's; growth beyond `substantial` counts."""
    if how == "largest":
        order = F.struct(-F.col("area"), F.col("component"))
    else:
        away = F.pow(F.col("cy") - height // 2, F.lit(2)) + F.pow(F.col("cx") - width // 2, F.lit(2))
        order = F.struct(F.round(away, 6), F.col("component"))
    best = stats.groupBy(*keys).agg(F.min_by(F.struct("component", "area"), order).alias("o"))
    return best.select(*keys, "o.component", "o.area", F.least(F.col("o.area") * 1.2, F.col("o.area") + 250.0).alias("substantial"))


def substantial_times(areas: DataFrame, origin: DataFrame, keys: Sequence[str], hits: int = 3) -> DataFrame:
    """The frame at which the area has exceeded the substantial size for the third time; null if it never does."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = areas.join(origin.select(*keys, "substantial"), list(keys)).withColumn("n", F.sum((F.col("area") > F.col("substantial")).cast("int")).over(w))
    return d.groupBy(*keys).agg(F.min(F.when(F.col("n") >= hits, F.col("t"))).alias("substantial_time"))


def smooth5(v: np.ndarray) -> np.ndarray:
    """Mean of a value, the one before and the two after, as far as both sides reach."""
    n = len(v)
    out, count = v.astype(float).copy(), np.ones(n)
    for k in (1, 2, -1):
        i = np.arange(abs(k), n - abs(k))
        if len(i):
            out[i] += v[i + k]
            count[i] += 1
    return out / count


def major_incline(v: np.ndarray, noise: float) -> tuple[int, int]:
    """(left, right): how much of a curve's flat ends can go, v[left:-right] being the incline; (0, 1) if there is none.

    Ends go as long as the smoothed range stays within a quarter, then half, then the whole of the
    noise; the range of every rest is known from running extremes.
    """
    s = smooth5(np.asarray(v, float))
    least, n = max(5.0, 2 * noise), len(s)
    full = float(np.ptp(s)) if n else 0.0

    def cut(part: np.ndarray, loss: float) -> int:
        """First i at which part[i:] has lost that much range, or is short."""
        rest = np.maximum.accumulate(part[::-1])[::-1] - np.minimum.accumulate(part[::-1])[::-1]
        ok = (rest <= full - loss) | (len(part) - np.arange(len(part)) <= least)
        ok[0] = len(part) <= least or (full <= full - loss)
        return int(ok.argmax()) if ok.any() else len(part)

    if n <= least:
        return 0, 1
    left = cut(s, noise / 4)
    s = s[left:]
    right = cut(s[::-1], noise / 2) if len(s) > least else 0
    s = s[: len(s) - right]
    if len(s) > least:
        more = cut(s, noise)
        left, s = left + more, s[more:]
    return (0, 1) if len(s) <= least else (left, right + 1)


def covering_steps(df: DataFrame, arena: Sequence[str], noise: DataFrame, frames_: DataFrame, value: str = "v") -> DataFrame:
    """(arena, step): half the mean length of the pixels' major inclines, and one; a twentieth of the video at most. noise: arena, noise.

    A pixel's series is one value a frame; series are packed and run through the kernel in Arrow batches.
    """
    keys = [*arena, "y", "x"]
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("t"), F.col(value).cast("double").alias("v")))).alias("s")).select(*arena, F.col("s.v").alias("vs"))
    packed = packed.join(noise, list(arena))
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in arena)

    def run(batches):
        for batch in batches:
            vs, z = batch.column(len(arena)), batch.column(len(arena) + 1).to_pylist()
            out = []
            for i in range(len(batch)):
                v = np.asarray(vs[i].values)
                left, right = major_incline(v, z[i] or 0.0)
                out.append(None if (left, right) == (0, 1) else len(v) - left - right)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(arena)], pa.array(out, pa.int32())], names=[*arena, "length"])

    lengths = packed.select(*arena, "vs", "noise").mapInArrow(run, f"{types}, length int")
    mean = lengths.groupBy(*arena).agg(F.avg("length").alias("m"))
    n = frames_.groupBy(*arena).agg(F.count(F.lit(1)).alias("n"))
    step = F.least(F.floor(F.bround("m", 0) / 2) + 1, F.floor(F.col("n") / 20))
    return n.join(mean, list(arena), "left").select(*arena, F.greatest(F.coalesce(step, F.when(F.col("n") < 40, 1).otherwise(10)), F.lit(1)).cast("int").alias("step"))


def slope_segmentation(df: DataFrame, arena: Sequence[str], covering: DataFrame, lighter: bool, limit: float, step: int = 1, lost: int = 0, value: str = "v") -> DataFrame:
    """(arena, t, y, x) whose slope passes the threshold that the grid picks, shifted `lost` frames earlier. covering: arena, base of slopes."""
    s = motion.slopes(df, arena, step, value=value).where("slope is not null")
    picked = segmentation.pick_threshold(segmentation.threshold_grid(s, covering, list(arena), lighter, limit, "slope"), list(arena))
    test = F.col("slope") < F.col("threshold") if lighter else F.col("slope") > F.col("threshold")
    return s.join(picked, list(arena)).where(test).select(*arena, (F.col("t") - lost).alias("t"), "y", "x").where("t >= 0")


def detect(parts: Sequence[DataFrame], how: str, on: Sequence[str] = ("arena", "t", "y", "x")) -> DataFrame:
    """One segmentation alone, or two joined by And or Or."""
    return parts[0].select(*on) if len(parts) == 1 else pixels.combine(parts[0], parts[1], list(on), how)


class _Holes:
    """Fills an arena's holes over time as fast as the shape grew past them."""

    def __init__(self):
        self.t: list[int] = []
        self.states: list[np.ndarray] = []

    def frame(self, t, a):
        self.t.append(t)
        self.states.append(a)
        return ()

    def close(self):
        for t, a in zip(self.t, fill_back(self.states)):
            yield from ((t, int(y), int(x)) for y, x in zip(*a.nonzero()))


def fill_back(states: list[np.ndarray]) -> list[np.ndarray]:
    """Holes of the last state, on from the frame in which the shape, growing evenly from the first to the last ring round them, came by."""
    holes = K.holes(states[-1])
    if not holes.any() or len(states) < 2:
        return states
    rings = K.ring_field(states[0], max(states[0].shape))
    rim = K.dilate(holes) & states[-1] & (rings > 0)
    if not rim.any():
        return states
    far, near = rings[rim].min(), rings[rim].max()
    reached = lambda ring: next((k for k, s in enumerate(states) if (s & rim & (rings == ring)).any()), None)
    start, end = reached(near) or 0, reached(far)
    end = len(states) - 1 if end is None or end < start else end
    out = [s.copy() for s in states]
    for k in range(start, len(states)):
        level = far if k >= end else near + (far - near) * (k - start) / max(end - start, 1)
        new = holes & (rings >= np.rint(level))
        out[k] |= new if k > end else K.touching(new, K.dilate(out[k]))
    return out


def filled_states(states: DataFrame, arena: Sequence[str], height: int, width: int) -> DataFrame:
    """(arena, t, y, x) with holes filled back; one arena's masks are held at a time."""
    return frames.run_ordered(frames.pack(states, [*arena, "t"]), arena, "t", lambda key: _Holes(), "t int, y int, x int", height, width)


def network_votes(df: DataFrame, arena: Sequence[str], frames_: DataFrame) -> DataFrame:
    """Network pixels on in two of five frames; in the first two and the last frame, in any of the two frames at that end."""
    w = Window.partitionBy(*arena)
    f = frames_.select(*arena, "t").distinct()
    ranked = f.withColumn("first", F.min("t").over(w)).withColumn("last", F.max("t").over(w))
    inner = pixels.frame_votes(df, arena, 2, 2, ranked.where("t >= first + 2 and t <= last - 1"), 2)
    ends = ranked.where("t < first + 2 or t > last - 1").withColumn("u", F.explode(F.when(F.col("t") < F.col("first") + 2, F.array("first", F.col("first") + 1)).otherwise(F.array(F.col("last") - 1, "last"))))
    outer = ends.join(df.select(*arena, F.col("t").alias("u"), "y", "x"), [*arena, "u"]).select(*arena, "t", "y", "x").distinct()
    return inner.select(*arena, "t", "y", "x").unionByName(outer)


class _Network:
    """Keeps an arena's network from losing large parts at once."""

    def __init__(self, origin: np.ndarray | None, shrink: float, large: int):
        self.origin, self.shrink, self.large, self.before = origin, shrink, large, None

    def frame(self, t, a):
        now = a
        if self.origin is not None:
            now = K.outline(self.origin) | (a & ~self.origin)
        now = K.largest(now)
        if self.before is not None and now.sum() < self.before.sum() * (1 - self.shrink):
            n = K.label(self.before & ~now)
            now = now | ((n > 0) & (K.sizes(n)[n] > self.large))
        self.before = now
        yield from ((t, int(y), int(x)) for y, x in zip(*now.nonzero()))

    def close(self):
        return ()


def network_states(votes: DataFrame, arena: Sequence[str], height: int, width: int, shrink: float = 0.2, large: int = 50, origin: np.ndarray | None = None, all_frames: DataFrame | None = None) -> DataFrame:
    """(arena, t, y, x): largest components, with missing parts of over `large` pixels restored where a network shrinks by more than `shrink`."""
    packed = frames.pack(votes, [*arena, "t"])
    if all_frames is not None:
        packed = frames.with_empty_frames(packed, all_frames, [*arena, "t"])
    return frames.run_ordered(packed, arena, "t", lambda key: _Network(origin, shrink, large), "t int, y int, x int", height, width)


def grow_apart(shape: np.ndarray, others: np.ndarray, centres: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Dilates a shape until it meets another one or the edge, or reaches farther from its own centre than half way to the nearest other centre."""
    wall = others.copy()
    wall[0] = wall[-1] = True
    wall[:, 0] = wall[:, -1] = True
    reach = lambda a, c: np.hypot(*(np.argwhere(a) - c).T)
    rest = centres[(centres != own).any(1)]
    now = shape
    while True:
        half = min((reach(now, c).min() for c in rest), default=np.inf) / 2
        if reach(now, own).max() > half or (now & wall).any():
            return now
        more = K.dilate(now, K.SQUARE)
        if (more & wall).any() or (more == now).all():
            return now
        now = more


def refill_mask(grey: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels get the mean of those round the mask, so that a drift's blank margins don't set the threshold."""
    rim = K.dilate(mask) & ~mask
    out = grey.astype(float).copy()
    if rim.any():
        out[mask] = grey[rim].mean()
    return out
