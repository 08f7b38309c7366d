"""Identity of components through time, and what their paths say."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import descriptors, frames


class Colonies:
    """Hands ids on: a component takes the smallest id below it, all ids below it are used up; if one was used in this frame already, or there is none, it gets a new id."""

    def __init__(self, least: int = 1):
        self.least, self.next, self.ids = least, 1, None

    def label(self, a: np.ndarray) -> np.ndarray:
        n = K.label(a)
        out = np.zeros(a.shape, np.int64)
        if self.ids is None:
            self.ids = np.zeros(a.shape, np.int64)
        used: set[int] = set()
        size = K.sizes(n)
        for k in range(1, len(size)):
            if size[k] < self.least:
                continue
            on = n == k
            below = [i for i in np.unique(self.ids[on]).tolist() if i]
            if not below or used.intersection(below):
                own, self.next = self.next, self.next + 1
            else:
                own = below[0]
            used.update(below)
            used.add(own)
            out[on] = own
        self.ids = out
        return out


class _Track:
    def __init__(self, least: int):
        self.colonies = Colonies(least)

    def frame(self, t, a):
        out = self.colonies.label(a)
        for y, x in zip(*out.nonzero()):
            yield t, int(out[y, x]), int(y), int(x)

    def close(self):
        return ()


def colonies(df: DataFrame, arena: Sequence[str], height: int, width: int, least: int = 1, all_frames: DataFrame | None = None) -> DataFrame:
    """(arena, t, colony, y, x) of foreground (arena, t, y, x). An empty frame ends all identities, if all_frames (arena, t) names it."""
    keys = [*arena, "t"]
    packed = frames.pack(df, keys)
    if all_frames is not None:
        packed = frames.with_empty_frames(packed, all_frames, keys)
    return frames.run_ordered(packed, arena, "t", lambda key: _Track(least), "t int, colony long, y int, x int", height, width)


def centroids(tracked: DataFrame, arena: Sequence[str]) -> DataFrame:
    return tracked.groupBy(*arena, "t", "colony").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count(F.lit(1)).alias("area"))


def colony_descriptors(tracked: DataFrame, arena: Sequence[str]) -> DataFrame:
    return descriptors.moments(tracked, [*arena, "t", "colony"])


def wide(long: DataFrame, arena: Sequence[str], value: str, colonies_: list[int]) -> DataFrame:
    """value<colony> columns by frame, for export; the colonies are named, so no extra pass finds them."""
    out = long.groupBy(*arena, "t").pivot("colony", colonies_).agg(F.first(value))
    return out.select(*arena, "t", *[F.col(str(c)).alias(f"{value}{c}") for c in colonies_])


def paths(c: DataFrame, arena: Sequence[str]) -> DataFrame:
    """First and last place of every colony, its frames, distance and mean area."""
    g = c.groupBy(*arena, "colony").agg(F.min_by(F.struct("y", "x"), "t").alias("a"), F.max_by(F.struct("y", "x"), "t").alias("b"), F.count(F.lit(1)).alias("frames"), F.avg("area").alias("area"))
    d = F.sqrt(F.pow(F.col("b.y") - F.col("a.y"), F.lit(2)) + F.pow(F.col("b.x") - F.col("a.x"), F.lit(2)))
    return g.select(*arena, "colony", F.col("a.y").alias("y0"), F.col("a.x").alias("x0"), F.col("b.y").alias("y1"), F.col("b.x").alias("x1"), "frames", "area", d.alias("distance"))


def directions(path: DataFrame) -> DataFrame:
    """Adds `angle`, counter-clockwise from the x axis with y upwards; colonies that end where they began go."""
    return path.where("distance > 0").withColumn("angle", F.atan2(F.col("y0") - F.col("y1"), F.col("x1") - F.col("x0")))


def rose(direction: DataFrame, keys: Sequence[str], bins: int = 12) -> DataFrame:
    """Histogram of clock angles (0 is up) in `bins` bins, relative to the fullest."""
    two_pi = 2 * np.pi
    a = F.pmod(F.pi() / 2 - F.col("angle"), F.lit(two_pi))
    b = F.least(F.floor(a * bins / two_pi), F.lit(bins - 1)).cast("int")
    n = direction.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


def mean_direction(direction: DataFrame, keys: Sequence[str]) -> DataFrame:
    return direction.groupBy(*keys).agg(F.atan2(F.avg(F.sin("angle")), F.avg(F.cos("angle"))).alias("mean_angle"), F.sqrt(F.pow(F.avg(F.sin("angle")), F.lit(2)) + F.pow(F.avg(F.cos("angle")), F.lit(2))).alias("concentration"))


def top_colonies(path: DataFrame, keys: Sequence[str], by: str, k: int) -> DataFrame:
    """The k first colonies by area, distance or frames."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), "colony")
    return path.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
