"""Arenas of an image: which components are specimens, where arenas lie, how large a pixel is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances round the median size, in the order they are tried.
TOLERANCES = (0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)


def select_shapes(stats: DataFrame, keys: Sequence[str], expected: int | None) -> DataFrame:
    """Components of about the median size: under the first tolerance that leaves the expected number, else those that aren't outliers.

    Components of an image are few, their statistics fewer; every tolerance is tried at once.
    """
    middle = stats.groupBy(*keys).agg(F.percentile("area", 0.5).alias("__m"), F.stddev_pop("area").alias("__s"))
    d = stats.join(middle, list(keys)).withColumn("__o", F.abs(F.col("area") - F.col("__m")))
    tol = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(TOLERANCES)]))
    tried = d.withColumn("__t", tol).where(F.col("__o") <= F.col("__t.t") * F.col("__m"))
    counts = tried.groupBy(*keys, F.col("__t.i").alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    hit = counts.where(F.col("__n") == expected if expected is not None else F.lit(False)).groupBy(*keys).agg(F.min("__i").alias("__i"))
    level = F.element_at(F.array(*map(F.lit, TOLERANCES)), F.col("__i") + 1)
    d = d.join(hit, list(keys), "left")
    keep = F.when(F.col("__i").isNotNull(), F.col("__o") <= level * F.col("__m")).otherwise(F.col("__o") <= 3 * F.col("__s"))
    return d.where(keep).select(*stats.columns)


def pixel_area(stats: DataFrame, keys: Sequence[str], width_px: int, width_mm: float | None = None, blob_mm: float | None = None) -> DataFrame:
    """(keys, pixel_area): mm2 a pixel, from the image's width or from the mean width of the specimens."""
    side = F.lit(width_mm / width_px) if width_mm is not None else F.lit(blob_mm) / F.avg(F.col("right") - F.col("left") + 1)
    g = stats.groupBy(*keys).agg((side if width_mm is None else F.first(side)).alias("side"))
    return g.select(*keys, (F.col("side") * F.col("side")).alias("pixel_area"))


def odd_sized(boxes: DataFrame, keys: Sequence[str], times: float = 100.0) -> DataFrame:
    """(keys, odd): whether any box is that many times larger or smaller than the median one."""
    size = (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left"))
    d = boxes.withColumn("__a", size.cast("double"))
    m = d.groupBy(*keys).agg(F.percentile("__a", 0.5).alias("__m"))
    return d.join(m, list(keys)).groupBy(*keys).agg(F.bool_or((F.col("__a") > times * F.col("__m")) | (F.col("__a") * times < F.col("__m"))).alias("odd"))


def crop_box(column_runs: DataFrame, row_runs: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """The box round all specimens, widened on each side by half the mean space between runs. Runs: keys, place, starts, ends."""
    out = None
    for name, runs, most in (("x", column_runs, width), ("y", row_runs, height)):
        w = Window.partitionBy(*keys).orderBy("place")
        gap = F.when(F.col("starts"), F.col("place") - F.max(F.when(F.col("ends"), F.col("place"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        g = runs.withColumn("__g", gap).groupBy(*keys).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.coalesce(F.avg("__g"), F.lit(0.0)).alias("g"))
        half = F.floor(F.col("g") / 2)
        side = g.select(*keys, F.greatest(F.col("a") - half, F.lit(0)).cast("int").alias(f"{name}_from"), F.least(F.col("b") + half + 1, F.lit(most)).cast("int").alias(f"{name}_to"))
        out = side if out is None else out.join(side, list(keys))
    return out


def moving_boxes(tracked: DataFrame, arena: Sequence[str], height: int, width: int, margin: int = 0) -> DataFrame:
    """Box of everything a colony covers over time."""
    g = tracked.groupBy(*arena, "colony").agg(F.min("y").alias("t"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r"))
    low = lambda c: F.greatest(F.col(c) - margin, F.lit(0)).alias({"t": "top", "l": "left"}[c])
    high = lambda c, n: F.least(F.col(c) + 1 + margin, F.lit(n)).alias({"b": "bottom", "r": "right"}[c])
    return g.select(*arena, "colony", low("t"), high("b", height), low("l"), high("r", width))


def into_arenas(pixels: DataFrame, boxes: DataFrame, folder: Sequence[str] = (), tile: int = 64) -> DataFrame:
    """Pixels of whole images dealt to arena boxes (arena, top, bottom, left, right), with coordinates from the box's corner.

    Boxes are listed by the tiles they touch, and a pixel meets those of its tile: an equi-join.
    """
    ty = F.explode(F.sequence(F.floor(F.col("top") / tile), F.floor((F.col("bottom") - 1) / tile)))
    tx = F.explode(F.sequence(F.floor(F.col("left") / tile), F.floor((F.col("right") - 1) / tile)))
    b = boxes.select(*folder, "arena", "top", "bottom", "left", "right", ty.alias("__ty")).withColumn("__tx", tx)
    p = pixels.withColumn("__ty", F.floor(F.col("y") / tile)).withColumn("__tx", F.floor(F.col("x") / tile))
    j = p.join(b, [*folder, "__ty", "__tx"]).where("y >= top and y < bottom and x >= left and x < right")
    return j.withColumn("y", (F.col("y") - F.col("top")).cast("int")).withColumn("x", (F.col("x") - F.col("left")).cast("int")).drop("__ty", "__tx", "top", "bottom", "left", "right")


def analysed(arenas: DataFrame, excluded: Sequence[int]) -> DataFrame:
    """Arenas but for the excluded ones."""
    return arenas.where(~F.col("arena").isin(*excluded)) if excluded else arenas


def whole_image(height: int, width: int) -> list[tuple[int, int, int, int, int]]:
    """One arena that is the image."""
    return [(1, 0, height, 0, width)]


def end_frames(frames: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First and last frame by key, as structs."""
    s = F.struct(order, *columns)
    return frames.groupBy(*keys).agg(F.min_by(s, order).alias("first"), F.max_by(s, order).alias("last"))


def is_grey(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether all channels agree everywhere."""
    return pixels.groupBy(*keys).agg(F.bool_and((F.col("b") == F.col("g")) & (F.col("g") == F.col("r"))).alias("grey"))
