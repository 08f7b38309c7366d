"""Masks and outlines drawn on colour pixels, drift corrected, radii against time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels, segmentation


def draw_mask(img: DataFrame, mask: DataFrame, keys: Sequence[str], colour: tuple[int, int, int], only_contours: bool = False, widen: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """img (keys, y, x, b, g, r) with a mask (keys, y, x), its outline or either one dilated, in a colour (b, g, r)."""
    shape = pixels.contours(mask, keys) if only_contours else mask.select(*keys, "y", "x").distinct()
    for _ in range(widen):
        shape = pixels.dilate(shape, keys, pixels.CROSS, height, width)
    hit = img.join(shape.withColumn("__on", F.lit(True)), [*keys, "y", "x"], "left")
    drawn = [F.when(F.col("__on"), F.lit(c)).otherwise(F.col(n)).alias(n) for n, c in zip(("b", "g", "r"), colour)]
    return hit.select(*keys, "y", "x", *drawn)


def draw_outline(img: DataFrame, mask: DataFrame, keys: Sequence[str], colour: tuple[int, int, int] | None = None, widen: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """img with the mask's outline; without a colour white on images that are bright in the mean (above 126), else black."""
    shape = pixels.contours(mask, keys)
    for _ in range(widen):
        shape = pixels.dilate(shape, keys, pixels.CROSS, height, width)
    bright = img.groupBy(*keys).agg((F.avg((F.col("b") + F.col("g") + F.col("r")) / 3) > 126).alias("__white"))
    hit = img.join(bright, list(keys)).join(shape.withColumn("__on", F.lit(True)), [*keys, "y", "x"], "left")
    own = [F.lit(c) for c in colour] if colour else [F.when(F.col("__white"), 255).otherwise(0)] * 3
    return hit.select(*keys, "y", "x", *[F.when(F.col("__on"), c).otherwise(F.col(n)).alias(n) for n, c in zip(("b", "g", "r"), own)])


def without_drift(df: DataFrame, binary: DataFrame, keys: Sequence[str], value: str = "v") -> tuple[DataFrame, DataFrame]:
    """Drift corrected: (pixels with the shapes at the mean of the ring around them, the foreground above the new Otsu threshold). A shape without a ring keeps its values."""
    ring = pixels.without(pixels.dilate(binary, keys), binary, [*keys, "y", "x"])
    level = df.join(ring, [*keys, "y", "x"], "left_semi").groupBy(*keys).agg(F.avg(value).alias("__level"))
    on = binary.select(*keys, "y", "x").distinct().withColumn("__on", F.lit(True))
    flat = df.join(on, [*keys, "y", "x"], "left").join(level, list(keys), "left")
    flat = flat.withColumn(value, F.when(F.col("__on") & F.col("__level").isNotNull(), F.col("__level")).otherwise(F.col(value))).drop("__on", "__level")
    return flat, segmentation.above(flat, segmentation.otsu_thresholds(flat, keys, value), keys, value)


def radius_against_time(states: DataFrame, field: DataFrame, keys: Sequence[str], frames: DataFrame) -> DataFrame:
    """(keys, t, radius): from the frame where the shape is first at the field's largest positive value to that where it is first at its least, evenly.

    field: keys, y, x, field. Without a first frame the range begins at 0, without a last it ends with the video; an end before the start gives no rows.
    """
    ends = field.where("field > 0").groupBy(*keys).agg(F.max("field").alias("near"), F.min("field").alias("far"))
    at = states.join(field.join(ends, list(keys)).where("field = near or field = far"), [*keys, "y", "x"])
    seen = at.groupBy(*keys).agg(F.min(F.when(F.col("field") == F.col("near"), F.col("t"))).alias("a"), F.min(F.when(F.col("field") == F.col("far"), F.col("t"))).alias("b"))
    last = frames.groupBy(*keys).agg(F.max("t").alias("last"))
    d = ends.join(last, list(keys)).join(seen, list(keys), "left")
    first, end = F.when(F.col("a") <= F.coalesce("b", "last"), F.col("a")).otherwise(F.lit(0)), F.coalesce("b", "last")
    d = d.select(*keys, "near", "far", first.alias("first"), end.alias("end")).where("end >= first")
    d = d.withColumn("t", F.explode(F.sequence("first", "end")))
    share = F.when(F.col("end") > F.col("first"), (F.col("t") - F.col("first")) / (F.col("end") - F.col("first"))).otherwise(0.0)
    return d.select(*keys, "t", F.bround(F.col("near") + (F.col("far") - F.col("near")) * share, 0).cast("double").alias("radius"))
