"""Connected components and what is derived from them.

`components` runs a kernel per frame. `large_components` is for images beyond a worker's memory: it
cuts the plane into tiles, labels each tile, and joins labels across tile borders by iterating on
the label graph alone, which is far smaller than the pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import frames


def components(df: DataFrame, keys: Sequence[str], connectivity: int = 8) -> DataFrame:
    """Pixels with their component's number: 1.. in raster order of first pixels."""

    def kernel(a, y0, x0):
        n = K.label(a, connectivity)
        for y, x in zip(*a.nonzero()):
            yield int(y) + y0, int(x) + x0, int(n[y, x])

    return frames.run(frames.pack(df, keys), keys, kernel, "y int, x int, component int")


def stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, component, area, top, left, bottom, right, cy, cx)."""
    return labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("top"), F.min("x").alias("left"), F.max("y").alias("bottom"), F.max("x").alias("right"), F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def rank_by_size(component_stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `rank`: 1 is the largest; of equals the later component comes first."""
    return component_stats.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), F.desc("component"))))


def keep_largest(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of the largest component; of equals the first."""
    best = stats(labelled, keys).groupBy(*keys).agg(F.max_by("component", F.struct("area", -F.col("component"))).alias("component"))
    return labelled.join(best, [*keys, "component"], "left_semi")


def keep_sizes(labelled: DataFrame, keys: Sequence[str], least: int | None = None, most: int | None = None, but: DataFrame | None = None) -> DataFrame:
    """Pixels of components within the size limits, and of those in `but` (keys, component) whatever their size."""
    s = stats(labelled, keys)
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col("area") >= least)
    if most is not None:
        ok = ok & (F.col("area") <= most)
    keep = s.where(ok).select(*keys, "component")
    if but is not None:
        keep = keep.unionByName(but.select(*keys, "component")).distinct()
    return labelled.join(keep, [*keys, "component"], "left_semi")


def touching(labelled: DataFrame, reference: DataFrame, keys: Sequence[str], on: Sequence[str] | None = None) -> DataFrame:
    """Pixels of components that share a pixel with the reference."""
    on = list(on or keys)
    hit = labelled.join(reference.select(*on, "y", "x"), [*on, "y", "x"], "left_semi").select(*keys, "component").distinct()
    return labelled.join(hit, [*keys, "component"], "left_semi")


def main_component(labelled: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The component that overlaps the previous shape most; of equals the first."""
    shared = labelled.join(previous.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi").groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy(*keys).agg(F.max_by("component", F.struct("shared", -F.col("component"))).alias("component"), F.max("shared").alias("shared"))


def holes(df: DataFrame, keys: Sequence[str], connectivity: int = 4) -> DataFrame:
    """Per frame (holes, total_hole_area, euler_number)."""

    def kernel(a, y0, x0):
        h = K.holes(a, connectivity)
        n = int(K.label(h).max()) if h.any() else 0
        yield n, int(h.sum()), -n

    return frames.run(frames.pack(df, keys), keys, kernel, "holes int, total_hole_area int, euler_number int")


def filled(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Foreground with its holes closed."""

    def kernel(a, y0, x0):
        for y, x in zip(*K.close_holes(a).nonzero()):
            yield int(y) + y0, int(x) + x0

    return frames.run(frames.pack(df, keys), keys, kernel, "y int, x int")


def reading_order(component_stats: DataFrame, keys: Sequence[str], rows: int | Column | None) -> DataFrame:
    """Adds `place`: top to bottom in `rows` rows of equal number, left to right inside; without rows by x alone."""
    by_y = Window.partitionBy(*keys).orderBy("cy", "cx", "component")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    if rows is None:
        return component_stats.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("cx", "cy", "component")))
    per_row = F.ceil(n / (F.lit(rows) if isinstance(rows, int) else rows))
    lined = component_stats.withColumn("__line", F.floor((F.row_number().over(by_y) - 1) / per_row))
    return lined.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__line", "cx", "cy", "component"))).drop("__line")


def arena_boxes(component_stats: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Each component's box, widened by half the distance to its nearest neighbour's centre and clipped to the image.

    Meant for arenas, of which an image has few: components of one image meet each other.
    """
    other = component_stats.select(*keys, F.col("component").alias("o"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))
    d = F.sqrt(F.pow(F.col("cy") - F.col("oy"), F.lit(2)) + F.pow(F.col("cx") - F.col("ox"), F.lit(2)))
    near = component_stats.join(other, list(keys)).where("component <> o").groupBy(*keys, "component").agg((F.min(d) / 2).alias("half"))
    s = component_stats.join(near, [*keys, "component"], "left")
    half = F.coalesce("half", F.lit(float(max(height, width))))
    low = lambda c: F.greatest(F.floor(F.col(c) - half), F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.ceil(F.col(c) + half), F.lit(n)).cast("int")
    return s.select(*keys, "component", F.least(low("cy"), F.col("top")).alias("top"), F.greatest(high("cy", height), F.col("bottom") + 1).alias("bottom"), F.least(low("cx"), F.col("left")).alias("left"), F.greatest(high("cx", width), F.col("right") + 1).alias("right"))


def same_sized_boxes(box: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Boxes padded to the largest one's size, made even, and moved back inside the image."""
    all_ = Window.partitionBy(*keys)
    even = lambda c: (F.ceil(c / 2) * 2).cast("int")
    h = F.least(even(F.max(F.col("bottom") - F.col("top")).over(all_)), F.lit(height))
    w = F.least(even(F.max(F.col("right") - F.col("left")).over(all_)), F.lit(width))
    top = F.greatest(F.least(F.floor((F.col("top") + F.col("bottom") - h) / 2), height - h), F.lit(0)).cast("int")
    left = F.greatest(F.least(F.floor((F.col("left") + F.col("right") - w) / 2), width - w), F.lit(0)).cast("int")
    return box.select(*keys, "component", top.alias("top"), (top + h).cast("int").alias("bottom"), left.alias("left"), (left + w).cast("int").alias("right"))


def large_components(df: DataFrame, keys: Sequence[str], tile: int = 1024, rounds: int = 40) -> DataFrame:
    """Components of images of any size: (keys, y, x, component), component = number of its first tile's label.

    Tiles are labelled side by side; edges between labels of neighbouring tiles then shrink to
    stars around the smallest labels, in about log rounds, until nothing changes; it is an error if `rounds`
    don't suffice. Each step is written to the checkpoint folder.
    """
    tiled = df.select(*keys, "y", "x", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    local = components(tiled, [*keys, "ty", "tx"])
    local = local.withColumn("node", F.concat_ws("/", F.lpad(F.col("ty").cast("string"), 8, "0"), F.lpad(F.col("tx").cast("string"), 8, "0"), F.lpad(F.col("component").cast("string"), 10, "0")))
    rim = local.where((F.col("y") % tile == 0) | (F.col("y") % tile == tile - 1) | (F.col("x") % tile == 0) | (F.col("x") % tile == tile - 1))
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    moved = rim.select(*keys, F.col("node").alias("a"), "y", "x", F.explode(steps).alias("s")).select(*keys, "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = moved.join(rim.select(*keys, "y", "x", F.col("node").alias("b")), [*keys, "y", "x"]).where("a <> b").select(*keys, "a", "b").distinct().checkpoint()
    edges = links.where("a > b").select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).checkpoint()
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        low = edges.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        # Large star: larger neighbours of v, and v itself, go to the smallest neighbour of v.
        large = edges.join(low.withColumnRenamed("u", "v"), [*keys, "v"], "left").select(*keys, "u", F.coalesce("m", "v").alias("v")).union(low.select(*keys, "u", "m"))
        # Small star: smaller neighbours of u, and u itself, go to the smallest of them.
        large = large.withColumn("m", F.min("v").over(Window.partitionBy(*keys, "u")))
        pair = lambda c: F.struct(F.col(c).alias("u"), F.col("m").alias("v"))
        both = F.explode(F.when(F.col("v") == F.col("m"), F.array(pair("u"))).otherwise(F.array(pair("u"), pair("v")))).alias("e")
        edges = large.select(*keys, both).select(*keys, "e.u", "e.v").distinct().checkpoint()
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(*keys, F.col("u").alias("node"), "v")
    labels = local.select(*keys, "node").distinct().join(stars, [*keys, "node"], "left").select(*keys, "node", F.coalesce("v", "node").alias("root"))
    order = labels.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("__n")).withColumn("component", F.row_number().over(Window.partitionBy(*keys).orderBy("root"))).drop("__n")
    return local.select(*keys, "y", "x", "node").join(labels, [*keys, "node"]).join(order, [*keys, "root"]).select(*keys, "y", "x", "component")
