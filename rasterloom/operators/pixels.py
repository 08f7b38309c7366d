"""Set and neighbourhood operators on pixel tables. Pixels are rows (keys, y, x[, v]); absent pixels are background.

Neighbours are found by shifting each row to the places it is a neighbour of and summing there: one
shuffle, map-side combined, instead of a self-join per offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))
DIAGONAL = ((-1, -1), (-1, 1), (1, -1), (1, 1))
SQUARE = CROSS + DIAGONAL


def disk(radius: int) -> tuple[tuple[int, int], ...]:
    """Offsets of a disk without its centre."""
    return tuple((a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius)


def _shifted(df: DataFrame, keys: Sequence[str], offsets, carry: dict[str, Column]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    out = df.select(*keys, "y", "x", *[c.alias(n) for n, c in carry.items()], F.explode(steps).alias("s"))
    return out.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), *carry)


def neighbour_counts(df: DataFrame, keys: Sequence[str], test: Column, offsets=SQUARE, height: int | None = None, width: int | None = None) -> DataFrame:
    """For each pixel of a dense table the number of neighbours that meet `test`; beyond the edge the edge pixel is repeated if a size is given."""
    marked = df.select(*keys, "y", "x", test.cast("int").alias("hit"))
    parts = _shifted(marked, keys, offsets, {"hit": F.col("hit")})
    if height is not None and width is not None:
        # A neighbour outside is the nearest pixel inside: seen from a border pixel that is a pixel of its own row or column.
        steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
        pad = marked.select(*keys, "y", "x", F.explode(steps).alias("s"))
        ny, nx = F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")
        out = (ny < 0) | (ny >= height) | (nx < 0) | (nx >= width)
        pad = pad.where(out).select(*keys, "y", "x", F.least(F.greatest(ny, F.lit(0)), F.lit(height - 1)).alias("py"), F.least(F.greatest(nx, F.lit(0)), F.lit(width - 1)).alias("px"))
        near = marked.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), "hit")
        parts = parts.unionByName(pad.join(near, [*keys, "py", "px"]).select(*keys, "y", "x", "hit"))
    sums = parts.groupBy(*keys, "y", "x").agg(F.sum("hit").alias("count"))
    return df.select(*keys, "y", "x").join(sums, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("count", F.lit(0)).cast("int").alias("count"))


def dilate(df: DataFrame, keys: Sequence[str], offsets=CROSS, height: int | None = None, width: int | None = None) -> DataFrame:
    """Foreground pixels and their neighbours, inside the image if a size is given."""
    out = _shifted(df, keys, ((0, 0), *offsets), {}).distinct()
    return out if height is None else out.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < height) & (F.col("x") < width))


def erode(df: DataFrame, keys: Sequence[str], offsets=CROSS, height: int | None = None, width: int | None = None) -> DataFrame:
    """Foreground pixels all of whose neighbours are foreground; with a size, what is beyond the edge doesn't count against them."""
    votes = _shifted(df, keys, ((0, 0), *offsets), {}).groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("__n"))
    need = F.lit(len(offsets) + 1)
    if height is not None:
        for a, b in offsets:
            y, x = F.col("y") + a, F.col("x") + b
            need = need - ((y < 0) | (x < 0) | (y >= height) | (x >= width)).cast("int")
    return df.select(*keys, "y", "x").join(votes.where(F.col("__n") >= need), [*keys, "y", "x"], "left_semi")


def opened(df: DataFrame, keys: Sequence[str], offsets=CROSS, height: int | None = None, width: int | None = None) -> DataFrame:
    return dilate(erode(df, keys, offsets, height, width), keys, offsets, height, width)


def closed(df: DataFrame, keys: Sequence[str], offsets=CROSS, height: int | None = None, width: int | None = None) -> DataFrame:
    return erode(dilate(df, keys, offsets, height, width), keys, offsets, height, width)


def contours(df: DataFrame, keys: Sequence[str], offsets=CROSS) -> DataFrame:
    """Foreground pixels that lack a neighbour; the image's edge counts as background."""
    inner = erode(df, keys, offsets)
    return df.select(*keys, "y", "x").join(inner, [*keys, "y", "x"], "left_anti")


def common(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a that also are in b."""
    return a.join(b.select(*on), list(on), "left_semi")


def without(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of a that aren't in b, repeats included."""
    return a.join(b.select(*on), list(on), "left_anti")


def repeated(df: DataFrame, on: Sequence[str], out: str = "repeated") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*on)) > 1)


def combine(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Logical And, Or, Xor of two foreground tables."""
    both = a.select(*on, F.lit(1).alias("__m")).union(b.select(*on, F.lit(2).alias("__m"))).groupBy(*on).agg(F.bit_or("__m").alias("__m"))
    keep = {"And": F.col("__m") == 3, "Or": F.col("__m") > 0, "Xor": F.col("__m") < 3}[how]
    return both.where(keep).select(*on)


def set_values(mask: DataFrame, coords: DataFrame, on: Sequence[str], value: int = 1) -> DataFrame:
    """mask (on..., v) with the value set at the coordinates."""
    return mask.join(coords.select(*on).distinct().withColumn("__hit", F.lit(True)), list(on), "left").withColumn("v", F.when(F.col("__hit"), F.lit(value)).otherwise(F.col("v"))).drop("__hit")


def clear_values(mask: DataFrame, coords: DataFrame, on: Sequence[str]) -> DataFrame:
    return set_values(mask, coords, on, 0)


def shift(df: DataFrame, by: int) -> DataFrame:
    """Add (1) or strip (-1) padding."""
    return df.withColumn("y", F.col("y") + by).withColumn("x", F.col("x") + by)


def crop(df: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    """Rows inside a box, with coordinates from its corner."""
    inside = df.where((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right))
    return inside.withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)


def boxes(df: DataFrame, keys: Sequence[str], padding: int = 0) -> DataFrame:
    return df.groupBy(*keys).agg((F.min("y") - padding).alias("top"), (F.max("y") + padding).alias("bottom"), (F.min("x") - padding).alias("left"), (F.max("x") + padding).alias("right"))


def median_shape(df: DataFrame, keys: Sequence[str], frames: DataFrame) -> DataFrame:
    """Pixels on in at least half (rounded down) of the key's frames; frames: keys and n."""
    on = df.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("__on")).join(frames, list(keys))
    return on.where(F.col("__on") >= F.floor(F.col("n") / 2)).select(*keys, "y", "x")


def frame_votes(df: DataFrame, keys: Sequence[str], before: int, after: int, frames: DataFrame, least: int = 2) -> DataFrame:
    """Pixels on in at least `least` of the frames t-before..t+after. frames: keys, t. Each pixel votes for the frames it counts in."""
    votes = df.select(*keys, "y", "x", F.explode(F.sequence(F.col("t") - after, F.col("t") + before)).alias("t"))
    votes = votes.groupBy(*keys, "t", "y", "x").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return votes.join(frames.select(*keys, "t"), [*keys, "t"], "left_semi")


def newly_explored(df: DataFrame, keys: Sequence[str], frames: DataFrame) -> DataFrame:
    """Per frame the number of pixels on that were off in frame 0; frames without any have 0."""
    start = df.where("t = 0").select(*keys, "y", "x")
    new = without(df, start, [*keys, "y", "x"]).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("newly_explored"))
    return frames.select(*keys, "t").join(new, [*keys, "t"], "left").select(*keys, "t", F.coalesce("newly_explored", F.lit(0)).alias("newly_explored"))


def least_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Smallest distance of two pixel sets by key of the first, if at most `reach`, else null; see `nearest_distance` for any reach.

    Pixels are dealt to square buckets of that size and meet those of the nine buckets around: an
    equi-join, not a product.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    left = a.select(*keys, "y", "x", cell("y").alias("cy"), cell("x").alias("cx"))
    around = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"), F.explode(around).alias("s"))
    right = right.select(*keys, "y2", "x2", (F.floor(F.col("y2") / reach) + F.col("s.dy")).alias("cy"), (F.floor(F.col("x2") / reach) + F.col("s.dx")).alias("cx"))
    d2 = (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2"))
    found = left.join(right, [*keys, "cy", "cx"]).groupBy(*keys).agg(F.min(d2).alias("d2"))
    found = found.select(*keys, F.when(F.col("d2") <= reach * reach, F.sqrt("d2")).alias("distance"))
    return a.select(*keys).distinct().join(found, list(keys), "left")


def nearest_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int = 8) -> DataFrame:
    """Smallest distance of two pixel sets by key of the first; null where the second has no pixel.

    Keys without an answer within `reach` are looked at again with four times the reach; the coordinates'
    extent ends it.
    """
    far = a.select("y", "x").union(b.select("y", "x")).agg(F.max(F.greatest("y", "x")) - F.min(F.least("y", "x"))).first()[0] or 0
    open_, parts = a.join(b.select(*keys).distinct(), list(keys), "left_semi"), []
    while True:
        now = least_distance(open_, b, keys, reach)
        parts.append(now.where("distance is not null"))
        if reach > 2 * far:
            break
        open_ = open_.join(now.where("distance is null"), list(keys), "left_semi")
        if open_.isEmpty():
            break
        reach *= 4
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return a.select(*keys).distinct().join(found, list(keys), "left")


def extreme_pair(df: DataFrame, keys: Sequence[str], farthest: bool = True) -> DataFrame:
    """Closest or farthest pair of a key's points. Farthest pairs lie on the outline rows: only each row's ends meet."""
    points = df.select(*keys, "y", "x").distinct()
    if farthest:
        ends = points.groupBy(*keys, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        points = ends.select(*keys, "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x"))
    other = points.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"))
    pairs = points.join(other, list(keys)).where("y < y2 or (y = y2 and x < x2)")
    d2 = (F.col("y2") - F.col("y")) * (F.col("y2") - F.col("y")) + (F.col("x2") - F.col("x")) * (F.col("x2") - F.col("x"))
    pairs = pairs.withColumn("d2", d2)
    order = F.struct(F.col("d2") if farthest else -F.col("d2"), -F.col("y"), -F.col("x"), -F.col("y2"), -F.col("x2"))
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct("y", "x", "y2", "x2", "d2"), order).alias("p"))
    return best.select(*keys, "p.y", "p.x", "p.y2", "p.x2", F.sqrt("p.d2").alias("distance"))


def box_counts(df: DataFrame, keys: Sequence[str], sides: Sequence[int]) -> DataFrame:
    """Occupied boxes per side, boxes counted from the shape's corner."""
    corner = df.groupBy(*keys).agg(F.min("y").alias("__y"), F.min("x").alias("__x"))
    spread = df.join(corner, list(keys)).withColumn("side", F.explode(F.array(*map(F.lit, sides))))
    cell = spread.select(*keys, "side", F.floor((F.col("y") - F.col("__y")) / F.col("side")).alias("by"), F.floor((F.col("x") - F.col("__x")) / F.col("side")).alias("bx")).distinct()
    return cell.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("boxes"))


def box_dimension(df: DataFrame, keys: Sequence[str], sides: Sequence[int]) -> DataFrame:
    """(fractal_dimension, fractal_r_value, fractal_box_nb): slope and correlation of log boxes on log 1/side; zeros below two sides."""
    logs = box_counts(df, keys, sides).select(*keys, F.log("boxes").alias("n"), F.log(F.lit(1.0) / F.col("side")).alias("s"))
    fit = logs.groupBy(*keys).agg(F.regr_slope("n", "s").alias("d"), F.corr("n", "s").alias("r"), F.count(F.lit(1)).alias("k"))
    fine = F.col("k") > 1
    value = lambda c: F.coalesce(F.when(fine & ~F.isnan(c), F.col(c)), F.lit(0.0))
    return fit.select(*keys, value("d").alias("fractal_dimension"), value("r").alias("fractal_r_value"), F.when(fine, F.col("k")).otherwise(0).alias("fractal_box_nb"))


def box_sides(least_side: int, least_mesh: int = 8, zoom_step: int = 0, min_side: int = 128) -> list[int]:
    """Box sides for a shape: powers of 2 downwards, or a range with a step; none for shapes that are too small."""
    if least_side < min_side:
        return []
    if zoom_step:
        return list(range(least_mesh, least_side, zoom_step))
    top, stop = least_side.bit_length() - 1, max(least_mesh // 2, 1).bit_length() - 1
    return [1 << k for k in range(top, stop, -1)]


def edge_grid(height: int, width: int) -> Column:
    """Whether (y, x) is on the image's border."""
    return (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)


def projections(df: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    """Pixels per row or column."""
    return df.groupBy(*keys, axis).agg(F.count(F.lit(1)).alias("pixels"))


def full_borders(df: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """How many of the four image borders are wholly foreground."""
    sums = df.groupBy(*keys).agg(*[F.sum(c.cast("int")).alias(n) for n, c in (("t", F.col("y") == 0), ("b", F.col("y") == height - 1), ("l", F.col("x") == 0), ("r", F.col("x") == width - 1))])
    full = sum(((F.col(n) == k).cast("int") for n, k in (("t", width), ("b", width), ("l", height), ("r", height))), F.lit(0))
    return sums.select(*keys, full.alias("full_borders"))
