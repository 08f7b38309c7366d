"""Descriptors of outlines, through pixel centres: perimeter, hull, rotated rectangle and their ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import descriptors, frames

FIELDS = "perimeter double, contour_points int, hull_points int, contour_area double, hull_area double, hull_perimeter double, box_long double, box_short double, total_hole_area int, euler_number int"


def measure(a):
    """Values of FIELDS for one frame: of the component with the longest outline."""
    best, n = None, K.label(a)
    for k in range(1, int(n.max()) + 1):
        path = K.trace(n == k)
        if best is None or len(path) > len(best):
            best = path
    hull = K.hull(best)
    sides = sorted(K.least_box(hull), reverse=True)
    holes = K.holes(a)
    return K.closed_length(best), len(best), len(hull), K.polygon_area(best), K.polygon_area(hull), K.closed_length(hull), sides[0], sides[1], int(holes.sum()), K.euler(a)


def outlines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FIELDS by frame."""

    def kernel(a, y0, x0):
        yield measure(a)

    return frames.run(frames.pack(df, keys), keys, kernel, FIELDS)


def shape_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Native and outline descriptors together, one row a frame with foreground."""
    o = outlines(df, keys)
    m = descriptors.moments(df, keys).join(o, list(keys))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return m.withColumns({
        "circularity": descriptors.circularity(F.col("area"), F.col("perimeter")),
        "rectangularity": descriptors.rectangularity(F.col("area"), F.col("box_long") * F.col("box_short")),
        "solidity": ratio("contour_area", "hull_area"),
        "convexity": ratio("hull_perimeter", "perimeter"),
    })
