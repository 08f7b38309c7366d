"""Shape descriptors that are aggregates of foreground pixels: one shuffle for all of them, partial sums before it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = ("perimeter", "major_axis_len", "minor_axis_len")
AREAS = ("area", "total_hole_area", "newly_explored_area", "final_area")
NATIVE = ("area", "cx", "cy", "standard_deviation_x", "standard_deviation_y", "skewness_x", "skewness_y", "kurtosis_x", "kurtosis_y", "major_axis_len", "minor_axis_len", "axes_orientation", "eccentricity")


def raw_moments(df: DataFrame, keys: Sequence[str], order: int = 3) -> DataFrame:
    """Sums of x^p y^q, p + q up to `order`."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def power(c: Column, n: int) -> Column:
        out = F.lit(1.0)
        for _ in range(n):
            out = out * c
        return out

    return df.groupBy(*keys).agg(*[F.sum(power(x, p) * power(y, q)).alias(f"m{p}{q}") for p in range(order + 1) for q in range(order + 1 - p)])


def moments(df: DataFrame, keys: Sequence[str], wanted: Iterable[str] = NATIVE) -> DataFrame:
    """The wanted native descriptors. Axes are sqrt(6 (c20 + c02 +- sqrt(4 c11^2 + (c20 - c02)^2))); kurtosis isn't excess.

    Second moments come from whole sums, so that a shape as wide as it is high has equal ones: its
    orientation is 0, whatever the order of its pixels. y and x are whole numbers. Skewness and kurtosis
    come from whole sums too, as long as doubles hold them (up to some 6,000 for area times extent), so
    that values like 1.9178125 are rounded up and not by noise; of larger shapes they have running means.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    d3, d4 = (lambda c: c.cast("double") * c * c), (lambda c: c.cast("double") * c * c * c)
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        F.skewness("x").alias("skx"), F.skewness("y").alias("sky"), F.kurtosis("x").alias("kux"), F.kurtosis("y").alias("kuy"),
        F.sum(d3(x)).alias("x3"), F.sum(d4(x)).alias("x4"), F.sum(d3(y)).alias("y3"), F.sum(d4(y)).alias("y4"),
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    central = lambda pq, p, q: ((wide("area") * wide(pq) - wide(p) * wide(q)).cast("double") / (F.col("area").cast("double") * F.col("area")))
    g = g.withColumns({"c20": central("sxx", "sx", "sx"), "c02": central("syy", "sy", "sy"), "c11": central("sxy", "sx", "sy")})
    known = lambda c, extra=0: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.col(c) + extra)
    n = F.col("area").cast("double")

    def shaped(c: str, streamed: Column, power: int) -> Column:
        """Skewness (3) or kurtosis (4) of an axis; no term exceeds 6 n^3 times the sum of fourth powers."""
        a, b, third, fourth = (F.col(k).cast("double") for k in (f"s{c}", f"s{c}{c}", f"{c}3", f"{c}4"))
        wide = n * b - a * a
        if power == 3:
            out = (n * n * third - 3 * n * a * b + 2 * a * a * a) / (wide * F.sqrt(wide))
        else:
            out = (n * n * n * fourth - 4 * n * n * a * third + 6 * n * a * a * b - 3 * a * a * a * a) / (wide * wide)
        return F.when(6 * n * n * n * fourth < float(1 << 53), F.when(wide > 0, out).otherwise(0.0)).otherwise(streamed)

    root = F.sqrt(4 * F.col("c11") * F.col("c11") + F.pow(F.col("c20") - F.col("c02"), F.lit(2)))
    major, minor = F.sqrt(6 * (F.col("c20") + F.col("c02") + root)), F.sqrt(F.greatest(6 * (F.col("c20") + F.col("c02") - root), F.lit(0.0)))
    angle = F.when(F.col("c20") == F.col("c02"), 0.0).otherwise(0.5 * F.atan(2 * F.col("c11") / (F.col("c20") - F.col("c02"))) + F.when(F.col("c20") < F.col("c02"), F.pi() / 2).otherwise(0.0))
    have = {
        "area": F.col("area"), "cx": F.col("cx"), "cy": F.col("cy"), "standard_deviation_x": F.sqrt("c20"), "standard_deviation_y": F.sqrt("c02"),
        "skewness_x": shaped("x", known("skx"), 3), "skewness_y": shaped("y", known("sky"), 3), "kurtosis_x": shaped("x", known("kux", 3), 4), "kurtosis_y": shaped("y", known("kuy", 3), 4), "major_axis_len": major, "minor_axis_len": minor,
        "axes_orientation": angle, "eccentricity": F.when(major > 0, F.sqrt(F.greatest(1 - F.pow(minor / major, F.lit(2)), F.lit(0.0)))).otherwise(0.0),
    }
    return g.select(*keys, *[have[w].alias(w) for w in have if w in set(wanted)])


def circularity(area: Column, perimeter: Column) -> Column:
    return F.coalesce(4 * F.pi() * area / F.when(perimeter > 0, perimeter * perimeter), F.lit(0.0))


def rectangularity(area: Column, box: Column) -> Column:
    return F.coalesce(area / F.when(box > 0, box), F.lit(0.0))


def scale(df: DataFrame, pixel_size: float, unit_mode: str = "corrected") -> DataFrame:
    """Pixel units to millimetres; pixel_size is mm2 a pixel. "corrected": lengths by its root and areas by it; "reference": the other way round, as some tools have it."""
    root = pixel_size**0.5
    length, area = (root, pixel_size) if unit_mode == "corrected" else (pixel_size, root)
    factor = {c: length for c in LENGTHS} | {c: area for c in AREAS}
    return df.withColumns({c: F.col(c) * F.lit(factor[c]) for c in df.columns if c in factor})


def per_frame(df: DataFrame, frames: DataFrame, keys: Sequence[str] = ("arena", "t"), wanted: Iterable[str] = NATIVE) -> DataFrame:
    """One row per frame; frames without foreground have zeros."""
    found = moments(df, keys, wanted)
    out = frames.select(*keys).join(found, list(keys), "left")
    return out.na.fill(0)
