"""Scalar formulas as column expressions; all of them stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_uint8(v: Column) -> Column:
    """Round half to even and wrap into 0..255, as an unsigned byte would."""
    return F.pmod(F.bround(v, 0).cast("long"), F.lit(256)).cast("int")


def stretch_uint8(v: Column, low: Column, high: Column) -> Column:
    """Min-max stretch to 0..255; constant input gives 0."""
    return F.when(high > low, F.bround((v - low) * F.lit(255.0) / (high - low), 0)).otherwise(0).cast("int")


def linear_model(x: Column, a: Column | float, b: Column | float) -> Column:
    return x * a + b


def power_distance(v: Column, centre: Column, n: int) -> Column:
    return F.pow(v - centre, F.lit(n))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or nothing is known."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two equally long arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d))


def contour_width(height: Column, width: Column) -> Column:
    """Line width that fits an image's larger side, 2 at least."""
    return F.greatest(F.bround(F.log10(F.greatest(height, width)) - 2, 0), F.lit(2.0)).cast("int")


def scale_corners(low: Column, high: Column, scale: float, size: Column) -> tuple[Column, Column]:
    """Scale an interval about its centre and clip it to the image."""
    mid, half = (low + high) / 2, (high - low) / 2 * scale
    return F.greatest(F.bround(mid - half, 0), F.lit(0.0)).cast("int"), F.least(F.bround(mid + half, 0), size.cast("double")).cast("int")


def elliptic(y: Column, x: Column, height: Column, width: Column) -> Column:
    """Whether a pixel is in the ellipse that fills a height by width box."""
    ry, rx = height / 2, width / 2
    return F.pow((y + 0.5 - ry) / ry, F.lit(2)) + F.pow((x + 0.5 - rx) / rx, F.lit(2)) <= 1


def on_border(y: Column, x: Column, height: Column, width: Column) -> Column:
    return (y == 0) | (x == 0) | (y == height - 1) | (x == width - 1)


def short_path(path: Column, start: int, end: int) -> Column:
    """First and last characters of a path with dots between; short paths stay."""
    return F.when(F.length(path) > start + end, F.concat(F.substring(path, 1, start), F.lit("..."), F.right(path, F.lit(end)))).otherwise(path)


def natural_key(name: Column) -> Column:
    """A string whose order is the natural order of names: runs of digits are padded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def gradient_colour(value: Column, low: Column, high: Column) -> Column:
    """Blue to red gradient as (r, g, b) of 0..255."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    return F.array(F.bround(share * 255, 0).cast("int"), F.lit(0), F.bround((F.lit(1.0) - share) * 255, 0).cast("int"))


def colour_steps(a: tuple[int, int, int], b: tuple[int, int, int], i: Column, steps: int) -> Column:
    """Colour i of `steps` between two colours, ends included."""
    share = i / F.lit(float(max(steps - 1, 1)))
    return F.array(*[F.bround(F.lit(float(p)) + (q - p) * share, 0).cast("int") for p, q in zip(a, b)])


def smallest_type(low: Column, high: Column) -> Column:
    """Name of the narrowest whole-number type, unsigned if nothing is below 0, that holds low..high."""
    unsigned, signed = F.lit("uint64"), F.lit("int64")
    for bits in (32, 16, 8):
        unsigned = F.when(high < 1 << bits, f"uint{bits}").otherwise(unsigned)
        signed = F.when((low >= -(1 << bits - 1)) & (high < 1 << bits - 1), f"int{bits}").otherwise(signed)
    return F.when(low >= 0, unsigned).otherwise(signed)
