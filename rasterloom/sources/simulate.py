"""Synthetic rasters as distributed generators: every pixel row is computed from its own numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def grid(spark: SparkSession, frames: int, height: int, width: int) -> DataFrame:
    n = height * width
    d = spark.range(frames * n)
    return d.select((F.col("id") / n).cast("int").alias("t"), (F.col("id") % n / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def places(spark: SparkSession, count: int, size: int, spacing: int, seed: int = 42) -> DataFrame:
    """`count` places (blob, cy, cx) without overlap: grid cells with the smallest hashes."""
    per = max(size // spacing, 1)
    cells = spark.range(per * per).select((F.col("id") / per).cast("int").alias("r"), (F.col("id") % per).cast("int").alias("c"))
    cells = cells.orderBy(F.xxhash64(F.lit(seed), "r", "c")).limit(count)
    return cells.select((F.row_number().over(_by()) - 1).alias("blob"), (F.col("r") * spacing + spacing // 2).alias("cy"), (F.col("c") * spacing + spacing // 2).alias("cx"))


def _by():
    from pyspark.sql import Window

    return Window.orderBy("r", "c")  # a handful of blobs


def growing_colonies(spark: SparkSession, frames: int = 20, size: int = 1000, count: int = 12, growth: float = 3.0, seed: int = 42) -> DataFrame:
    """Disks that start one after another and grow: (t, y, x, blob) of foreground pixels, made around each disk only."""
    p = places(spark, count, size, size // 4, seed).withColumn("start", (_uniform(seed, F.col("blob")) * frames / 2).cast("int"))
    d = p.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("r", (F.col("t") - F.col("start") + 1) * growth).where("r > 0")
    return _disk(d, size)


def _disk(d: DataFrame, size: int) -> DataFrame:
    r = F.ceil("r").cast("int")
    d = d.withColumn("dy", F.explode(F.sequence(-r, r))).withColumn("dx", F.explode(F.sequence(-r, r))).where("dy * dy + dx * dx <= r * r")
    d = d.select("t", (F.col("cy") + F.col("dy")).cast("int").alias("y"), (F.col("cx") + F.col("dx")).cast("int").alias("x"), "blob")
    return d.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < size) & (F.col("x") < size)).groupBy("t", "y", "x").agg(F.min("blob").alias("blob"))


def moving_cells(spark: SparkSession, size: int = 1000, cell: int = 50, count: int = 25, frames: int = 20, delta: int = 12, seed: int = 42) -> DataFrame:
    """Cells that move outwards from the centre by `delta` pixels a frame: (t, y, x, blob)."""
    p = places(spark, count, size, max(size // 5, cell), seed)
    a = F.atan2(F.col("cy") - size / 2, F.col("cx") - size / 2)
    d = p.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    d = d.withColumn("cy", F.bround(F.col("cy") + F.sin(a) * delta * F.col("t"), 0)).withColumn("cx", F.bround(F.col("cx") + F.cos(a) * delta * F.col("t"), 0)).withColumn("r", F.lit(cell / 2))
    return _disk(d, size)


def noisy_circle(spark: SparkSession, size: int, seed: int = 42) -> DataFrame:
    """(y, x) of a disk a third of whose outline is missing."""
    c, r = (size - 1) / 2, size / 2
    d = grid(spark, 1, size, size).withColumn("q", F.pow(F.col("y") - c, F.lit(2)) + F.pow(F.col("x") - c, F.lit(2))).where(F.col("q") <= r * r)
    rim = F.col("q") > (r - 1) * (r - 1)
    return d.where(~rim | (_uniform(seed, F.col("y"), F.col("x")) > 1 / 3)).select("y", "x")


def colorize(mask: DataFrame, keys: list[str], contrast: int = 100, fore_extent: int = 20, back_extent: int = 20, seed: int = 42) -> DataFrame:
    """mask (keys, y, x, on): adds b, g, r; foreground and background differ by `contrast` at least."""
    out = mask
    for c in ("b", "g", "r"):
        back = 20 + _uniform(seed, F.lit(c)) * (255 - contrast - fore_extent - back_extent - 20)
        noise = _uniform(seed, F.lit(c), *[F.col(k) for k in keys], F.col("y"), F.col("x"))
        out = out.withColumn(c, F.when(F.col("on"), back + back_extent + contrast + noise * fore_extent).otherwise(back + noise * back_extent).cast("int"))
    return out
