"""Thresholds and segmentations of pixel tables (keys, y, x, v): histograms, not pixels, meet in the windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, keys: Sequence[str], value: str = "v", bins: int = 256) -> DataFrame:
    """(keys, low, high, bin, n): equal bins between each key's least and greatest value, the last one closed."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    joined = df.join(ends, list(keys))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(0)
    return joined.groupBy(*keys, "low", "high", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu_thresholds(df: DataFrame, keys: Sequence[str], value: str = "v", bins: int = 256) -> DataFrame:
    """(keys, threshold): middle of the bin with the greatest variance between classes, the first of equals."""
    h = histogram(df, keys, value, bins)
    mid = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    h = h.withColumn("mid", mid).withColumn("s", F.col("n") * mid)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    c = h.select(*keys, "bin", "mid", "low", F.sum("n").over(up).alias("w1"), F.sum("s").over(up).alias("s1"), F.sum("n").over(down).alias("w2"), F.sum("s").over(down).alias("s2"))
    var = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2"), F.lit(2))
    c = c.withColumn("var", F.coalesce(F.round(var, 6), F.lit(-1.0)))
    best = c.groupBy(*keys).agg(F.max_by(F.struct("mid", "low", "w2"), F.struct("var", -F.col("bin"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.w2").isNull(), F.col("b.low")).otherwise(F.col("b.mid")).alias("threshold"))


def above(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str = "v", invert_large: bool = False) -> DataFrame:
    """Pixels above their key's threshold; with invert_large those not above it where they'd be half of all or more."""
    t = df.join(thresholds, list(keys)).withColumn("on", F.col(value) > F.col("threshold"))
    if not invert_large:
        return t.where("on").drop("on", "threshold")
    share = t.groupBy(*keys).agg((F.sum(F.col("on").cast("int")) * 2 >= F.count(F.lit(1))).alias("flip"))
    return t.join(share, list(keys)).where(F.col("on") != F.col("flip")).drop("on", "threshold", "flip")


def otsu_segmentation(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return above(df, otsu_thresholds(df, keys, value), keys, value, invert_large=True)


def drifting_thresholds(background: DataFrame, keys: Sequence[str], threshold: float | DataFrame) -> DataFrame:
    """background: keys, t, level. The threshold, one or each key's own (keys, threshold), moves with each frame's background level against the last frame's; if any leaves 0..255 the key has none."""
    w = Window.partitionBy(*keys)
    last = F.max_by("level", "t").over(w)
    own = background.join(threshold, list(keys)) if isinstance(threshold, DataFrame) else background.withColumn("threshold", F.lit(float(threshold)))
    d = own.withColumn("threshold", F.col("threshold") + F.col("level") - last)
    d = d.withColumn("fine", F.bool_and((F.col("threshold") >= 0) & (F.col("threshold") <= 255)).over(w))
    return d.where("fine").select(*keys, "t", "threshold")


def background_levels(df: DataFrame, keys: Sequence[str], lighter: bool, value: str = "v") -> DataFrame:
    """Per frame the 0.9 (light background) or 0.1 quantile, linearly interpolated."""
    return df.groupBy(*keys, "t").agg(F.percentile(value, 0.9 if lighter else 0.1).alias("level"))


def luminance_segmentation(df: DataFrame, background: DataFrame, keys: Sequence[str], threshold: float | DataFrame, lighter: bool, value: str = "v") -> DataFrame:
    """Pixels darker (light background) or brighter than their frame's threshold."""
    t = drifting_thresholds(background, keys, threshold)
    test = F.col(value) < F.col("threshold") if lighter else F.col(value) > F.col("threshold")
    return df.join(t, [*keys, "t"]).where(test).select(*keys, "t", "y", "x")


#: Excess over the covering value that is tried, in this order.
GRID = (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, -0.1, -0.2, -0.3, -0.4, -0.5, -0.6)


def threshold_grid(df: DataFrame, covering: DataFrame, keys: Sequence[str], lighter: bool, limit: Column | float, value: str = "v") -> DataFrame:
    """(keys, place, threshold, area, change, fine): every candidate threshold with its largest frame area and largest change between frames.

    covering: keys, base. Frames are dealt to candidates once; areas and changes are sums by frame.
    """
    e = F.posexplode(F.array(*[F.lit(x) for x in GRID])).alias("place", "e")
    cand = covering.select(*keys, "base", e)
    cand = cand.select(*keys, "place", ((1 + F.col("e")) * F.col("base") if lighter else (1 - F.col("e")) * F.col("base")).alias("threshold"))
    w = Window.partitionBy(*keys, "y", "x").orderBy("t")
    steps = df.select(*keys, "t", F.col(value).alias("now"), F.lag(value).over(w).alias("before"))
    test = lambda c: (F.col(c) < F.col("threshold") if lighter else F.col(c) > F.col("threshold")).cast("int")
    on = steps.join(cand, list(keys)).select(*keys, "t", "place", "threshold", test("now").alias("on"), F.when(F.col("before").isNotNull(), F.abs(test("now") - test("before"))).alias("moved"))
    frames = on.groupBy(*keys, "place", "threshold", "t").agg(F.sum("on").alias("area"), F.coalesce(F.sum("moved"), F.lit(0)).alias("change"))
    most = frames.groupBy(*keys, "place", "threshold").agg(F.max("area").alias("area"), F.max("change").alias("change"))
    lim = F.lit(limit) if not isinstance(limit, Column) else limit
    return most.withColumn("fine", (F.col("area") < lim) & (F.col("change") < lim))


def pick_threshold(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The third threshold of the first run of fine ones, the last of a shorter run, 0 without any."""
    w = Window.partitionBy(*keys).orderBy("place")
    run = grid.withColumn("breaks", F.sum((~F.col("fine")).cast("int")).over(w))
    run = run.where("fine").withColumn("first_run", F.min("breaks").over(Window.partitionBy(*keys))).where("breaks = first_run")
    run = run.withColumn("n", F.row_number().over(w)).where("n <= 3")
    best = run.groupBy(*keys).agg(F.max_by("threshold", "n").alias("threshold"))
    return grid.select(*keys).distinct().join(best, list(keys), "left").select(*keys, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def mask_threshold(df: DataFrame, mask: DataFrame, keys: Sequence[str], least: int = 0, value: str = "v") -> DataFrame:
    """Smallest whole threshold (0..255) above which more pixels lie inside the mask than outside; null without any."""
    marked = df.join(mask.select(*keys, "y", "x").withColumn("inside", F.lit(1)), [*keys, "y", "x"], "left")
    h = marked.groupBy(*keys, F.floor(value).cast("int").alias("bin")).agg(F.sum(F.when(F.col("inside") == 1, 1).otherwise(-1)).alias("d"))
    edges = h.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(least), F.lit(255))))
    full = edges.join(h, [*keys, "bin"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    rest = F.sum("d").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing))
    scored = full.withColumn("more", F.coalesce(rest, F.lit(0)))
    return scored.groupBy(*keys).agg(F.min(F.when(F.col("more") > 0, F.col("bin"))).alias("threshold"))


def inside_outside(df: DataFrame, mask: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """(keys, inside, outside, lighter_background): means in and off the mask."""
    marked = df.join(mask.select(*keys, "y", "x").withColumn("m", F.lit(1)), [*keys, "y", "x"], "left")
    m = marked.groupBy(*keys).agg(F.avg(F.when(F.col("m") == 1, F.col(value))).alias("inside"), F.avg(F.when(F.col("m").isNull(), F.col(value))).alias("outside"))
    return m.withColumn("lighter_background", F.col("outside") > F.col("inside"))


def subtract_background(df: DataFrame, background: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Difference to a background image (y, x, b), its sign so that the total isn't negative."""
    d = df.join(background.select("y", "x", "b"), ["y", "x"], "left").withColumn("d", F.col(value) - F.coalesce("b", F.lit(0.0)))
    sign = d.groupBy(*keys).agg(F.when(F.sum("d") < 0, -1.0).otherwise(1.0).alias("sign"))
    return d.join(sign, list(keys)).withColumn(value, F.greatest(F.col("d") * F.col("sign"), F.lit(0.0))).drop("d", "sign", "b")


def local_votes(df: DataFrame, keys: Sequence[str], side: int, step: int, least_variation: float = 0.0, value: str = "v") -> DataFrame:
    """Sliding-window thresholds: each window splits its pixels by its own threshold, flat windows vote no; a pixel is on by more yes than half of its votes."""
    lows = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - side) / step) + 1), F.floor(F.col(c) / step))
    w = df.withColumn("wy", F.explode(lows("y"))).withColumn("wx", F.explode(lows("x")))
    cell = [*keys, "wy", "wx"]
    t = otsu_thresholds(w, cell, value).join(w.groupBy(*cell).agg((F.max(value) - F.min(value)).alias("span")), cell)
    yes = ((F.col(value) > F.col("threshold")) & (F.col("span") > least_variation)).cast("int")
    votes = w.join(t, cell).groupBy(*keys, "y", "x").agg(F.avg(yes).alias("share"))
    return votes.where("share > 0.5").select(*keys, "y", "x")


def kmeans_pixels(df: DataFrame, clusters: int = 2, value: str = "v", seed: int = 1) -> DataFrame:
    """Adds `cluster` 0.. by rising mean: seeded k-means over all pixels, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[value], outputCol="__f").transform(df)
    model = KMeans(k=clusters, seed=seed, featuresCol="__f", predictionCol="__c", maxIter=20).fit(data)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: float(model.clusterCenters()[i][0]))
    rank = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(order))]), F.col("__c") + 1)
    return model.transform(data).withColumn("cluster", rank).drop("__f", "__c")


def choose_cluster(df: DataFrame, bio: DataFrame | None = None, back: DataFrame | None = None, on: Sequence[str] = ("y", "x")) -> DataFrame:
    """The specimen's cluster: the one most hit by a specimen mask, or the most frequent one that a background mask doesn't hit most, or the second most frequent."""
    n = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    if bio is not None:
        hit = df.join(bio.select(*on).distinct(), list(on), "left_semi").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        return hit.orderBy(F.desc("n"), "cluster").limit(1).select("cluster")
    if back is not None:
        hit = df.join(back.select(*on).distinct(), list(on), "left_semi").groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(1)
        return n.join(hit.select("cluster"), "cluster", "left_anti").orderBy(F.desc("n"), "cluster").limit(1).select("cluster")
    return n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))).where("r = 2").select("cluster")


def first_component(df: DataFrame, keys: Sequence[str], channels: Sequence[str] = ("b", "g", "r")) -> DataFrame:
    """Scores on the first principal component of the standardised channels, by key, and its share of variance.

    A frame's covariance is nine sums; its eigenvector is found per frame from those, and pixels are
    multiplied by it in place.
    """
    import numpy as np
    import pyarrow as pa

    c = list(channels)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(c)] + [F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(c)]
    sums += [F.corr(F.col(c[i]).cast("double"), F.col(c[j]).cast("double")).alias(f"r{i}{j}") for i in range(len(c)) for j in range(i)]
    stats = df.groupBy(*keys).agg(*sums)
    k = len(c)

    def solve(batches):
        for batch in batches:
            d = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            vec, share = [], []
            for row in range(len(batch)):
                m = np.eye(k)
                for i in range(k):
                    for j in range(i):
                        r = d[f"r{i}{j}"][row]
                        m[i, j] = m[j, i] = 0.0 if r is None or r != r else r
                e, v = np.linalg.eigh(m)
                w = v[:, -1] * (1 if v[np.abs(v[:, -1]).argmax(), -1] > 0 else -1)
                vec.append(w.tolist())
                share.append(float(e[-1] / e.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vec, pa.list_(pa.float64())), pa.array(share)], names=[*batch.schema.names, "axis", "variance_share"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*stats.schema.fields, StructField("axis", ArrayType(DoubleType())), StructField("variance_share", DoubleType())])
    axes = stats.mapInArrow(solve, schema)
    score = F.lit(0.0)
    for i, x in enumerate(c):
        score = score + F.coalesce((F.col(x) - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")), F.lit(0.0)) * F.element_at("axis", i + 1)
    return df.join(axes, list(keys)).select(*df.columns, score.alias("pc1"), "variance_share")
