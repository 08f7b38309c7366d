"""Operators on ordered series: DataFrames with keys, an order column and a value. One window shuffle by key each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _w(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, step: int, out: str = "smooth") -> DataFrame:
    """Mean over unknown-skipping neighbours that shrinks at the ends.

    Offsets are 1..ceil((step-1)/2) ahead and 1..floor((step-1)/2)-1 behind; an offset k counts only
    where both i-k and i+k are inside the series.
    """
    w = _w(keys, order)
    i, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ahead, behind = math.ceil((step - 1) / 2), math.floor((step - 1) / 2)
    known = F.when(~F.isnan(F.col(value)), F.col(value))
    terms = [known]
    inside = lambda k: (i >= k) & (i <= n - 1 - k)
    terms += [F.when(inside(k), F.lead(known, k).over(w)) for k in range(1, ahead + 1)]
    terms += [F.when(inside(k), F.lag(known, k).over(w)) for k in range(1, behind)]
    total, count = F.lit(0.0), F.lit(0)
    for t in terms:
        total, count = total + F.coalesce(t, F.lit(0.0)), count + t.isNotNull().cast("int")
    return df.withColumn(out, total / F.when(count > 0, count))


def edge_padded_mean(df: DataFrame, keys: list[str], order: str, value: str, step: int, out: str = "smooth") -> DataFrame:
    """Box mean of `step` values, step // 2 of them before; beyond the ends the end values are repeated."""
    w, all_ = _w(keys, order), _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(all_), F.last(value).over(all_)
    before, after = step // 2, step - 1 - step // 2
    total = F.col(value)
    for k in range(1, before + 1):
        total = total + F.coalesce(F.lag(value, k).over(w), first)
    for k in range(1, after + 1):
        total = total + F.coalesce(F.lead(value, k).over(w), last)
    return df.withColumn(out, total / F.lit(float(step)))


def gradient(keys: list[str], order: str, value: str, spacing: float = 1.0) -> Column:
    """Central differences inside, one-sided at the ends; null for a single value."""
    w = _w(keys, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * spacing)).when(b.isNotNull(), (b - F.col(value)) / spacing).when(a.isNotNull(), (F.col(value) - a) / spacing)


def first_reaching(df: DataFrame, keys: list[str], order: str, value: str, margin: float, out: str = "first_move") -> DataFrame:
    """Per key the first order at which the value is at least the first value plus a margin, else null."""
    start = df.withColumn("__first", F.first(value).over(_w(keys, order)))
    return start.groupBy(*keys).agg(F.min(F.when(F.col(value) >= F.col("__first") + margin, F.col(order))).alias(out))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and correlation; 0 where degenerate."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.avg(y).alias("__mean"))
    r = F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0))
    return fit.select(*keys, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "__mean").alias("intercept"), r.alias("r"))


def block_means(df: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    """Means of consecutive whole blocks of `size` values, the rest dropped."""
    block = F.floor(F.col(index) / size).alias("block")
    return df.groupBy(*keys, block).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size).drop("__n")


def slope_shifts(df: DataFrame, keys: list[str], index: str, value: str, size: int, rising: bool = True) -> DataFrame:
    """Blocks after which the block means change less (rising) or more (falling) than the series' mean step."""
    w = _w(keys, index)
    step = df.withColumn("__d", F.col(value) - F.lag(value).over(w)).groupBy(*keys).agg(F.avg("__d").alias("mean_step"))
    blocks = block_means(df, keys, index, value, size)
    change = F.lead("mean").over(Window.partitionBy(*keys).orderBy("block")) - F.col("mean")
    found = blocks.withColumn("change", change).join(step, keys).where("change is not null")
    return found.where(F.col("change") < F.col("mean_step") if rising else F.col("change") > F.col("mean_step")).select(*keys, "block", "change", "mean_step")


def run_bounds(df: DataFrame, keys: list[str], order: str, full: str, out: str = "edge") -> DataFrame:
    """1 where a run of true values begins, -1 where the one before has ended; other rows go."""
    w = _w(keys, order)
    now, before, after = F.col(full).cast("int"), F.coalesce(F.lag(F.col(full).cast("int")).over(w), F.lit(0)), F.coalesce(F.lead(F.col(full).cast("int")).over(w), F.lit(0))
    return df.select(*keys, order, ((now == 1) & (before == 0)).alias("starts"), ((now == 1) & (after == 0)).alias("ends")).where("starts or ends")


def poisson_sums(values: np.ndarray, counts: np.ndarray, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Per round the sum and the number of the rows it draws: values[i] stands for counts[i] rows, each drawn Poisson(1) times.

    Both ways are exact. n rows are drawn Poisson(n) times in all, each draw any of them: quicker for few equal
    values. A value's own Poisson(n) is one draw however many rows it stands for.
    """
    total, number = np.zeros(rounds), np.zeros(rounds, np.int64)
    few = counts <= 8
    rows = np.repeat(values[few], counts[few])
    step = max(1, (1 << 16) // max(len(rows), 1))
    for a in range(0, rounds if len(rows) else 0, step):
        drawn = rng.poisson(len(rows), min(step, rounds - a))
        starts, some = np.cumsum(drawn) - drawn, np.flatnonzero(drawn)
        if len(some):
            total[a + some] += np.add.reduceat(rows[rng.integers(0, len(rows), drawn.sum())], starts[some])
        number[a : a + len(drawn)] += drawn
    v, n = values[~few], counts[~few]
    step = max(1, (1 << 16) // max(len(v), 1))
    for a in range(0, rounds if len(v) else 0, step):
        drawn = rng.poisson(n, (min(step, rounds - a), len(v)))
        total[a : a + step] += np.where(drawn > 0, drawn * v, 0.0).sum(1)
        number[a : a + step] += drawn.sum(1)
    return total, number


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, rounds: int = 1000, seed: int = 7, chunk: int = 4096) -> DataFrame:
    """Mean and the 2.5 % and 97.5 % quantiles of resampled means; null for keys without known values, NaN for those with a NaN.

    Poisson resampling: in each round a row counts k times with Poisson(1) chance. Equal values of a key are
    counted first, and hashed to chunks of about `chunk` different ones. A chunk meets 2,500 rounds at a time in
    one task, whose generator is seeded by seed, key, chunk and first round: the draws are the same whatever the
    partitions. A task holds a chunk and sums are partial, so a key or a value of any size is fine.
    """
    import pyarrow as pa

    spark, block = df.sparkSession, 2500
    counts = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null").groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__chunks"))
    dealt = _beside(counts, sizes, keys).withColumn("__chunk", F.pmod(F.xxhash64("__v"), F.col("__chunks")))
    chunks = dealt.groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(F.struct("__v", "__n"))).alias("__c"))
    units = chunks.select(*keys, F.xxhash64(F.lit(0), *keys).alias("__key"), "__chunk", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(block))).alias("__first"), "__c.__v", "__c.__n")
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def draw(batches):
        for batch in batches:
            at = len(keys)
            for i in range(batch.num_rows):
                key, part, first = (batch.column(at + j)[i].as_py() for j in range(3))
                v, n = (np.asarray(batch.column(at + j)[i].values) for j in (3, 4))
                here = min(block, rounds - first)
                total, number = poisson_sums(v, n, here, np.random.default_rng([seed, key % (1 << 64), part, first]))
                own = pa.array(np.full(here, i))
                columns = [*(batch.column(j).take(own) for j in range(at)), pa.array(np.arange(first, first + here, dtype=np.int32)), pa.array(total), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "__round", "__s", "__k"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    drawn = units.repartition(tasks, *keys, "__chunk", "__first").mapInArrow(draw, f"{types}, __round int, __s double, __k long")
    means = drawn.groupBy(*keys, "__round").agg((F.sum("__s") / F.when(F.sum("__k") > 0, F.sum("__k"))).alias("__m"))
    ends = means.groupBy(*keys).agg(F.percentile("__m", 0.025).alias("low"), F.percentile("__m", 0.975).alias("high"))
    found = _beside(df.groupBy(*keys).agg(F.avg(value).alias("mean")), ends, keys, "left")
    return found.withColumns({c: F.when(F.isnan("mean"), F.col("mean")).otherwise(F.col(c)) for c in ("low", "high")})


def _beside(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of `other`; null keys meet null keys."""
    named = other.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    return df.join(named, same, how).drop(*[f"__key_{k}" for k in keys])
