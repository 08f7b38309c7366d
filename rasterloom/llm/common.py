"""Shared plumbing: the shared folder, cutting lineage, file access from tasks, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are separated by ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
_MADE: list[str] = []
_OWN: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a session of one machine gets a temporary one, and a cluster an error."""
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _OWN is None:
            _OWN = tempfile.mkdtemp(prefix="rasterloom-")
            atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
        root = f"file://{_OWN}"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root."""
    _MADE.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def sweep(spark: SparkSession) -> int:
    """Deletes the folders that this driver has made, once their results aren't needed any more; returns how many were there."""
    n = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later steps then start from files that outlive any executor, and steps with side effects or
    costly kernels run once however often the result is used.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null, without building an array of them."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def open_fs(uri: str):
    """(file system, path) for a URI or plain path, usable in a task."""
    import pyarrow.fs as pafs

    if "://" not in uri:
        if uri.startswith("file:"):
            uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write an iterable of bytes-like chunks as a new file; returns its size."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    n = 0
    with fs.open_output_stream(path) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    return n


def spread(files: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """A few rows that each stand for a file, a task for each up to `most`: a number is given, as rows this small would be coalesced into one task."""
    return files.repartition(max(1, min(most, files.count())), F.col(key))


_LEAN = False


def lean_memory() -> None:
    """Once a worker: memory that arrays leave goes back to the system at once.

    Workers live on between stages; without this they'd keep what the largest one needed.
    """
    global _LEAN
    if _LEAN:
        return
    _LEAN = True
    import ctypes

    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        for option, value in ((-3, 1 << 20), (-1, 1 << 22), (-8, 2)):  # map from 1 MB on, trim from 4 MB on, two arenas
            mallopt(option, value)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows 0, 1, ... in `order` without gathering them in one task.

    Range partitions are numbered locally; each adds the prefix sum of the sizes of those before it.
    Only one row per partition meets in the sum.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = local.withColumn("__pid", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = settle(local, "rank")
    sizes = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    bases = sizes.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__base"))
    return local.join(bases, "__pid").withColumn(name, F.col("__base") + F.col("__i")).drop("__pid", "__i", "__base")


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most `size` for what runs inside: wide rows are held a few times over on their way to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def components(links: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long) by alternating large-star and small-star steps.

    Returns (id, component_id) for every id on a link; component_id is the smallest id reachable.
    Links (u, v), u > v, shrink to stars around the smallest ids in about log rounds. A step asks for
    the smallest of a node's smaller neighbours; those are summed up in part before the shuffle. A
    centre with very many larger neighbours is one side's hot key in a join, which is split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, name)
    before = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        # Large star: larger neighbours of v, and v itself, go to the smallest neighbour of v.
        up = low.select(F.col("u").alias("w"), "m")
        large = edges.join(up, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).union(low.select("u", "m"))
        # Small star: smaller neighbours of u, and u itself, go to the smallest of them.
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = large.join(least, F.col("u") == F.col("x"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        both = F.explode(F.when(F.col("v") == F.col("m"), F.array(pair("u"))).otherwise(F.array(pair("u"), pair("v")))).alias("e")
        edges = settle(large.select(both).select("e.u", "e.v").distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
