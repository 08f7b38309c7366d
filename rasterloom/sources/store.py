"""A store of arrays by key: a folder of Parquet tables, one a key, with rows (at, shape, data) that can be appended to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAY = "at long, shape array<int>, data binary"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share; of one machine's session under a temporary one."""
    import atexit
    import shutil
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_array(df: DataFrame, store: str, key: str) -> None:
    """df: at, shape, data; replaces what the key had."""
    df.select("at", "shape", "data").write.mode("overwrite").parquet(f"{store}/{key}")


def append_array(df: DataFrame, store: str, key: str) -> None:
    """Stacks df's rows after those that are there: `at` goes on from the last one. A key that isn't there yet is written."""
    spark = df.sparkSession
    after = -1
    if key in keys(spark, store):
        after = spark.read.schema(ARRAY).parquet(f"{store}/{key}").agg(F.max("at")).first()[0]
        after = -1 if after is None else after
    df.select((F.col("at") + after + 1).alias("at"), "shape", "data").write.mode("append").parquet(f"{store}/{key}")


def keys(spark: SparkSession, store: str) -> list[str]:
    """The store's keys in order; none where there is no store."""
    fs, where = _folder(spark, store)
    if not fs.exists(where):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory())


def read_array(spark: SparkSession, store: str, key: str) -> DataFrame | None:
    """The key's rows, or None where it isn't."""
    return spark.read.schema(ARRAY).parquet(f"{store}/{key}") if key in keys(spark, store) else None


def remove_key(spark: SparkSession, store: str, key: str) -> bool:
    """Whether the key was there; it isn't any more."""
    fs, where = _folder(spark, f"{store}/{key}")
    return bool(fs.delete(where, True))
