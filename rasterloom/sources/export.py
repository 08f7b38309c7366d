"""Sinks: result tables as CSV, frames as images, tables by arena that can be replaced one by one."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, sep: str = ";") -> None:
    """A table as CSV with a header, in as many files as it has partitions."""
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def read_results(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    return spark.read.option("header", "true").option("sep", sep).schema(schema).csv(path)


def write_by_arena(df: DataFrame, path: str, arena: str = "arena", mode: str = "overwrite") -> None:
    """Parquet partitioned by arena; overwriting replaces only the arenas that df has."""
    df.repartition(arena).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(arena).parquet(path)


def read_arena(spark: SparkSession, path: str, arena, column: str = "arena") -> DataFrame:
    """One arena's rows; only its folder is read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(arena))


def write_settings(spark: SparkSession, path: str, settings: dict) -> None:
    import json

    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict | None:
    """Settings as written, or None where they are missing or broken."""
    import json

    from pyspark.errors import PySparkException

    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (PySparkException, ValueError, TypeError):
        return None


def png(a: np.ndarray) -> bytes:
    """An 8-bit grey or colour image as a PNG file."""
    h, w = a.shape[:2]
    c = 1 if a.ndim == 2 else a.shape[2]
    lines = np.column_stack([np.zeros(h, np.uint8), a.reshape(h, w * c).astype(np.uint8)])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(frames: DataFrame, folder: str, name: Sequence[str]) -> DataFrame:
    """Writes frames (height, width, channels, data) as PNG files named by the given columns; returns (path, size)."""
    import pyarrow as pa

    cols = [*name, "height", "width", "channels", "data"]

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                h, w, c, data = row[-4:]
                body = png(np.frombuffer(data, np.uint8).reshape((h, w, c) if c > 1 else (h, w)))
                path = f"{base}/{'_'.join(map(str, row[:-4]))}.png"
                with fs.open_output_stream(path) as f:
                    f.write(body)
                done.append((path, len(body)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "size"])

    return frames.select(*cols).mapInArrow(run, "path string, size long")


def video_needs_writing(listing: DataFrame, arenas: int, images: bool, overwrite: bool) -> bool:
    """Whether arena videos are to be written: from images only, and if any is missing or they are to be replaced."""
    return bool(images and (overwrite or listing.select("path").distinct().count() < arenas))
