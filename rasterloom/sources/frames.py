"""Frame files as DataFrames: listing in natural order, decoding, capture times, and a data source of frames.

Decoders are plain: .npy (images or stacks), .pgm and .ppm, .png (8-bit, not interlaced), .jpg
(baseline), .avi (uncompressed or motion JPEG) and uncompressed .tif stacks. Others can be registered
in DECODERS.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.formulas import natural_key
from . import jpeg, video

FRAME = "path string, page int, height int, width int, channels int, data binary"


def _npy(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def _netpbm(raw: bytes) -> np.ndarray:
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while end < len(raw) and raw[end : end + 1].isspace():
            end += 1
        if raw[end : end + 1] == b"#":
            at = raw.index(b"\n", end)
            continue
        at = end
        while not raw[at : at + 1].isspace():
            at += 1
        fields.append(raw[end:at])
    kind, w, h, _ = fields[0], *map(int, fields[1:])
    c = {b"P5": 1, b"P6": 3}[kind]
    return np.frombuffer(raw, np.uint8, w * h * c, at + 1).reshape(h, w, c)


def _png(raw: bytes) -> np.ndarray:
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, palette = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    if depth != 8 or lace:
        raise ValueError("only 8-bit PNG files without interlace")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h, w * c), np.uint8)
    above = np.zeros(w * c, np.int64)
    for y in range(h):
        how, row = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 2:
            row = row + above
        elif how == 1:
            row = np.cumsum(row.reshape(w, c), 0).ravel()
        elif how in (3, 4):
            for i in range(w * c):
                a, b, d = (row[i - c] if i >= c else 0), above[i], (above[i - c] if i >= c else 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row[i] = (row[i] + guess) & 255
        above = row & 255
        out[y] = above
    image = out.reshape(h, w, c)
    return palette[image[:, :, 0]] if palette is not None else image


def _tiff(raw: bytes) -> np.ndarray:
    e = {b"II": "<", b"MM": ">"}[raw[:2]]
    at, pages = struct.unpack(e + "I", raw[4:8])[0], []
    size = {1: 1, 3: 2, 4: 4}
    while at:
        n = struct.unpack(e + "H", raw[at : at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(e + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in size:
                where = at + 10 + 12 * k
                if size[kind] * count > 4:
                    where = struct.unpack(e + "I", raw[where : where + 4])[0]
                tags[tag] = struct.unpack(f"{e}{count}{'BHI'[(1, 3, 4).index(kind)]}", raw[where : where + size[kind] * count])
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("only uncompressed TIFF files")
        w, h, bits, c = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(277, (1,))[0]
        body = b"".join(raw[o : o + m] for o, m in zip(tags[273], tags[279]))
        pages.append(np.frombuffer(body, f"{e}u{bits // 8}").reshape(h, w, c))
        at = struct.unpack(e + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return np.stack(pages)


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"npy": _npy, "pgm": _netpbm, "ppm": _netpbm, "png": _png, "tif": _tiff, "tiff": _tiff, "jpg": jpeg.decode, "jpeg": jpeg.decode, "avi": video.decode}


def pages(path: str, raw: bytes):
    """(page, height, width, channels, bytes) of every image in a file; values are bytes."""
    a = DECODERS[path.rpartition(".")[2].lower()](raw)
    a = a[None, ..., None] if a.ndim == 2 else a[None] if a.ndim == 3 and a.shape[2] <= 4 else a[..., None] if a.ndim == 3 else a
    for i, page in enumerate(a):
        if page.dtype != np.uint8:
            page = np.clip(np.rint(page), 0, 255).astype(np.uint8)
        yield i, page.shape[0], page.shape[1], page.shape[2], np.ascontiguousarray(page).tobytes()


def is_raw_image(path: Column) -> Column:
    """Whether no decoder knows a file's extension."""
    return ~F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*DECODERS)


def list_images(spark: SparkSession, folder: str, extension: str = "", radical: str = "") -> DataFrame:
    """(path, modified, size, place) in natural order; without an extension the most frequent one, names in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.withColumn("name", name).withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    files = files.where(F.lower("name").startswith(radical.lower()))
    if extension:
        files = files.where(F.col("ext") == extension.lower().lstrip("."))
    else:
        most = files.groupBy("ext").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("ext", F.struct("n", "ext")).alias("ext"))
        files = files.join(most, "ext", "left_semi")
    # The place is by folder: folders are experiments, and each is short.
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    w = Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "path")
    return files.withColumn("folder", parent).withColumn("place", F.row_number().over(w) - 1).select("folder", "path", "modified", "size", "place")


def read_frames(spark: SparkSession, folder: str, extension: str = "*", strict: bool = True) -> DataFrame:
    """FRAME rows of all image files below a folder, decoded where they are read; files that no decoder knows are an error, or left out if not `strict`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                known = path.rpartition(".")[2].lower() in DECODERS
                if strict and not known:
                    raise ValueError(f"no decoder for {path}")
                if known:
                    rows = [(path, *p) for p in pages(path, content.as_py())]
                    yield pa.RecordBatch.from_pydict(dict(zip(("path", "page", "height", "width", "channels", "data"), map(list, zip(*rows)))), schema=_SCHEMA)

    return raw.mapInArrow(run, FRAME)


_SCHEMA = pa.schema([("path", pa.string()), ("page", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])


def to_pixels(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, c0[, c1, c2]): frames as pixel rows, channels in file order."""
    types = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                h, w, c = (cols[n][i].as_py() for n in ("height", "width", "channels"))
                a = np.frombuffer(cols["data"][i].as_py(), np.uint8).reshape(h * w, c)
                own = [pa.array([cols[k][i].as_py()] * (h * w), cols[k].type) for k in keys]
                y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
                chan = [pa.array(a[:, min(j, c - 1)].astype(np.int32)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(y), pa.array(x), *chan], names=[*keys, "y", "x", "c0", "c1", "c2"])

    return frames.select(*keys, "height", "width", "channels", "data").mapInArrow(run, f"{types}, y int, x int, c0 int, c1 int, c2 int")


def capture_minutes(df: DataFrame, keys: list[str], stamp: str = "stamp") -> DataFrame:
    """Adds `minutes` since each key's first capture, from "yyyy:MM:dd HH:mm:ss" stamps; frame numbers where a stamp is missing."""
    t = F.unix_timestamp(F.try_to_timestamp(F.col(stamp), F.lit("yyyy:MM:dd HH:mm:ss")))
    d = df.withColumn("__t", t)
    w = Window.partitionBy(*keys)
    whole = F.bool_and(F.col("__t").isNotNull()).over(w)
    return d.withColumn("minutes", F.when(whole, (F.col("__t") - F.min("__t").over(w)) / 60.0).otherwise(F.col("place").cast("double"))).drop("__t")


def time_steps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean step between captures, to its first significant digit."""
    w = Window.partitionBy(*keys).orderBy("minutes")
    d = df.withColumn("__d", F.col("minutes") - F.lag("minutes").over(w)).groupBy(*keys).agg(F.avg("__d").alias("m"))
    scale = F.pow(F.lit(10.0), F.floor(F.log10("m")))
    return d.select(*keys, F.when(F.col("m") > 0, F.bround(F.col("m") / scale, 0) * scale).otherwise(F.col("m")).alias("time_step"))


def upright(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Turns portrait frames to landscape, the way that differs less from the frame before."""
    types = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, order, "height", "width", "channels", "data"]

    def run(batches):
        now, before = None, None
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                *own, t, h, w, c, data = (col[i].as_py() for col in batch.columns)
                if own != now:
                    now, before = own, None
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)
                if h > w:
                    turned = [np.rot90(a, k) for k in (-1, 1)]
                    a = turned[0] if before is None or before.shape != turned[0].shape else min(turned, key=lambda x: int(np.abs(x.astype(int) - before).sum()))
                before = a.astype(int)
                rows.append((*own, t, *a.shape, np.ascontiguousarray(a).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], batch.schema.field(j).type) for j in range(len(names))], names=names)

    ordered = frames.select(*names).repartition(*keys).sortWithinPartitions(*keys, order)
    kind = frames.schema[order].dataType.simpleString()
    return ordered.mapInArrow(run, f"{types}, `{order}` {kind}, height int, width int, channels int, data binary")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.each = options["path"], int(options.get("filesPerPartition", "16"))

    def partitions(self):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file and f.extension.lower() in DECODERS)
        return [_Part(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Part([])]

    def read(self, partition: _Part):
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                raw = f.read()
            for p in pages(path, raw):
                yield (path, *p)


class FrameSource(DataSource):
    """spark.read.format("frames").load(folder), once registered with spark.dataSource.register(FrameSource)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema):
        return _FrameReader(self.options)
