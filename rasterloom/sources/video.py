"""AVI files: uncompressed ones are written and read, motion JPEG is read."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jpeg

#: Bytes of frames in one file; longer videos go on in further files.
MOST = 1 << 30


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _frame(a: np.ndarray) -> bytes:
    """Rows from the bottom up, blue first, filled up to four bytes."""
    rgb = a[:, :, :3] if a.shape[2] >= 3 else a[:, :, :1].repeat(3, 2)
    row = rgb[::-1, :, ::-1].reshape(a.shape[0], -1)
    return np.pad(row, ((0, 0), (0, -row.shape[1] % 4))).tobytes()


def head(height: int, width: int, frames: int, rate: int) -> bytes:
    """Everything before the first frame."""
    size = height * (3 * width + (-3 * width) % 4)
    main = struct.pack("<14I", 1_000_000 // rate, size * rate, 0, 0x10, frames, 0, 1, size, width, height, 0, 0, 0, 0)
    stream = b"vidsDIB " + struct.pack("<10I4h", 0, 0, 0, 1, rate, 0, frames, size, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    body = frames * (8 + size + size % 2)
    index = 8 + 16 * frames
    return b"RIFF" + struct.pack("<I", 4 + len(lists) + 12 + body + index) + b"AVI " + lists + b"LIST" + struct.pack("<I", 4 + body) + b"movi"


def decode(raw: bytes) -> np.ndarray:
    """(frames, height, width, 3) bytes, red first."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: list[np.ndarray] = []
    form: dict = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
            body = at + 8
            if name == b"LIST":
                walk(body + 4, min(body + size, end))
            elif name == b"strf" and "width" not in form:
                _, w, h, _, bits, kind = struct.unpack("<IiiHH4s", raw[body : body + 20])
                form.update(width=w, height=h, bits=bits, kind=kind)
            elif name[2:] in (b"db", b"dc") and size:
                found.append(picture(raw[body : body + size]))
            at = body + size + size % 2

    def picture(data: bytes) -> np.ndarray:
        w, h, bits = form["width"], abs(form["height"]), form["bits"]
        if form["kind"].upper() == b"MJPG":
            a = jpeg.decode(data)
            return a if a.shape[2] == 3 else a.repeat(3, 2)
        if form["kind"] not in (b"\x00\x00\x00\x00", b"DIB ") or bits not in (8, 24, 32):
            raise ValueError("only uncompressed and motion JPEG videos")
        c = bits // 8
        row = np.frombuffer(data, np.uint8)[: h * (w * c + -w * c % 4)].reshape(h, -1)[:, : w * c].reshape(h, w, c)
        row = row[::-1] if form["height"] > 0 else row
        return row[:, :, 2::-1] if c > 1 else row.repeat(3, 2)

    walk(12, len(raw))
    if not found:
        raise ValueError("an AVI file without frames")
    return np.stack(found)


def write_videos(frames: DataFrame, folder: str, keys: Sequence[str], order: str, rate: int = 25) -> DataFrame:
    """One AVI file a key (and a further one for each `MOST` bytes): frames (keys, order, height, width, channels, data) in order; returns (path, keys, part, frames, size).

    All frames of a file have the size of its first one, others are an error. A task streams a file's
    frames, whose number is counted beforehand.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    size = F.col("height") * (F.col("width") * 3 + 3)
    dealt = frames.withColumn("part", F.floor((F.row_number().over(w) - 1) * size / MOST).cast("int"))
    n = dealt.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    same = dealt.join(n, [*keys, "part"]).select(*keys, "part", "n", order, "height", "width", "channels", "data")
    ordered = same.repartition(*keys, "part").sortWithinPartitions(*keys, "part", order)
    k = len(keys)

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        fs.create_dir(base, recursive=True)
        now, sink, path, index, shape = None, None, "", [], None

        def close():
            sink.write(_chunk(b"idx1", b"".join(index)))
            total = sink.tell()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([v], t) for v, t in zip(now[:-1], types)], pa.array([now[-1]], pa.int32()), pa.array([len(index)], pa.int32()), pa.array([total], pa.int64())], names=["path", *keys, "part", "frames", "size"])

        for batch in batches:
            types = [batch.column(i).type for i in range(k)]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own, many, (h, w_, c, data) = row[: k + 1], row[k + 1], row[k + 3 :]
                if own != now:
                    if sink is not None:
                        yield close()
                    now, index, shape = own, [], (h, w_)
                    path = f"{base}/{'_'.join(map(str, own[:-1]))}" + (f"-{own[-1]}" if own[-1] else "") + ".avi"
                    sink = fs.open_output_stream(path)
                    sink.write(head(h, w_, many, rate))
                if (h, w_) != shape:
                    raise ValueError(f"frames of more than one size: {path}")
                body = _frame(np.frombuffer(data, np.uint8).reshape(h, w_, c))
                index.append(b"00db" + struct.pack("<III", 0x10, 4 + len(index) * (8 + len(body)), len(body)))
                sink.write(_chunk(b"00db", body))
        if sink is not None:
            yield close()

    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keys)
    return ordered.mapInArrow(run, f"path string, {kinds}, part int, frames int, size long")
