"""Count-min sketches that saturate at 2, merged from partition sketches, and membership bitmaps (the same, asked for 1).

A sketch has two rows of 2**bits cells. A task counts its keys, cuts its own sketch into tiles of
2**20 cells and sends for each tile the cells it has touched; tiles are merged by tile number, so no
task holds more than one tile of the merged sketch. What is handed out is one bit a cell: count at
least `least`. Its size is 2**bits / 4 bytes whatever the input, at most 256 MB by MAX_BITS.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS, TILE = 30, 20
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def bits_for(keys: int) -> int:
    """Bits of a row that is about a quarter full, between one tile and MAX_BITS."""
    return min(MAX_BITS, max(TILE, int(4 * max(1, keys)).bit_length()))


def cells(keys: np.ndarray, bits: int, row: int) -> np.ndarray:
    from .textkernel import mix

    return mix(keys ^ np.uint64(_SALTS[row])) >> np.uint64(64 - bits)


class Counter:
    """A partition's sketch: keys are counted a run at a time."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.held = bits, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys.copy())
        self.held += len(keys)

    def tiles(self):
        """(tile, cells seen once, cells seen more often) of what was added, then starts anew."""
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.held = [], 0
        for row in (0, 1):
            at, n = np.unique(cells(keys, self.bits, row), return_counts=True)
            tile = (at >> np.uint64(TILE)).astype(np.int64)
            cut = np.flatnonzero(np.diff(tile)) + 1
            low = (at & np.uint64((1 << TILE) - 1)).astype("<u4")
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])):
                if b > a:
                    once = n[a:b] == 1
                    yield (row << (self.bits - TILE)) + int(tile[a]), low[a:b][once].tobytes(), low[a:b][~once].tobytes()


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["tile", "once", "more"])


TILES = "tile int, once binary, more binary"


def merge(tiles: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged sketch as bits: two rows of 2**bits / 8 bytes."""

    def run(batches):
        def done(tile, count):
            packed = np.packbits(count >= least, bitorder="little")
            return pa.RecordBatch.from_pydict({"tile": pa.array([tile], pa.int32()), "bits": [zlib.compress(packed.tobytes(), 1)]})

        now, count = None, None
        for batch in batches:
            for tile, once, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if tile != now:
                    if count is not None:
                        yield done(now, count)
                    now, count = tile, np.zeros(1 << TILE, np.uint8)
                one, two = np.frombuffer(once, "<u4"), np.frombuffer(more, "<u4")
                count[one] = np.minimum(count[one] + 1, 2)  # a tile's cells differ, so none is lost
                count[two] = 2
        if count is not None:
            yield done(now, count)

    merged = tiles.repartition(F.col("tile")).sortWithinPartitions("tile").mapInArrow(run, "tile int, bits binary")
    out = np.zeros((2, (1 << bits) // 8), np.uint8)
    flat, size = out.reshape(-1), (1 << TILE) // 8
    for tile, packed in merged.toLocalIterator():  # bounded by the sketch's own size
        flat[tile * size : (tile + 1) * size] = np.frombuffer(zlib.decompress(bytes(packed)), np.uint8)
    return out


def test(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the bitmap has: all that are there, and few others."""
    bits = (bitmap.shape[1] * 8).bit_length() - 1
    ok = np.ones(len(keys), bool)
    for row in (0, 1):
        c = cells(keys, bits, row)
        ok &= (bitmap[row][(c >> np.uint64(3)).astype(np.intp)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return ok


def bitmap_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Membership bitmap of the one long column of `keys`."""

    def run(batches):
        c = Counter(bits)
        for batch in batches:
            c.add(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if c.held > 1 << 19:
                yield tile_batch(list(c.tiles()))
        if c.held:
            yield tile_batch(list(c.tiles()))

    return merge(keys.mapInArrow(run, TILES), bits, 1)
