"""Running kernels on frames: pixel tables become small arrays inside Arrow-batched groups.

Frames are dealt to buckets by a hash of their keys and a group is a bucket's share, so that many
small frames share one call. A frame must fit in a worker's memory; a group is split by frame and
nothing is kept between frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(df: DataFrame, keys: Sequence[str], value: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row a frame: keys, ys, xs[, vs] as arrays in raster order."""
    cell = F.struct("y", "x", *([F.col(value).cast("double").alias("v")] if value else []))
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return g.select(*keys, F.col("c.y").alias("ys"), F.col("c.x").alias("xs"), *([F.col("c.v").alias("vs")] if value else []))


def run(packed: DataFrame, keys: Sequence[str], kernel: Callable[..., Iterator[tuple]], schema: str, height: int | None = None, width: int | None = None) -> DataFrame:
    """Applies kernel(binary or grey array, y0, x0) to each packed frame; it yields tuples that follow the keys.

    Without a size a frame is its bounding box and (y0, x0) the box's corner.
    """
    key_types = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)
    grey = "vs" in packed.columns

    def batches_of(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows: list[tuple] = []
            for k in range(len(batch)):
                ys, xs = (np.asarray(cols[c][k].values) if cols[c][k].is_valid else np.zeros(0, np.int64) for c in ("ys", "xs"))
                y0, x0 = (0, 0) if height else (int(ys.min()), int(xs.min()))
                shape = (height, width) if height else (int(ys.max()) - y0 + 1, int(xs.max()) - x0 + 1)
                a = np.zeros(shape, float if grey else bool)
                a[ys - y0, xs - x0] = np.asarray(cols["vs"][k].values) if grey else True
                own = tuple(cols[c][k].as_py() for c in keys)
                rows += [(*own, *t) for t in kernel(a, y0, x0)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(f"{key_types}, {schema}"))
    return packed.mapInArrow(batches_of, f"{key_types}, {schema}")


def run_ordered(packed: DataFrame, arena: Sequence[str], order: str, state: Callable[[tuple], object], schema: str, height: int, width: int, carry: Sequence[str] = ()) -> DataFrame:
    """Feeds each arena's frames in order to a state object: state(key).frame(t, array, *carried) yields tuples, .close() may yield more.

    Frames are sorted within partitions and streamed; a task holds one frame and one arena's state.
    """
    keys = list(arena)
    key_types = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys)
    grey = "vs" in packed.columns
    names = [*keys, order, "ys", "xs", *(["vs"] if grey else []), *carry]

    def stream(batches):
        now, own = None, None
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            rows: list[tuple] = []
            for k in range(len(batch)):
                key = tuple(c[k].as_py() for c in cols[: len(keys)])
                if own is None or key != now:
                    if own is not None:
                        rows += [(*now, *t) for t in own.close()]
                    now, own = key, state(key)
                at = len(keys)
                ys, xs = (np.asarray(cols[at + 1 + i][k].values) if cols[at + 1 + i][k].is_valid else np.zeros(0, np.int64) for i in range(2))
                a = np.zeros((height, width), float if grey else bool)
                if len(ys):
                    a[ys, xs] = np.asarray(cols[at + 3][k].values) if grey else True
                more = [c[k].as_py() for c in cols[at + 3 + grey :]]
                rows += [(*now, *t) for t in own.frame(cols[at][k].as_py(), a, *more)]
            if rows:
                yield _rows(rows, target)
        if own is not None:
            rows = [(*now, *t) for t in own.close()]
            if rows:
                yield _rows(rows, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(f"{key_types}, {schema}"))
    ordered = packed.select(*names).repartition(*keys).sortWithinPartitions(*keys, order)
    return ordered.mapInArrow(stream, f"{key_types}, {schema}")


def _rows(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)


def run_stacks(df: DataFrame, keys: Sequence[str], value: str, kernel: Callable[..., Iterator[tuple]], schema: str, heads: DataFrame | None = None, pixels: int = 1 << 16) -> DataFrame:
    """Applies kernel(Stack, values, heads) to runs of whole frames of about `pixels` pixels; it yields tuples (frames, column, ...) of arrays.

    df: keys, y, x and `value`, a number or an array of numbers (then values has a row for each of its
    places). Pixels are sorted by frame within partitions and streamed, so a task holds a run, or the one
    frame that is larger. heads: keys and one more column, which the kernel gets as a list with an entry
    a frame, None where a frame has no row in it.
    """
    import pyarrow.compute as pc

    from ..functions.stacks import Stack

    k = len(keys)
    rows = df.where("y is not null and x is not null").select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("v"))
    many = rows.schema["v"].dataType.typeName() == "array"
    if heads is not None:
        payload = next(c for c in heads.columns if c not in keys)
        rows = rows.withColumn("h", F.lit(None).cast(heads.schema[payload].dataType))
        rows = rows.unionByName(heads.select(*keys, F.col(payload).alias("h")), allowMissingColumns=True)

    def parts(batches):
        """Tables of whole frames."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < pixels:
                continue
            t = pa.Table.from_batches(held)
            at = _changes(t, k, pc)
            if at[-1]:
                yield t.slice(0, at[-1]), at[:-1]
                t = t.slice(at[-1])
            held, n = t.combine_chunks().to_batches(), t.num_rows
        if n:
            t = pa.Table.from_batches(held)
            yield t, _changes(t, k, pc)

    def stream(batches):
        for t, at in parts(batches):
            own = np.repeat(np.arange(len(at)), np.diff(np.append(at, t.num_rows)))
            found = t.select(range(k)).take(pa.array(at))
            heads = None
            if "h" in t.column_names:
                mark = t.column("h").is_valid().to_numpy()
                heads = [None] * len(at)
                for i, h in zip(own[mark].tolist(), t.column("h").filter(pa.array(mark)).to_pylist()):
                    heads[i] = h
                t, own = t.filter(pa.array(~mark)), own[~mark]
                some, own = np.unique(own, return_inverse=True)  # a head may have no pixels
                found, heads = found.take(pa.array(some)), [heads[i] for i in some.tolist()]
            if not len(own):
                continue
            v = t.column("v").combine_chunks()
            v = np.asarray(v.flatten(), float).reshape(len(own), -1).T if many else np.asarray(v, float)
            stack = Stack(own, *(t.column(c).to_numpy() for c in ("y", "x")))
            for frame, *cols in kernel(stack, v, heads) if heads is not None else kernel(stack, v):
                if len(frame):
                    own_keys = found.take(pa.array(frame)).combine_chunks()
                    arrays = [c.combine_chunks() for c in own_keys.columns] + [pa.array(c) for c in cols]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + f", {schema}"
    target = to_arrow_schema(_parse_datatype_string(full))
    # Dealt by a hash of its own: rows that are already dealt by their keys, on both sides of the union, would not be dealt again, and their partitions coalesced apart.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "y", "x").mapInArrow(stream, full)


def _changes(t: pa.Table, k: int, pc) -> np.ndarray:
    """First rows of the runs of equal keys; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in t.columns[:k]:
        a, b = c.slice(1), c.slice(0, t.num_rows - 1)
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy()
    return np.flatnonzero(new)


def with_empty_frames(packed: DataFrame, all_frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the frames that have no pixels, with empty arrays."""
    return all_frames.select(*keys).join(packed, list(keys), "left")
