"""Embedding near-dedup as a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2 c. All vectors are rotated alike at random
and split into blocks of `width` coordinates. A pair within the whole budget is, in at least one
block, within that block's proportional share of it. In each block the vectors lie on a grid over
its first `axes` coordinates; a vector is at home in one cell and calls at those later neighbour
cells that its radius reaches, so every such pair meets in exactly one cell of that block. There
pairs are tested on the block's coordinates; those that pass are compared whole, in double
precision, and counted only in the first block that lets them pass: the union over blocks has no
pair twice. Pairs are not emitted: a task returns counts of links and a spanning forest.

Cells with more than `most` vectors are cut in chunks and each pair of chunks is a task of its own.
Equal vectors of one label are joined once, with their number as weight.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and vectors
without a label have no links; vectors of different length never link; a row without id is a
component of its own, null, and its links count for the others; rows that repeat an id count as
separate vectors; components of another type than float are compared as doubles, of any size;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

#: Rounding of the rotation and of block distances: budgets are widened by it, whole comparisons aren't.
_SLACK = 1e-7


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([17, d])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int, width: int) -> list[slice]:
    return [slice(a, min(a + width, d)) for a in range(0, d, width)]


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as binary values: these are copied on their way, not walked number by number."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32)), pa.py_buffer(x)])


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d numbers out of binary values, of 4 or 8 bytes a number."""
    size = len(column[0].as_buffer()) // d
    raw = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * d * size :][: len(column) * d * size]
    return raw.view(f"<f{size}").reshape(len(column), d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _calls(y: np.ndarray, radius: float, cell: float):
    """(row, cell numbers, home) of points: home cells, and later neighbours within the radius."""
    at = np.floor(y / cell).astype(np.int64)
    low, high = y - at * cell, (at + 1) * cell - y
    rows = np.arange(len(y))
    for step in itertools.product((-1, 0, 1), repeat=y.shape[1]):
        if step < (0,) * len(step):
            continue
        gap = np.zeros(len(y))
        for k, s in enumerate(step):
            gap += (low[:, k] if s < 0 else high[:, k]) ** 2 if s else 0.0
        ok = gap <= radius * radius
        yield rows[ok], at[ok] + np.array(step), not any(step)


_CALLS = "label int, dim int, block int, cell long, home boolean, id long, weight long, vec binary"


def grid(classes: DataFrame, least: float, width: int, axes: int) -> DataFrame:
    """Each class's home and calls in every block; classes: label, dim, id, weight, vec."""

    def run(batches):
        names = [f.split()[0] for f in _CALLS.split(", ")]
        for whole in batches:
            for a in range(0, len(whole), 512):
                part = whole.slice(a, 512)
                dims = part.column(1).to_numpy()
                for d in np.unique(dims):
                    batch = part.filter(pa.array(dims == d))
                    own = np.asarray(batch.column(4).flatten()).reshape(len(batch), d)
                    y = _unit(own) @ rotation(int(d))
                    cuts = blocks(int(d), width)
                    for k, cut in enumerate(cuts):
                        radius = math.sqrt((2 - 2 * least) * (cut.stop - cut.start) / d + _SLACK)
                        z = y[:, cut][:, :axes]
                        for rows, cells, home in _calls(z, radius * (1 + 1e-6), 3 * radius):
                            if not len(rows):
                                continue
                            key = np.zeros(len(rows), np.int64)
                            for j in range(cells.shape[1]):
                                key = key * 100003 + cells[:, j] + 50000
                            take = batch.select([0, 1, 2, 3]).take(pa.array(rows))
                            m = len(rows)
                            yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array(np.full(m, k, np.int32)), pa.array(key), pa.array(np.full(m, home)), take.column(2), take.column(3), _packed(own[rows])], names=names)

    return classes.select("label", "dim", "id", "weight", "vec").mapInArrow(run, _CALLS)


def _join(least: float, width: int):
    def run(key, table):
        k, i, j = (x.as_py() for x in key[2:3] + key[4:6])
        chunk = table.column("chunk").to_numpy()
        order = np.lexsort((table.column("id").to_numpy(), chunk))
        table = table.take(pa.array(order)).combine_chunks()
        chunk = chunk[order]
        ids, weight, home = (table.column(c).to_numpy() for c in ("id", "weight", "home"))
        x = _unit(_unpacked(table.column("vec").combine_chunks(), key[1].as_py()))
        d = x.shape[1]
        y = x @ rotation(d)
        cuts = blocks(d, width)
        budget = [(2 - 2 * least) * (c.stop - c.start) / d + _SLACK for c in cuts]
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        edges: list[tuple[int, int]] = []

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        square = (y[:, cuts[k]] ** 2).sum(1)
        for a in range(0, len(left), 256):
            u = left[a : a + 256]
            near = square[u][:, None] + square[right] - 2 * y[u][:, cuts[k]] @ y[right][:, cuts[k]].T <= budget[k] + 1e-9
            near &= home[u][:, None] | home[right]
            near &= u[:, None] < right if i == j else True
            p, q = np.nonzero(near)
            for s in range(0, len(p), 1 << 15):
                m, n = u[p[s : s + (1 << 15)]], right[q[s : s + (1 << 15)]]
                ok = (x[m] * x[n]).sum(1) >= least
                m, n = m[ok], n[ok]
                # One rule says for every block whether it holds a pair, so that the first that does is the same everywhere.
                holds = np.stack([((y[m, cut] - y[n, cut]) ** 2).sum(1) <= budget[b] for b, cut in enumerate(cuts[: k + 1])])
                own = holds[k] & ~holds[:k].any(0)
                m, n = m[own], n[own]
                np.add.at(links, m, weight[n])
                np.add.at(links, n, weight[m])
                for v, w in zip(m.tolist(), n.tolist()):
                    v, w = root(v), root(w)
                    if v != w:
                        parent[max(v, w)] = min(v, w)
                        edges.append((v, w))
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "a": pa.array(np.concatenate([ids[some], ids[e[:, 0]]])),
            "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[e[:, 1]]])),
            "links": pa.array(np.concatenate([links[some], np.full(len(e), -1)]).astype(np.int64)),
        })

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, width: int = 8, axes: int = 3, most: int = 2048) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    kept = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast(kept).alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = settle(rows.withColumn("hash", F.xxhash64("vec")), "vectors")
    # A class: one label and vector. Its number is that of its smallest row.
    numbered = rows.where("fine").groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))
    numbered = numbered.select("label", "vec", "low", "weight", F.size("vec").alias("dim"))
    classes = settle(numbered.withColumn("id", F.monotonically_increasing_id()), "classes")
    calls = settle(grid(classes, least, width, axes), "calls")
    place = ["label", "dim", "block", "cell"]
    large = calls.groupBy(*place).agg(F.count(F.lit(1)).alias("size"), F.max(F.col("home").cast("int")).alias("any")).where(f"size > {most} and any = 1").select(*place, F.ceil(F.col("size") * 2 / most).cast("int").alias("chunks"))
    cut = calls.join(large, place, "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("chunks"))).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks") - 1, F.lit(0)))))
    cut = cut.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    got = settle(cut.groupBy(*place, "i", "j").applyInArrow(_join(least, width), "a long, b long, links long"), "links")
    names = classes.select(F.col("id").alias("c"), "low")
    sums = got.where("links >= 0").groupBy("a").agg(F.sum("links").alias("links"))
    per = classes.join(sums, classes["id"] == sums["a"], "left").select("id", "label", "vec", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    label = components(got.where("links < 0").select("a", "b"), "near").select(F.col("id").alias("k"), F.col("component_id").alias("comp"))
    per = per.join(label, F.col("id") == F.col("k"), "left").withColumn("comp", F.coalesce("comp", "id"))
    # The components' smallest ids; rows without id have none, but hold their component together.
    per = settle(per, "per-class")
    smallest = per.groupBy("comp").agg(F.min("low").alias("component_id"))
    per = per.join(smallest, "comp").select(F.col("label").alias("l"), F.col("vec").alias("v"), F.xxhash64("vec").alias("h"), "n_links", "component_id")
    out = rows.join(per, rows["fine"] & (rows["label"] == per["l"]) & (rows["hash"] == per["h"]) & (rows["vec"] == per["v"]), "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
