"""Mixing sources to target weights by pivotal dependent rounding.

Each document gets a fractional number of copies, its source's target divided by the source's size.
The whole part is taken at once. The fractions are rounded in pairs: mass (fraction times size) moves
at random from one document to the other until one of the two is 0 or 1, so that every expectation
and, but for the last fraction of a source, every source's total is kept. Leaves of documents, dealt
by a hash of id and size, are rounded first and leave one fraction each; these residuals meet in a
tree, `fan` leaves at a time, until a source has one, which is drawn.

Leaf, order and random numbers depend on id, size and source alone: reruns agree whatever the
partitions. A source of any share is dealt over as many leaves as it needs.

Defined results: null text has size 0; null source is a source of its own, last in the order; null
ids are ordinary values; repeated rows are rounded each for itself; size 0 gives 0 words; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, settle, word_count


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target). Excess over `cap` times a source's size is shared again by weight."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src = global_rank(src, [F.col("source").asc_nulls_last()], "pos")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = settle(src.withColumn("w", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int"))), "sources")
    if share > cap:
        raise ValueError("share exceeds cap: no mix can reach it")
    level = 0.0
    while True:  # the level rises until no further source is above its cap
        full = F.col("source_size") * cap < F.col("w") * level
        total, held, free = src.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("w")))).first()
        if not total or not free:
            break
        now = (share * total - (held or 0.0)) / free
        if now <= level * (1 + 1e-15):
            break
        level = now
    target = F.least(F.col("source_size") * F.lit(cap), F.col("w") * F.lit(level))
    return src.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _round_pairs(p: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """Pivotal rounding in the given order; returns the fractions and the place of the residual, or -1."""
    p = p.copy()
    held = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        si, sj, pi, pj = size[held], size[j], p[held], p[j]
        up, down = min((1 - pi) * si, pj * sj), min(pi * si, (1 - pj) * sj)
        if draw[j] * (up + down) < down:  # mass goes to the held one
            first = (1 - pi) * si <= pj * sj
            pi, pj = (1.0, pj - up / sj) if first else (pi + up / si, 0.0)
        else:
            first = pi * si <= (1 - pj) * sj
            pi, pj = (0.0, pj + down / sj) if first else (pi - down / si, 1.0)
        p[held], p[j] = [0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x for x in (pi, pj)]
        held = held if 0 < p[held] < 1 else j if 0 < p[j] < 1 else -1
    if last and held >= 0:
        p[held] = 1.0 if draw[held] < p[held] else 0.0
        held = -1
    return p, held


def _rounder(level: int, seed: int):
    def run(key, pdf):
        import zlib

        # Largest first, so that what is drawn at the end is small.
        pdf = pdf.sort_values(["size", "id", "frac"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        name = b"\x00" if key[0] is None or key[0] != key[0] else b"\x01" + str(key[0]).encode("utf-8", "surrogatepass")
        rng = np.random.Generator(np.random.PCG64([seed, level, int(key[1]), zlib.crc32(name)]))
        draw = rng.random(len(pdf))
        p, held = _round_pairs(pdf["frac"].to_numpy(float), pdf["size"].to_numpy(float), draw, bool(pdf["last"].iloc[0]))
        pdf["frac"] = p
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return run


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, leaf: int = 4_000, fan: int = 16, seed: int = 11) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken."""
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = settle(sized, "sizes")
    targets = source_targets(sized, weights, share, cap).withColumnRenamed("source", "__s")
    rows = sized.join(targets, sized["source"].eqNullSafe(F.col("__s"))).drop("__s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0))
    rows = rows.withColumn("frac", F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(0.0))
    depth = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_docs") / leaf) / math.log(fan))).cast("int")
    rows = rows.withColumn("depth", depth).withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.pow(F.lit(fan), "depth").cast("long")))
    rows = rows.withColumn("last", F.col("depth") == 0).withColumn("open", F.lit(True))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    settled, todo = [], rows
    for level in range(deepest + 1):
        done = settle(todo.groupBy("source", "bucket").applyInPandas(_rounder(level, seed), todo.schema), f"mix{level}")
        settled.append(done.where("not open"))
        todo = done.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan)).withColumn("depth", F.col("depth") - 1).withColumn("last", F.col("depth") == 0)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.col("frac")).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows themselves, with all columns: each as often as the mix takes it. A text of size 0 isn't taken."""
    plan = mix(df, id_col, text_col, source_col, **options)
    # Rows that agree in id, source and size share their copies evenly.
    plan = plan.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__src"), F.col("size").alias("__size")).agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    plan = plan.where("__sum > 0")
    keyed = df.withColumn("__words", word_count(F.col(text_col)))
    match = keyed[id_col].eqNullSafe(F.col("__id")) & keyed[source_col].cast("string").eqNullSafe(F.col("__src")) & (keyed["__words"] == F.col("__size"))
    joined = keyed.join(plan, match)
    one = joined.where("__n = 1").withColumn("__c", F.col("__sum"))
    from pyspark.sql import Window

    many = joined.where("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__id", "__src", "__size").orderBy(F.xxhash64(text_col))))
    many = many.withColumn("__c", F.floor(F.col("__sum") / F.col("__n")) + F.when(F.col("__r") <= F.col("__sum") % F.col("__n"), 1).otherwise(0)).drop("__r")
    all_ = one.unionByName(many).where("__c > 0")
    return all_.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__c")))).select(*df.columns)
