"""Exact dedup: tree merge of digest runs, DataFrame operations only.

Every row becomes (id, SHA-256, length, second hash). Input partitions are the leaves of a binomial
tree; as many as there are, rounded up to a power of two. In each round runs exchange parts: a run keeps
the digests whose next bits name its place and gets the same part of the runs it is merged with, so that
data stay spread over all runs and at the end each run holds one range of digests, merged from every
leaf. An exchange deals by (part, run) alone; what arrives is sorted by digest and the merge, a sort-based
aggregate, streams through that order without a further exchange. `bits` binomial rounds are done in one exchange, which makes
a merge one of 2**bits runs. A merge keeps one entry per digest with the identifier that stays; entries
merge only if digest, length and second hash all agree. A group that holds a third of all rows is cut to
one entry per leaf before the first exchange and to at most `2**bits` entries per merge after that.

Defined results: texts of any length are digested whole; null text counts as empty; a null id counts below every other id and stays only in
groups without another; of rows that repeat both id and text exactly one is kept; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary, size, check, run): what the merge works on; a run is a leaf's."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(keys: DataFrame, leaves: int, bits: int = 3, keep: str = "max") -> DataFrame:
    """One row per text: (digest, size, check, keep_id, group_size, n_kept rows that carry keep_id)."""
    pick = F.max if keep == "max" else F.min
    same = ["digest", "size", "check"]
    depth = (leaves - 1).bit_length()
    place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    # A leaf's own run: one entry per (id, digest), then per digest, counted before anything is exchanged.
    runs = keys.repartition("run").groupBy("run", *same, "id").agg(F.count(F.lit(1)).alias("n"))
    merged = _fold(runs.withColumn("rows", F.col("n")), ["run", *same], pick)
    done = 0  # bits of the digest that the parts have agreed on
    while done < depth:
        step = min(bits, depth - done)
        done += step
        merged = merged.withColumn("run", F.shiftright("run", step)).withColumn("part", F.pmod(place, F.lit(1 << done)))
        merged = _fold(merged.repartition("part", "run"), ["part", "run", *same], pick).drop("part")
    return merged.select(*same, F.col("id").alias("keep_id"), F.col("rows").alias("group_size"), F.col("n").alias("n_kept"))


def _fold(entries: DataFrame, keys: list[str], pick) -> DataFrame:
    """Merge entries by key: the id that stays, how many rows carry it, and how many rows there are."""
    best = entries.groupBy(*keys, "id").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    top = F.max if pick is F.max else F.min
    if top is F.max:
        chosen = F.max(F.struct(F.col("id"), F.col("n")))
    else:
        chosen = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("n")))
    out = best.groupBy(*keys).agg(chosen.alias("c"), F.sum("rows").alias("rows"))
    return out.select(*keys, F.col("c.id").alias("id"), F.col("c.n").alias("n"), "rows")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", bits: int = 3) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256. `keep`: largest ("max") or smallest id stays."""
    keys = settle(digests(df, id_col, text_col), "digests")
    leaves = (keys.agg(F.max("run")).first()[0] or 0) + 1
    groups = merge_runs(keys, leaves, bits, keep)
    out = keys.join(groups, ["digest", "size", "check"])
    out = out.withColumn("top", F.col("id").eqNullSafe(F.col("keep_id")))
    tied = out.where("top and n_kept > 1").withColumn("kept", F.row_number().over(Window.partitionBy("digest", "id").orderBy("size")) == 1)
    rest = out.where("not (top and n_kept > 1)").withColumn("kept", F.col("top"))
    return rest.unionByName(tied).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns. Texts are not shuffled: only the dropped ids are sent."""
    found = settle(exact_dedup(df, id_col, text_col, keep).select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__digest"), "kept"), "dedup")
    # An id can occur with several texts, or both as kept and dropped row of one text; only then rows are counted off.
    lost = found.groupBy("__id", "__digest").agg(F.sum(F.col("kept").cast("int")).alias("__keep"), F.count(F.lit(1)).alias("__all")).where("__keep < __all")
    keyed = df.withColumn("__digest", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    same = keyed[id_col].eqNullSafe(F.col("__id")) & (keyed["__digest"] == F.col("__d"))
    gone = lost.where("__keep = 0").select("__id", F.col("__digest").alias("__d"))
    kept = keyed.join(gone, same, "left_anti")
    some = lost.where("__keep > 0").select("__id", F.col("__digest").alias("__d"))
    if not some.isEmpty():
        one = keyed.join(some, same, "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__digest").orderBy(F.lit(1)))).where("__n = 1").drop("__n")
        kept = kept.join(some, same, "left_anti").unionByName(one)
    return kept.drop("__digest")
