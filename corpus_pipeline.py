"""A corpus pipeline: quality, exact copies, near copies, source mix, tokens.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.bpe import round_trip
from rasterloom.llm.common import settle, table
from rasterloom.llm.exact_dedup import drop_copies
from rasterloom.llm.mixing import apply_mix
from rasterloom.llm.ngram_join import keep_one
from rasterloom.llm.quality import fit, held_out, keep_good
from rasterloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled ones that aren't held out."""
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=~held_out("id"))
    return keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    return keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix takes it."""
    return apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, decoded again: counts and digests."""
    return round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("mix_sources", mix_stage),
    ("byte_bpe", token_stage),
]

#: The classifier's fit and the mix's draws can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
