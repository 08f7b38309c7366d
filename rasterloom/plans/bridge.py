"""Rasters and series out of ordinary tables, as DataFrames and as the same relations in SQL.

Images are `embeddings` rows as 8 by 8 grids; videos are `events` by day on a 12 by 12 grid of users,
one arena per event type; curves are weekly running sums of `lineitem` quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMG = """img AS (
  SELECT vec_id AS img, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)),
fg AS (SELECT img, y, x FROM img WHERE v > 0)"""

VID = """vid AS (
  SELECT event_type AS arena, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, ((user_id % 144) // 12)::INT AS y, (user_id % 12)::INT AS x, round(sum(value), 2) AS v
  FROM events GROUP BY ALL),
frames AS (SELECT DISTINCT arena, t FROM vid)"""

CURVE = """curve AS (
  SELECT k, (row_number() OVER (PARTITION BY k ORDER BY w) - 1)::INT AS i, sum(q) OVER (PARTITION BY k ORDER BY w) AS y
  FROM (SELECT l_returnflag AS k, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 7 AS w, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, v)"""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "v"))
    return e.select("img", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x) of positive values"""
    return images(spark, sf_dir).where("v > 0").select("img", "y", "x")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arena, t, y, x, v)"""
    e = table(spark, sf_dir, "events")
    cell = F.col("user_id") % 144
    g = e.groupBy(F.col("event_type").alias("arena"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("t"), F.floor(cell / 12).cast("int").alias("y"), (F.col("user_id") % 12).cast("int").alias("x"))
    return g.agg(F.round(F.sum("value"), 2).alias("v"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, i, y)"""
    li = table(spark, sf_dir, "lineitem")
    q = li.groupBy(F.col("l_returnflag").alias("k"), F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")) / 7).alias("w")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("k").orderBy("w")
    return q.select("k", (F.row_number().over(w) - 1).alias("i"), F.sum("q").over(w).alias("y"))
