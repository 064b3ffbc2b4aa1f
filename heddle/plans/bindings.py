"""The project's entities over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated notes: nid, source, body, title, date."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nid"), "source", F.col("text").alias("body"), F.substring("text", 1, 60).alias("title"), F.col("publish_day").alias("date"))


NOTES = "notes AS (SELECT doc_id AS nid, source, text AS body, substr(text, 1, 60) AS title, CAST(publish_day AS DATE) AS date FROM documents)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scored signal: source, bucket (day), v, w = 1 / place within (source, day)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("bucket"), F.col("value").alias("v"), "event_id")
    return e.withColumn("w", 1.0 / F.row_number().over(Window.partitionBy("source", "bucket").orderBy("event_id")))


SIGNAL = "signal AS (SELECT event_type AS source, CAST(ts AS DATE) AS bucket, value AS v, event_id, 1.0 / row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) AS w FROM events)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as monthly bars: firm, t, close, vol, ret (log return)."""
    p = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("firm"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("t"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("vol"))
    )
    return p.withColumn("ret", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("firm").orderBy("t"))))


PRICES = """bars AS (SELECT l_suppkey AS firm, CAST(date_trunc('month', l_shipdate) AS DATE) AS t, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS vol FROM lineitem GROUP BY 1, 2),
prices AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY firm ORDER BY t)) AS ret FROM bars)"""


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier with its region as category."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("firm"), F.col("r_name").alias("category"))


FIRMS = "firms AS (SELECT s_suppkey AS firm, r_name AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a monthly series: bucket, value."""
    return table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("bucket")).agg(F.avg("o_totalprice").alias("value"))


ATTENTION = "attention AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, avg(o_totalprice) AS value FROM orders GROUP BY 1)"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_daily with one row a firm and date: the one known last, then the smallest id."""
    p = table(spark, sf_dir, "panel_daily").withColumn("firm", F.regexp_extract("thscode", r"(\d{6})", 1))
    w = Window.partitionBy("firm", "date").orderBy(F.col("known_at").desc(), "panel_id")
    return p.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


PANEL = """panel AS (SELECT * FROM (SELECT *, regexp_extract(thscode, '([0-9]{6})', 1) AS firm, row_number() OVER (PARTITION BY regexp_extract(thscode, '([0-9]{6})', 1), date ORDER BY known_at DESC, panel_id) AS k FROM panel_daily) WHERE k = 1)"""
