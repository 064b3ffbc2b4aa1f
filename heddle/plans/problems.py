"""Queries of the general problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitemporal, instants


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instants(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' times are UTC, and so is the result
    cat = _t(spark, sf_dir, "source_catalog")
    a = _t(spark, sf_dir, "articles").select(F.lit("articles").alias("tab"), F.col("article_id").cast("long").alias("row_id"), "news_date", "source", "retrieved_at", "domain")
    url_host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)
    n = _t(spark, sf_dir, "news").select(F.lit("news").alias("tab"), F.col("news_id").cast("long").alias("row_id"), "publish_date", "source", "crawl_time", "url")
    return [
        instants.normalise(a, "news_date", "source", cat, "retrieved_at", F.col("domain"), ["tab", "row_id"]),
        instants.normalise(n, "publish_date", "source", cat, "crawl_time", url_host, ["tab", "row_id"]),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.utc_table(_instants(spark, sf_dir))


def p4_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by how their instant was settled; unresolved ones are counted, not hidden."""
    a, n = _instants(spark, sf_dir)
    return a.unionByName(n).groupBy("tab", F.coalesce("state", F.lit("none")).alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitemporal.exposure_at_hits(_t(spark, sf_dir, "firm_news_hits"), _t(spark, sf_dir, "panel_daily"))


QUERIES = {f.__name__: f for f in (p4_found, p4_states, p7_found)}

ORACLES = {
    "p7_found": r"""
WITH h AS (SELECT hit_id, hit_time, nullif(regexp_extract(thscode, '([0-9]{6})', 1), '') AS firm FROM firm_news_hits),
p AS (SELECT panel_id, date, known_at, nullif(regexp_extract(thscode, '([0-9]{6})', 1), '') AS firm, CAST(date AS TIMESTAMP) - INTERVAL 8 HOUR AS since
      FROM panel_daily WHERE L_GPUExposure IS NOT NULL AND NOT isnan(L_GPUExposure)),
j AS (SELECT hit_id, panel_id, row_number() OVER (PARTITION BY hit_id ORDER BY date DESC, known_at DESC, panel_id) AS k
      FROM h JOIN p ON h.firm = p.firm AND p.since <= h.hit_time AND p.known_at <= h.hit_time)
SELECT hit_id, panel_id FROM j WHERE k = 1""",
}
