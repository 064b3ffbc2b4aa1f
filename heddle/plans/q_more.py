"""Queries of writers that are read back, compatibility forms, models and running ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import models
from ..operators.dedup import _shared
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import streams
from .bindings import table
from .registry import query


@query("snk01_write_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    t = table(spark, d, "nation")
    path = _shared(t)
    K.write_json(t, path)
    K.write_json(t, path, append=True)
    return R.good_lines(R.json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int"))


@query("snk02_write_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    t = table(spark, d, "customer")
    path = _shared(t)
    K.write_csv(t.select("c_custkey", "c_name", "c_acctbal"), path, bom=True)
    return R.csv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("snk03_report", "SELECT count(*) AS n, count(*) FILTER (title IS NULL) AS untitled FROM articles")
def _(spark, d):
    t = table(spark, d, "articles").select("article_id", "title")
    r = K.report(t, _shared(t), n=F.count(F.lit(1)), untitled=F.count_if(F.col("title").isNull()))
    return spark.createDataFrame([(r["n"], r["untitled"])], "n long, untitled long")


@query("snk04_stage", "SELECT source, count(*) AS n FROM articles GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "articles")
    return K.stage(spark, lambda: t.groupBy("source").agg(F.count(F.lit(1)).alias("n")), _shared(t), "by_source", d)


@query("snk07_split_complete", "SELECT coalesce(trim(title), '') <> '' AND coalesce(trim(content), '') <> '' AS complete, count(*) AS n FROM articles GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "articles").select("article_id", "title", "content")
    path = _shared(t)
    K.split_complete(t, path, ["title", "content"])
    return spark.read.schema("article_id long, is_complete boolean").parquet(path).groupBy(F.col("is_complete").alias("complete")).agg(F.count(F.lit(1)).alias("n"))


@query("src08_folder", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    t = table(spark, d, "region")
    path = _shared(t)
    t.write.parquet(path + "/good")
    spark.createDataFrame([("no table",)], "value string").write.text(path + "/bad")
    return R.folder(spark, path, "parquet", "r_regionkey int, r_name string")


@query("str03_nfkc")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", S.nfkc(F.col("title")).alias("title"))


@query("stm06_running_rank", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM events")
def _(spark, d):
    t = table(spark, d, "events")
    src, out, ck = _shared(t), _shared(t), _shared(t)
    t.select("event_type", "event_id").repartition(4, "event_id").write.parquet(src)
    streams.run_available(streams.running_rank(streams.parquet_stream(spark, src), "event_type", "event_id"), out, ck)
    return spark.read.parquet(out).select("event_type", "event_id", "rank")


def _labelled(spark, d):
    return table(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))


@query("mdl04_linear_scores")
def _(spark, d):
    e = _labelled(spark, d)
    s = models.score(models.fit(e, "vec_id", F.col("embedding"), "y"), e, F.col("embedding"))
    return s.select("vec_id", F.element_at("probs", 2).alias("p"), "guess")


@query("mdl05_ablation")
def _(spark, d):
    c = {"all": F.col("embedding"), "first half": F.slice("embedding", 1, 32), "second half": F.slice("embedding", 33, 32)}
    return models.ablation(_labelled(spark, d), "vec_id", c, "y", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)


@query("snk06_state", "SELECT max(news_id) AS last_id, count(*) AS seen FROM news")
def _(spark, d):
    t = table(spark, d, "news")
    path = _shared(t)
    K.save_state(spark, path, {"last_id": -1, "seen": 0})
    n = t.agg(F.max("news_id").alias("last_id"), F.count(F.lit(1)).alias("seen")).collect()[0]  # one row
    K.save_state(spark, path, n.asDict())
    got = K.load_state(spark, path)
    return spark.createDataFrame([(got["last_id"], got["seen"])], "last_id long, seen long")
