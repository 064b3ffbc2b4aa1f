"""Queries of the streaming forms: a stream over the table is run to its end, and its sink is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedup import _shared
from ..streaming import streams as S
from .bindings import table
from .registry import query


def _stream(spark, d, name):
    """A table as a stream of files; a single file stands in a folder of its own by a copy of the columns used."""
    t = table(spark, d, name)
    path = _shared(t)
    return t, path


def _events(spark, d):
    t, path = _stream(spark, d, "events")
    t.select("event_id", "ts", "user_id", "event_type", "value").write.parquet(path)
    return S.parquet_stream(spark, path)


@query("stm01_resumable_ingest", "SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events")
def _(spark, d):
    s = _events(spark, d)
    out, ck = _shared(table(spark, d, "events")), _shared(table(spark, d, "events"))
    S.run_available(s, out, ck)
    S.run_available(s, out, ck)  # nothing new: nothing is read twice
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("stm02_insert_new", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def _(spark, d):
    s = _events(spark, d)
    out, ck = _shared(table(spark, d, "events")), _shared(table(spark, d, "events"))
    S.insert_new_batches(s.select("user_id"), out, ["user_id"], ck)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stm03_tumbling", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    x = _whole(spark, d, lambda e: S.tumbling(e, "ts", ["event_type"], "1 day", "10 minutes", n=F.count(F.lit(1))))
    return x.select(F.col("bucket").cast("date").cast("string").alias("day"), "event_type", "n")


def _whole(spark, d, form):
    """A windowed form of the events stream, run to its end into a table."""
    t = table(spark, d, "events")
    out, ck = _shared(t), _shared(t)
    S.run_complete(form(_events(spark, d)), out, ck)
    return spark.read.parquet(out)


@query("stm05_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events) SELECT user_id, sum(s)::BIGINT AS sessions FROM e GROUP BY 1")
def _(spark, d):
    x = _whole(spark, d, lambda e: S.sessions(e, "ts", ["user_id"], "6 hours", "1 day", n=F.count(F.lit(1))))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("stm04_sliding", "WITH s AS (SELECT unnest(generate_series(date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS e FROM events) SELECT CAST(CAST(e AS DATE) AS VARCHAR) AS day, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    x = _whole(spark, d, lambda e: S.sliding(e, "ts", [], "7 days", "1 day", "1 day", n=F.count(F.lit(1))))
    return x.select(F.date_sub(F.col("at").cast("date"), 1).cast("string").alias("day"), "n")


@query("stm02_distinct_within", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    t = table(spark, d, "events")
    out, ck = _shared(t), _shared(t)
    S.run_available(S.distinct_within(_events(spark, d), "ts", ["user_id", "event_type"], "60 days"), out, ck)  # a reach longer than the table
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stm07_side_output", "SELECT 'good' AS kind, count(*) AS n FROM news WHERE title IS NOT NULL UNION ALL SELECT 'bad', count(*) FROM news WHERE title IS NULL")
def _(spark, d):
    t, path = _stream(spark, d, "news")
    t.select("news_id", "title").write.parquet(path)
    good, bad, ck = (_shared(t) for _ in range(3))
    S.split_batches(S.parquet_stream(spark, path), F.when(F.col("title").isNull(), "no title"), good, bad, ck)
    n = lambda p, k: spark.read.parquet(p).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(good, "good").unionByName(n(bad, "bad"))
