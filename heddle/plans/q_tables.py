"""Queries of joins, deduplication, aggregates, windows, text scoring, panel inference and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import maths as M
from ..operators import dedup as P
from ..operators import econ as E
from ..operators import evaluate as V
from ..operators import frames as R
from ..operators import text as T
from .bindings import ATTENTION, FIRMS, NOTES, PANEL, PRICES, SIGNAL, attention, firms, notes, panel, prices, signal, table
from .registry import query

r6 = lambda c: F.round(c, 6)
r4 = lambda c: F.round(c, 4)
text = lambda c: F.col(c).cast("string").alias(c)

# ------------------------------------------------------------------ joins


@query("jon01_three_way", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jon02_left", f"WITH {PANEL} SELECT panel_id, o.n FROM panel LEFT JOIN (SELECT CAST(hit_time AS DATE) AS date, count(*) AS n FROM firm_news_hits GROUP BY 1) o ON CAST(panel.date AS DATE) = o.date")
def _(spark, d):
    h = table(spark, d, "firm_news_hits").groupBy(F.col("hit_time").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return panel(spark, d).withColumn("date", F.col("date").cast("date")).join(h, "date", "left").select("panel_id", "n")


@query("jon03_right", f"WITH {SIGNAL}, s AS (SELECT bucket, count(*) AS n FROM signal WHERE source = 'click' GROUP BY 1), b AS (SELECT DISTINCT bucket FROM signal) SELECT CAST(b.bucket AS VARCHAR) AS bucket, n FROM s RIGHT JOIN b ON s.bucket = b.bucket")
def _(spark, d):
    s = signal(spark, d)
    n = s.filter("source = 'click'").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return n.join(s.select("bucket").distinct(), "bucket", "right").select(text("bucket"), "n")


@query("jon04_dimension", f"WITH {FIRMS} SELECT category, count(*) AS n FROM lineitem JOIN firms ON l_suppkey = firm GROUP BY 1")
def _(spark, d):
    # the dimension's size is checked by Spark's broadcast threshold
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("firm")).join(firms(spark, d), "firm").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("jon05_semi", "SELECT news_id FROM news WHERE news_id IN (SELECT nid FROM firm_news_hits)")
def _(spark, d):
    return table(spark, d, "news").join(table(spark, d, "firm_news_hits").select(F.col("nid").alias("news_id")), "news_id", "left_semi").select("news_id")


@query("jon06_anti", "SELECT article_id FROM articles a WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM news n WHERE n.title = a.title)")
def _(spark, d):
    return table(spark, d, "articles").filter("title is not null").join(table(spark, d, "news").select("title"), "title", "left_anti").select("article_id")


@query("jon07_contains", "SELECT DISTINCT news_id, thscode FROM news, (SELECT thscode, unnest(alias) AS a FROM firm_master) WHERE a <> '' AND contains(content, a)")
def _(spark, d):
    al = table(spark, d, "firm_master").select("thscode", F.explode("alias").alias("a"))
    return T.mentions(table(spark, d, "news"), "news_id", "content", al, "thscode", "a").select(F.col("id").alias("news_id"), F.col("key").alias("thscode"))


@query("jon08_forward_as_of", f"WITH {NOTES}, o AS (SELECT DISTINCT CAST(date AS DATE) AS day FROM panel_daily) SELECT nid, CAST((SELECT min(day) FROM o WHERE o.day >= notes.date) AS VARCHAR) AS open_day FROM notes WHERE date IS NOT NULL")
def _(spark, d):
    n = notes(spark, d).filter("date is not null").select("nid", F.col("date").alias("day"))
    m = D.next_open_day(n.select("day"), table(spark, d, "panel_daily").select(F.col("date").cast("date").alias("day")))
    return n.join(m, "day", "left").select("nid", text("open_day"))


EVENTS_SQL = "cal AS (SELECT day, row_number() OVER (ORDER BY day) AS tpos FROM (SELECT DISTINCT CAST(date AS DATE) AS day FROM panel)), top AS (SELECT CAST(date AS DATE) AS day, max(GCS) AS g FROM panel GROUP BY 1), cut AS (SELECT quantile_cont(g, 0.9) AS q FROM top), ev AS (SELECT tpos, row_number() OVER (ORDER BY tpos) AS event FROM top JOIN cal USING (day), cut WHERE g >= q), kept AS (SELECT * FROM (SELECT tpos, event, tpos - lag(tpos) OVER (ORDER BY tpos) AS gap FROM ev) WHERE gap >= 3 OR gap IS NULL)"


def _calendar(spark, d):
    return D.positions(panel(spark, d).select(F.col("date").cast("date").alias("day")))


def _events(spark, d):
    p = panel(spark, d)
    top = p.groupBy(F.col("date").cast("date").alias("day")).agg(F.max("GCS").alias("g"))
    cut = top.agg(F.percentile("g", F.lit(0.9)).alias("q"))
    ev = top.join(_calendar(spark, d), "day").join(F.broadcast(cut)).filter("g >= q").withColumn("event", F.row_number().over(W.orderBy("tpos")))
    return ev.withColumn("keep", R.gap_events(F.col("tpos"), ["tpos"])).filter("keep = 1").select("tpos", "event")


@query("jon09_event_window", f"WITH {PANEL}, {EVENTS_SQL} SELECT event, tau, count(*) AS n FROM kept, generate_series(-5, 20) t(tau), panel JOIN cal ON CAST(panel.date AS DATE) = cal.day WHERE cal.tpos = kept.tpos + tau GROUP BY 1, 2")
def _(spark, d):
    x = _events(spark, d).withColumn("tau", F.explode(F.sequence(F.lit(-5), F.lit(20)))).withColumn("tpos", F.col("tpos") + F.col("tau"))
    p = panel(spark, d).withColumn("day", F.col("date").cast("date")).join(_calendar(spark, d), "day").select("tpos", "panel_id")
    return p.join(x, "tpos").groupBy(F.col("event").cast("bigint").alias("event"), F.col("tau").cast("bigint").alias("tau")).agg(F.count(F.lit(1)).alias("n"))


@query("jon10_derived_key", "SELECT regexp_extract(h.thscode, '([0-9]{6})', 1) AS code, m.category, count(*) AS n FROM firm_news_hits h JOIN firm_master m ON regexp_extract(h.thscode, '([0-9]{6})', 1) = regexp_extract(m.thscode, '([0-9]{6})', 1) GROUP BY 1, 2")
def _(spark, d):
    k = lambda t: table(spark, d, t).withColumn("code", F.regexp_extract("thscode", r"(\d{6})", 1))
    return k("firm_news_hits").join(k("firm_master").select("code", "category"), "code").groupBy("code", "category").agg(F.count(F.lit(1)).alias("n"))


@query("jon11_group_fallback", f"WITH {PANEL} SELECT panel_id, round(coalesce(L_GPUExposure, avg(L_GPUExposure) OVER (PARTITION BY category, date)), 8) AS x FROM panel")
def _(spark, d):
    return panel(spark, d).select("panel_id", F.round(F.coalesce("L_GPUExposure", F.avg("L_GPUExposure").over(W.partitionBy("category", "date"))), 8).alias("x"))


@query("jon12_permutation")
def _(spark, d):
    return E.permuted(attention(spark, d).select(F.col("bucket").alias("day"), "value"), "value", 20, 7)


# ------------------------------------------------------------------ deduplication


@query("ddp01_by_content", f"WITH {NOTES} SELECT min(nid) AS nid FROM notes GROUP BY md5(body)")
def _(spark, d):
    return P.by_content(notes(spark, d), "body", ["nid"]).select("nid")


@query("ddp02_by_title_day", f"WITH {NOTES}, a AS (SELECT *, row_number() OVER (PARTITION BY md5(body) ORDER BY nid) AS k FROM notes), b AS (SELECT *, substr(trim(title), 1, 40) AS t FROM a WHERE k = 1), c AS (SELECT *, row_number() OVER (PARTITION BY t, date ORDER BY nid) AS k2 FROM b) SELECT nid FROM c WHERE k2 = 1 OR coalesce(t, '') = ''")
def _(spark, d):
    return P.by_title_and_day(P.by_content(notes(spark, d), "body", ["nid"]), "title", "date", ["nid"]).select("nid")


@query("ddp03_event_clusters", f"WITH {NOTES}, k AS (SELECT nid, CASE WHEN length(substr(title, 1, 24)) >= 12 THEN substr(title, 1, 24) ELSE substr(md5(body), 1, 16) END AS k, CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS week FROM notes WHERE date IS NOT NULL AND body IS NOT NULL) SELECT nid, min(nid) OVER (PARTITION BY k, week) AS event_id, row_number() OVER (PARTITION BY k, week ORDER BY nid) AS dup_rank, round(1.0 / row_number() OVER (PARTITION BY k, week ORDER BY nid), 6) AS dup_weight FROM k")
def _(spark, d):
    n = notes(spark, d).filter("date is not null and body is not null").withColumn("week", D.iso_week(F.col("date")))
    return P.event_clusters(n, "title", "body", "week", ["nid"]).select("nid", "event_id", F.col("dup_rank").cast("bigint").alias("dup_rank"), r6(F.col("dup_weight").cast("double")).alias("dup_weight"))


@query("ddp04_greedy_keys")
def _(spark, d):
    a = table(spark, d, "articles").select("article_id", "url", "content_sha256", F.nullif(F.trim("title"), F.lit("")).alias("title"))
    return P.greedy_keys(a, "article_id", ["url", "content_sha256", "title"]).select("article_id")


@query("ddp05_priority_first", "SELECT uuid, min_by(news_id, (CASE WHEN source IS NULL THEN 1 ELSE 0 END) * 1000000000000 + news_id) AS news_id FROM news GROUP BY uuid")
def _(spark, d):
    return P.first_of(table(spark, d, "news"), ["uuid"], [F.when(F.col("source").isNull(), 1).otherwise(0), "news_id"]).select("uuid", "news_id")


@query("ddp06_longest", "SELECT article_id FROM (SELECT article_id, row_number() OVER (PARTITION BY coalesce(trim(url), '') ORDER BY coalesce(length(content), 0) DESC, article_id) AS k FROM articles) WHERE k = 1")
def _(spark, d):
    return P.longest_of(table(spark, d, "articles").select("article_id", "url", "content"), F.col("url"), F.col("content"), ["article_id"]).select("article_id")


@query("ddp07_first_url", "SELECT min(article_id) AS article_id FROM articles GROUP BY url")
def _(spark, d):
    return P.first_of(table(spark, d, "articles").select("article_id", "url"), ["url"], ["article_id"]).select("article_id")


@query("ddp08_statuses", "SELECT article_id, CASE WHEN NOT ok THEN 'rejected' WHEN row_number() OVER (PARTITION BY h, ok ORDER BY article_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM (SELECT article_id, sha256(content) AS h, coalesce(length(content) >= 300, false) AS ok FROM articles)")
def _(spark, d):
    a = table(spark, d, "articles").select("article_id", F.sha2("content", 256).alias("h"), (F.length("content") >= 300).alias("ok"))
    return P.statuses(a, "h", F.col("ok"), ["article_id"]).select("article_id", "status")


# ------------------------------------------------------------------ aggregates


@query("agg01_counts", f"WITH {NOTES} SELECT strftime(date, '%Y-%m') AS month, source, count(*) AS n FROM notes GROUP BY 1, 2")
def _(spark, d):
    return notes(spark, d).groupBy(D.month_key(F.col("date")).alias("month"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("agg02_matrix", "SELECT CAST(s.bucket AS VARCHAR) AS bucket, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM (SELECT CAST(ts AS DATE) AS bucket, event_type FROM events) s GROUP BY 1")
def _(spark, d):
    return signal(spark, d).groupBy("bucket").pivot("source", ["click", "view"]).agg(F.count(F.lit(1))).fillna(0).select(text("bucket"), "click", "view")


@query("agg03_grand_total", "SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg04_weighted_mean", f"WITH {SIGNAL} SELECT source, CAST(bucket AS VARCHAR) AS bucket, round(coalesce(sum(v * w) / nullif(sum(w), 0), avg(v)), 6) AS m FROM signal GROUP BY 1, 2")
def _(spark, d):
    m = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.nullif(F.sum("w"), F.lit(0.0))), F.avg("v"))
    return signal(spark, d).groupBy("source", "bucket").agg(r6(m).alias("m")).select("source", text("bucket"), "m")


@query("agg05_named", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), r6(F.avg("value")).alias("mean"))


@query("agg06_first_last", f"WITH {PANEL} SELECT firm, strftime(date, '%Y-%m') AS month, arg_min(ar, date) AS first_ar, arg_max(ar, date) AS last_ar, round(coalesce(sum(ar), 0), 6) AS total FROM panel GROUP BY 1, 2")
def _(spark, d):
    o = F.when(F.col("ar").isNotNull(), F.col("date"))
    return panel(spark, d).groupBy("firm", D.month_key(F.col("date")).alias("month")).agg(F.min_by("ar", o).alias("first_ar"), F.max_by("ar", o).alias("last_ar"), r6(F.coalesce(F.sum("ar"), F.lit(0.0))).alias("total"))


@query("agg07_top_k", "SELECT source, count(*) AS n FROM articles WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def _(spark, d):
    return table(spark, d, "articles").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("agg08_status_counts", "SELECT content_type, discovery_source, count(*) AS n FROM articles GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "articles").groupBy("content_type", "discovery_source").agg(F.count(F.lit(1)).alias("n"))


@query("agg09_distinct", "SELECT count(DISTINCT source) AS sources, count(DISTINCT domain) AS domains FROM articles")
def _(spark, d):
    return table(spark, d, "articles").agg(F.countDistinct("source").alias("sources"), F.countDistinct("domain").alias("domains"))


@query("agg10_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def _(spark, d):
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    return table(spark, d, "events").groupBy("event_type").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.99).alias("q99"))


@query("agg11_describe", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi, round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurt FROM events GROUP BY 1")
def _(spark, d):
    n = F.count("value").cast("double")
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("value") + 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), r4(skew).alias("skew"), r4(kurt).alias("kurt"))


@query("agg12_correlation", f"WITH {PANEL} SELECT category, round(corr(ar, mar), 6) AS a, round(corr(ar, L_GPUExposure), 6) AS b FROM panel GROUP BY 1")
def _(spark, d):
    return panel(spark, d).groupBy("category").agg(r6(F.corr("ar", "mar")).alias("a"), r6(F.corr("ar", "L_GPUExposure")).alias("b"))


@query("agg13_autocorrelation", f"WITH {ATTENTION} SELECT round(corr(value, p), 6) AS r FROM (SELECT value, lag(value) OVER (ORDER BY bucket) AS p FROM attention)")
def _(spark, d):
    return attention(spark, d).withColumn("p", F.lag("value").over(W.orderBy("bucket"))).agg(r6(F.corr("value", "p")).alias("r"))


@query("agg14_pivot", f"WITH {PANEL} SELECT strftime(date, '%Y-%m') AS month, round(avg(ar) FILTER (category = 'G1'), 9) AS g1, round(avg(ar) FILTER (category = 'G2'), 9) AS g2 FROM panel GROUP BY 1")
def _(spark, d):
    p = panel(spark, d).groupBy(D.month_key(F.col("date")).alias("month")).pivot("category", ["G1", "G2"]).agg(F.avg("ar"))
    return p.select("month", F.round("G1", 9).alias("g1"), F.round("G2", 9).alias("g2"))


@query("agg15_class_weights", "SELECT label, count(*) AS n, round(greatest(0.2, least(5.0, sum(count(*)) OVER () / (count(*) OVER () * count(*)))), 6) AS weight FROM embeddings GROUP BY label")
def _(spark, d):
    return V.balance_weights(table(spark, d, "embeddings"), "label").withColumn("weight", r6(F.col("weight").cast("double")))


@query("agg16_span", "SELECT language, CAST(min(retrieved_at) AS VARCHAR) AS lo, CAST(max(retrieved_at) AS VARCHAR) AS hi, count(*) AS n FROM articles GROUP BY 1")
def _(spark, d):
    return table(spark, d, "articles").groupBy("language").agg(F.min("retrieved_at").cast("string").alias("lo"), F.max("retrieved_at").cast("string").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("agg17_keyword_counts", "SELECT k, count(*) AS n FROM (SELECT unnest(keyword_hits) AS k FROM news) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "news").select(F.explode("keyword_hits").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("agg18_supply", "SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM (SELECT try_strptime(regexp_extract(news_date, '(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d')::DATE AS day FROM articles) GROUP BY 1")
def _(spark, d):
    day = F.try_to_date(F.regexp_extract("news_date", r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd").cast("string")
    return table(spark, d, "articles").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("agg19_roll_up", f"WITH {PANEL} SELECT firm, strftime(date, '%Y-%m') AS month, round(sum(ret), 6) AS ret, round(CASE WHEN count(ret) > 1 THEN stddev_samp(ret) END, 6) AS vol, count(*) AS n FROM panel GROUP BY 1, 2")
def _(spark, d):
    return panel(spark, d).groupBy("firm", D.month_key(F.col("date")).alias("month")).agg(r6(F.sum("ret")).alias("ret"), r6(F.when(F.count("ret") > 1, F.stddev_samp("ret"))).alias("vol"), F.count(F.lit(1)).alias("n"))


@query("agg20_histogram", "SELECT CAST(least(31, floor((value - lo) / ((hi - lo) / 32))) AS BIGINT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select("value")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(F.broadcast(b)).groupBy(F.least(F.lit(31), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 32))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ windows

SERIES = f"{SIGNAL}, series AS (SELECT source, bucket, coalesce(sum(v * w) / nullif(sum(w), 0), avg(v)) AS v FROM signal GROUP BY 1, 2)"
ZED = f"{SERIES}, z AS (SELECT source, bucket, CASE WHEN count(v) OVER w >= 4 AND stddev_samp(v) OVER w > 1e-6 THEN greatest(-6, least(6, (v - avg(v) OVER w) / stddev_samp(v) OVER w)) END AS z FROM series WINDOW w AS (PARTITION BY source ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"


def _series(spark, d):
    m = F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.nullif(F.sum("w"), F.lit(0.0))), F.avg("v"))
    return signal(spark, d).groupBy("source", "bucket").agg(m.alias("v"))


def flagship(spark, d):
    """Daily index: weighted means by source, lagged z-scores, their mean over sources, signed root."""
    z = _series(spark, d).withColumn("z", R.lagged_z(F.col("v"), ["source"], ["bucket"], 10, 4))
    i = z.groupBy("bucket").agg(F.avg("z").alias("z"), F.count("z").alias("n_sources"))
    return i.select(text("bucket"), r6(F.col("z")).alias("z"), "n_sources", r6(M.signed_sqrt(F.col("z"))).alias("index"))


@query("win01_lagged_z", f"WITH {ZED} SELECT source, CAST(bucket AS VARCHAR) AS bucket, round(z, 6) AS z FROM z")
def _(spark, d):
    return _series(spark, d).select("source", text("bucket"), r6(R.lagged_z(F.col("v"), ["source"], ["bucket"], 10, 4)).alias("z"))


query("win02_daily_index", f"WITH {ZED} SELECT CAST(bucket AS VARCHAR) AS bucket, round(avg(z), 6) AS z, count(z) AS n_sources, round(sign(avg(z)) * sqrt(abs(avg(z))), 6) AS index FROM z GROUP BY 1")(flagship)


@query("win03_change", f"WITH {PRICES} SELECT firm, CAST(t AS VARCHAR) AS t, round(close / lag(close) OVER (PARTITION BY firm ORDER BY t) - 1, 6) AS c FROM bars")
def _(spark, d):
    return prices(spark, d).select("firm", text("t"), r6(R.change(F.col("close"), ["firm"], ["t"])).alias("c"))


@query("win04_rolling_deviation", f"WITH {ATTENTION} SELECT CAST(bucket AS VARCHAR) AS bucket, round(CASE WHEN count(value) OVER w >= 10 THEN stddev_samp(value) OVER w END, 4) AS s FROM attention WINDOW w AS (ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return attention(spark, d).select(text("bucket"), r4(R.rolling(F.stddev_samp, F.col("value"), [], ["bucket"], 20, 10)).alias("s"))


MARKET = f"{PRICES}, mkt AS (SELECT t, avg(ret) AS m FROM prices GROUP BY t), pm AS (SELECT p.*, m FROM prices p JOIN mkt USING (t))"


def _market(spark, d):
    p = prices(spark, d)
    return p.join(p.groupBy("t").agg(F.avg("ret").alias("m")), "t")


@query("win05_market_model", f"WITH {MARKET} SELECT firm, CAST(t AS VARCHAR) AS t, round(CASE WHEN row_number() OVER (PARTITION BY firm ORDER BY t) > 24 AND regr_count(ret, m) OVER w >= 12 THEN ret - (regr_intercept(ret, m) OVER w + regr_slope(ret, m) OVER w * m) END, 5) AS ar FROM pm WINDOW w AS (PARTITION BY firm ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return _market(spark, d).select("firm", text("t"), F.round(R.market_model(F.col("ret"), F.col("m"), ["firm"], ["t"], 24, 12), 5).alias("ar"))


@query("win06_market_adjusted", f"WITH {PRICES} SELECT firm, CAST(t AS VARCHAR) AS t, round(ret - avg(ret) OVER (PARTITION BY t), 6) AS mar FROM prices")
def _(spark, d):
    return prices(spark, d).select("firm", text("t"), r6(F.col("ret") - F.avg("ret").over(W.partitionBy("t"))).alias("mar"))


@query("win07_winsorised", f"WITH {PRICES}, q AS (SELECT year(t) AS y, count(ret) AS n, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM prices GROUP BY 1) SELECT firm, CAST(t AS VARCHAR) AS t, round(CASE WHEN ret IS NULL THEN NULL WHEN n >= 20 THEN greatest(least(ret, hi), lo) ELSE ret END, 6) AS w FROM prices JOIN q ON year(t) = y")
def _(spark, d):
    return R.winsorised(prices(spark, d).withColumn("y", F.year("t")), "ret", "y").select("firm", text("t"), r6(F.col("ret_w")).alias("w"))


@query("win08_lags", f"WITH {PRICES} SELECT firm, CAST(t AS VARCHAR) AS t, lag(vol) OVER (PARTITION BY firm ORDER BY t) AS l FROM bars")
def _(spark, d):
    return prices(spark, d).select("firm", text("t"), F.lag("vol").over(W.partitionBy("firm").orderBy("t")).alias("l"))


@query("win09_forward_sums", f"WITH {PRICES}, x AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY t) AS k, count(*) OVER (PARTITION BY firm) AS n FROM prices) SELECT firm, CAST(t AS VARCHAR) AS t, round(CASE WHEN count(ret) OVER a >= 1 AND k + 2 <= n THEN sum(ret) OVER a END, 6) AS c3, round(CASE WHEN count(ret) OVER b >= 5 AND k + 9 <= n THEN sum(ret) OVER b END, 6) AS c10 FROM x WINDOW a AS (PARTITION BY firm ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), b AS (PARTITION BY firm ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)")
def _(spark, d):
    f = lambda h: r6(R.forward_sum(F.col("ret"), ["firm"], ["t"], h))
    return prices(spark, d).select("firm", text("t"), f(3).alias("c3"), f(10).alias("c10"))


EXPO = "flags AS (SELECT l_suppkey AS firm, CAST(date_trunc('month', l_shipdate) AS DATE) AS t, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS g, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _flags(spark, d):
    f = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("l_extendedprice")).otherwise(0.0))
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("t")).agg(f("R").alias("g"), f("A").alias("c"), F.count(F.lit(1)).alias("n"))


@query("win10_trailing_exposure", f"WITH {EXPO} SELECT firm, CAST(t AS VARCHAR) AS t, round(CASE WHEN count(*) OVER w >= 12 THEN (sum(g) OVER w - sum(c) OVER w) / (sum(g) OVER w + sum(c) OVER w + 1e-6) END, 6) AS e FROM flags WINDOW w AS (PARTITION BY firm ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return _flags(spark, d).select("firm", text("t"), r6(R.trailing_ratio(F.col("g"), F.col("c"), ["firm"], ["t"], 24, 12)).alias("e"))


@query("win11_cross_z", f"WITH {PRICES} SELECT firm, CAST(t AS VARCHAR) AS t, round((ret - avg(ret) OVER (PARTITION BY t)) / nullif(CASE WHEN count(ret) OVER (PARTITION BY t) > 1 THEN stddev_samp(ret) OVER (PARTITION BY t) END, 0), 5) AS z FROM prices")
def _(spark, d):
    return prices(spark, d).select("firm", text("t"), F.round(R.cross_z(F.col("ret"), ["t"]), 5).alias("z"))


@query("win12_thin_fallback", f"WITH {FIRMS}, {EXPO} SELECT f.firm, CAST(t AS VARCHAR) AS t, round(CASE WHEN coalesce(n < 5, false) THEN avg(CASE WHEN NOT coalesce(n < 5, false) THEN g END) OVER (PARTITION BY category, t) ELSE g END, 4) AS x, CAST(coalesce(n < 5, false) AS INT) AS thin FROM flags f JOIN firms USING (firm)")
def _(spark, d):
    x, flag = R.thin_fallback(F.col("g"), F.col("n"), ["category", "t"], 5)
    return _flags(spark, d).join(firms(spark, d), "firm").select("firm", text("t"), r4(x).alias("x"), flag.alias("thin"))


@query("win13_moving_average", f"WITH {ATTENTION} SELECT CAST(bucket AS VARCHAR) AS bucket, round(CASE WHEN count(value) OVER w >= 10 THEN avg(value) OVER w END, 4) AS m FROM attention WINDOW w AS (ORDER BY bucket ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return attention(spark, d).select(text("bucket"), r4(R.rolling(F.avg, F.col("value"), [], ["bucket"], 30, 10)).alias("m"))


STUDY = f"{PANEL}, {EVENTS_SQL}, hi AS (SELECT quantile_cont(L_GPUExposure, 0.7) AS q FROM panel), grp AS (SELECT firm, 'high' AS grp FROM panel, hi GROUP BY firm HAVING max(CASE WHEN L_GPUExposure > q THEN 1 ELSE 0 END) = 1), per AS (SELECT grp, event, tau, avg(ar) AS m FROM kept, generate_series(-5, 20) t(tau), panel JOIN cal ON CAST(panel.date AS DATE) = cal.day JOIN grp USING (firm) WHERE cal.tpos = kept.tpos + tau GROUP BY 1, 2, 3), study AS (SELECT grp, tau, avg(m) AS mean_ar, CASE WHEN count(m) > 1 THEN stddev_samp(m) END / sqrt(count(m)) AS se, count(m) AS n_events FROM per GROUP BY 1, 2)"


def _study(spark, d):
    p = panel(spark, d)
    q = p.agg(F.percentile("L_GPUExposure", F.lit(0.7)).alias("q"))
    high = p.join(F.broadcast(q)).filter("L_GPUExposure > q").select("firm").distinct()
    x = p.join(high, "firm", "left_semi").withColumn("day", F.col("date").cast("date")).join(_calendar(spark, d), "day")
    s = E.event_study(x, _events(spark, d), F.lit("high"), "ar", -5, 20)
    return s.withColumn("se", F.when(F.col("n_events") > 1, F.col("se")))


@query("win14_cumulative", f"WITH {STUDY} SELECT tau, round(sum(mean_ar) OVER w, 6) AS car, round(sqrt(sum(se * se) OVER w), 6) AS car_se FROM study WINDOW w AS (PARTITION BY grp ORDER BY tau ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return E.cumulative(_study(spark, d)).select(F.col("tau").cast("bigint").alias("tau"), r6(F.col("car")).alias("car"), r6(F.col("car_se")).alias("car_se"))


@query("win15_gap_events", f"WITH {PANEL}, {EVENTS_SQL} SELECT event, tpos FROM kept")
def _(spark, d):
    return _events(spark, d).select(F.col("event").cast("bigint").alias("event"), F.col("tpos").cast("bigint").alias("tpos"))


@query("win16_standardised_flags", f"WITH {ATTENTION}, m AS (SELECT avg(value) AS a, stddev_samp(value) AS s, quantile_cont(value, 0.9) AS q FROM attention) SELECT CAST(bucket AS VARCHAR) AS bucket, round((value - a) / s, 6) AS z, CAST(coalesce(value >= q, false) AS INT) AS high FROM attention, m")
def _(spark, d):
    a = attention(spark, d)
    m = a.agg(F.avg("value").alias("a"), F.stddev_samp("value").alias("s"), F.percentile("value", F.lit(0.9)).alias("q"))
    return a.join(F.broadcast(m)).select(text("bucket"), r6((F.col("value") - F.col("a")) / F.col("s")).alias("z"), F.coalesce(F.col("value") >= F.col("q"), F.lit(False)).cast("int").alias("high"))


@query("win17_first_value", f"WITH {PANEL} SELECT firm, arg_min(ar, date) FILTER (ar IS NOT NULL) AS ar, arg_min(L_GPUExposure, date) FILTER (L_GPUExposure IS NOT NULL) AS g FROM panel GROUP BY 1")
def _(spark, d):
    return R.first_value(panel(spark, d), "firm", ["ar", "L_GPUExposure"], "date").withColumnRenamed("L_GPUExposure", "g")


@query("win18_round_robin", "SELECT article_id, language, row_number() OVER (PARTITION BY language ORDER BY article_id) AS turn FROM articles ORDER BY turn, language LIMIT 100")
def _(spark, d):
    return R.round_robin(table(spark, d, "articles").select("article_id", "language"), "language", ["article_id"], 100).select("article_id", "language", F.col("turn").cast("bigint").alias("turn"))


@query("win19_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("k"))


# ------------------------------------------------------------------ text scoring

LEX = [("raised", "up"), ("lifted", "up"), ("signed", "up"), ("lowered", "down"), ("cancelled", "down"), ("delayed", "down"), ("rack", "g"), ("boards", "g"), ("servers", "c"), ("switches", "c")]
LEX_SQL = "lex AS (SELECT unnest([" + ", ".join(f"'{w}'" for w, _ in LEX) + "]) AS word, unnest([" + ", ".join(f"'{g}'" for _, g in LEX) + "]) AS grp)"
TOK = f"{NOTES}, tok AS (SELECT nid, ts, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT nid, regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+') AS ts FROM notes)), words AS (SELECT nid, pos, ts[pos] AS word, CASE WHEN pos > 1 THEN ts[pos - 1] END AS prev FROM tok)"
HITS = f"{TOK}, {LEX_SQL}, raw AS (SELECT nid, word, grp, (coalesce(prev, '') LIKE '%not' OR coalesce(prev, '') LIKE '%never') AND grp IN ('up', 'down') AS neg FROM words JOIN lex USING (word)), hits AS (SELECT nid, word, CASE WHEN neg THEN CASE grp WHEN 'up' THEN 'down' ELSE 'up' END ELSE grp END AS grp, CAST(neg AS INT) AS negated, count(*) AS tf FROM raw GROUP BY 1, 2, 3, 4), idf AS (SELECT word, negated, count(DISTINCT nid) AS df, ln((1 + (SELECT count(*) FROM notes)) / (1.0 + count(DISTINCT nid))) + 1 AS idf FROM hits GROUP BY 1, 2), wt AS (SELECT nid, sum(CASE WHEN grp = 'g' THEN tf * idf ELSE 0 END) AS w_g, sum(CASE WHEN grp = 'c' THEN tf * idf ELSE 0 END) AS w_c, sum(CASE WHEN grp = 'up' THEN tf * idf ELSE 0 END) AS w_up, sum(CASE WHEN grp = 'down' THEN tf * idf ELSE 0 END) AS w_down FROM hits JOIN idf USING (word, negated) GROUP BY 1)"


def _hits(spark, d):
    lex = spark.createDataFrame(LEX, "word string, grp string")
    return T.lexicon_hits(notes(spark, d), "nid", "body", lex, ["not", "never"], {"up": "down", "down": "up"})


def _n(spark, d):
    return notes(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("txt01_tokens", f"WITH {NOTES} SELECT nid, len(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+')) AS n FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", F.size(T.tokens(F.col("body"))).cast("bigint").alias("n"))


@query("txt02_lexicon_hits", f"WITH {HITS} SELECT nid, word, grp, tf FROM hits WHERE negated = 0")
def _(spark, d):
    return _hits(spark, d).filter("negated = 0").select(F.col("id").alias("nid"), "word", "grp", "tf")


@query("txt03_negation", f"WITH {HITS} SELECT grp, negated, sum(tf)::BIGINT AS tf FROM hits GROUP BY 1, 2")
def _(spark, d):
    return _hits(spark, d).groupBy("grp", "negated").agg(F.sum("tf").alias("tf"))


@query("txt04_idf", f"WITH {HITS} SELECT word, negated, df, round(idf, 6) AS idf FROM idf")
def _(spark, d):
    return T.document_frequency(_hits(spark, d), _n(spark, d)).withColumn("idf", r6(F.col("idf")))


def _weights(spark, d):
    h = _hits(spark, d)
    return T.group_weights(h, T.document_frequency(h, _n(spark, d)), ["g", "c", "up", "down"])


@query("txt05_group_weights", f"WITH {HITS} SELECT nid, round(w_g, 5) AS w_g, round(w_c, 5) AS w_c, round(w_up, 5) AS w_up, round(w_down, 5) AS w_down FROM wt")
def _(spark, d):
    return _weights(spark, d).select(F.col("id").alias("nid"), *[F.round(c, 5).alias(c) for c in ("w_g", "w_c", "w_up", "w_down")])


@query("txt06_tfidf", f"WITH {TOK}, tf AS (SELECT nid, word, count(*) AS tf FROM words GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT nid, tf * (ln((1 + (SELECT count(*) FROM notes)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (word)) SELECT nid, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 5) AS top FROM w GROUP BY 1")
def _(spark, d):
    t = T.tfidf(notes(spark, d), "nid", "body", _n(spark, d))
    return t.groupBy(F.col("id").alias("nid")).agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 5).alias("top"))


@query("txt07_pattern_hits", f"WITH {NOTES} SELECT nid, array_to_string(regexp_extract_all(lower(coalesce(body, '')), 'switches|boards|racks|rack'), '|') AS hits FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", F.array_join(T.pattern_hits(F.col("body"), ["rack", "racks", "boards", "switches"]), "|").alias("hits"))


@query("txt08_article_index", f"WITH {HITS}, n AS (SELECT nid, sum(CASE WHEN grp = 'g' THEN tf ELSE 0 END) AS a, sum(CASE WHEN grp = 'c' THEN tf ELSE 0 END) AS b FROM hits GROUP BY 1) SELECT nid, round(CASE WHEN a + b > 0 THEN (a - b) / (a + b) END, 6) AS by_count, round(CASE WHEN w_g + w_c <> 0 THEN (w_g - w_c) / (w_g + w_c) END, 6) AS by_weight FROM n JOIN wt USING (nid)")
def _(spark, d):
    f = lambda g: F.sum(F.when(F.col("grp") == g, F.col("tf")).otherwise(0))
    n = _hits(spark, d).groupBy("id").agg(f("g").alias("a"), f("c").alias("b"))
    return n.join(_weights(spark, d), "id").select(F.col("id").alias("nid"), r6(M.balance_or_null(F.col("a"), F.col("b"))).alias("by_count"), r6(M.balance_or_null(F.col("w_g"), F.col("w_c"))).alias("by_weight"))


VOCAB = f"{TOK}, voc AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) + 3 AS token_id FROM (SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 300))"


@query("txt09_vocabulary", f"WITH {VOCAB} SELECT word AS token, n, token_id FROM voc")
def _(spark, d):
    return T.vocabulary(notes(spark, d), "nid", "body", 300).select("token", "n", F.col("token_id").cast("bigint").alias("token_id"))


@query("txt10_encode_fixed", f"WITH {VOCAB}, e AS (SELECT nid, coalesce(token_id, 1) AS v, pos FROM words LEFT JOIN voc USING (word) WHERE pos <= 31) SELECT n.nid, 2 + coalesce(sum(v), 0)::BIGINT AS checksum, 1 + count(v) AS used FROM notes n LEFT JOIN e ON n.nid = e.nid GROUP BY 1")
def _(spark, d):
    n = notes(spark, d)
    e = T.encode_fixed(n, "nid", "body", T.vocabulary(n, "nid", "body", 300), 32)
    return e.select(F.col("id").alias("nid"), F.aggregate("ids", F.lit(0), lambda a, x: a + x).cast("bigint").alias("checksum"), F.size(F.filter("ids", lambda x: x != 0)).cast("bigint").alias("used"))


@query("txt11_weak_labels", f"WITH {HITS}, t AS (SELECT nid, len(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{L}}\\p{{N}}]+')) AS nt FROM notes), s AS (SELECT nid, least(1.0, (w_g + w_c) / (nt * 0.02 + 3)) AS rel, (w_g - w_c) / (w_g + w_c + 1e-4) AS o, (w_up - w_down) / (w_up + w_down + 1e-4) AS tone FROM wt JOIN t USING (nid)) SELECT nid, round(rel, 5) AS rel, CAST(rel > 0.35 AS INT) AS y_rel, CASE WHEN o > 0.3 THEN 1 WHEN o < -0.3 THEN -1 ELSE 0 END AS y_object, CASE WHEN tone > 0.2 THEN 1 WHEN tone < -0.2 THEN -1 ELSE 0 END AS y_tone FROM s")
def _(spark, d):
    nt = notes(spark, d).select(F.col("nid").alias("id"), F.size(T.tokens(F.col("body"))).alias("nt"))
    x = T.weak_labels(_weights(spark, d).join(nt, "id"), "g", "c", "up", "down")
    return x.select(F.col("id").alias("nid"), F.round("rel", 5).alias("rel"), "y_rel", "y_object", "y_tone")


@query("txt12_mentions", "SELECT DISTINCT article_id, thscode FROM articles, (SELECT thscode, unnest(alias) AS a FROM firm_master) WHERE a <> '' AND contains(content, a)")
def _(spark, d):
    # a dictionary of firms, read by every worker's automaton
    al = table(spark, d, "firm_master").select("thscode", F.explode("alias").alias("a"))
    return T.alias_blocks(table(spark, d, "articles"), "article_id", "content", al, "thscode", "a").select(F.col("id").alias("article_id"), F.col("key").alias("thscode"))


@query("txt13_vector_scores", "WITH q AS (SELECT label AS cls, k, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2), c AS (SELECT cls, list(m ORDER BY k) AS v FROM q GROUP BY 1) SELECT vec_id, cls, round(list_dot_product(embedding::DOUBLE[], v) / nullif(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v)), 0), 5) AS score FROM embeddings, c")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    mean = e.select("label", F.posexplode("e").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    v = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("v")).withColumnRenamed("label", "cls")
    return e.join(F.broadcast(v)).select("vec_id", "cls", F.round(T.cosine(F.col("e"), F.col("v")), 5).alias("score"))  # as many vectors as classes


@query("txt14_source_class", "SELECT article_id, CASE WHEN regexp_matches(source, '财讯|证券|Markets') THEN 'finance' WHEN regexp_matches(source, '科技|数码|Tech') THEN 'tech' ELSE 'other' END AS cls FROM articles")
def _(spark, d):
    c = F.when(F.col("source").rlike("财讯|证券|Markets"), "finance").when(F.col("source").rlike("科技|数码|Tech"), "tech").otherwise("other")
    return table(spark, d, "articles").select("article_id", c.alias("cls"))


@query("txt15_scoring_text", "SELECT article_id, md5(substr(concat_ws('。', title, content), 1, 1600)) AS h FROM articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", F.md5(T.scoring_text(F.col("title"), F.col("content"), 1600)).alias("h"))


# ------------------------------------------------------------------ series and panels


@query("eco01_ar1_innovation", f"WITH {ATTENTION}, l AS (SELECT bucket, value, lag(value) OVER (ORDER BY bucket) AS p FROM attention), f AS (SELECT bucket, value, CASE WHEN regr_count(value, p) OVER w >= 24 THEN regr_intercept(value, p) OVER w + regr_slope(value, p) OVER w * p END AS f FROM l WINDOW w AS (ORDER BY bucket ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)) SELECT CAST(bucket AS VARCHAR) AS bucket, round(value - f, 3) AS innovation FROM f")
def _(spark, d):
    a = attention(spark, d).withColumn("k", F.lit("all"))
    return E.ar1(a, "k", "bucket", "value", 36, 24).select(text("bucket"), F.round("innovation", 3).alias("innovation"))


@query("eco01_arx")
def _(spark, d):
    s = _series(spark, d).join(table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("bucket")).agg(F.log1p(F.count(F.lit(1))).alias("x")), "bucket")
    return E.arx(s, "source", "bucket", "v", ["x"], 2, 20, 8).withColumn("bucket", F.col("bucket").cast("string"))


@query("eco02_ar5_residual")
def _(spark, d):
    a = attention(spark, d).select(F.lit("all").alias("k"), "bucket", "value")
    return E.arx(a, "k", "bucket", "value", [], 5, 48, 30).withColumn("bucket", F.col("bucket").cast("string"))


@query("eco03_bucket_regressors", f"WITH {SIGNAL} SELECT CAST(bucket AS VARCHAR) AS bucket, round(ln(1 + count(*)), 6) AS ln_n, CAST(isodow(bucket) = 1 AS INT) AS mon, CAST(isodow(bucket) = 5 AS INT) AS fri FROM signal GROUP BY bucket")
def _(spark, d):
    g = signal(spark, d).groupBy("bucket").agg(r6(F.log1p(F.count(F.lit(1)))).alias("ln_n"))
    return g.select(text("bucket"), "ln_n", D.is_weekday(F.col("bucket"), 0).alias("mon"), D.is_weekday(F.col("bucket"), 4).alias("fri"))


@query("eco05_ols", f"WITH {PANEL} SELECT round(regr_slope(ar, mar), 6) AS slope, round(regr_intercept(ar, mar), 6) AS intercept, regr_count(ar, mar) AS n FROM panel")
def _(spark, d):
    p = panel(spark, d).filter("ar is not null and mar is not null").select("ar", "mar", F.lit(1.0).alias("one"))
    b, _, n, _ = E.ols(p, "ar", ["mar", "one"])
    return spark.createDataFrame([(round(float(b[0]), 6), round(float(b[1]), 6), n)], "slope double, intercept double, n long")


@query("eco13_event_study", f"WITH {STUDY} SELECT tau, round(mean_ar, 5) AS mean_ar, round(se, 5) AS se, n_events FROM study")
def _(spark, d):
    return _study(spark, d).select(F.col("tau").cast("bigint").alias("tau"), F.round("mean_ar", 5).alias("mean_ar"), F.round("se", 5).alias("se"), "n_events")


CONTRAST = f"{PANEL}, cal AS (SELECT day, row_number() OVER (ORDER BY day) AS tpos FROM (SELECT DISTINCT CAST(date AS DATE) AS day FROM panel)), top AS (SELECT CAST(date AS DATE) AS day, max(GCS) AS s FROM panel GROUP BY 1), ev AS (SELECT thr, tpos, row_number() OVER (PARTITION BY thr ORDER BY tpos) AS event, tpos - lag(tpos) OVER (PARTITION BY thr ORDER BY tpos) AS gap FROM top JOIN cal USING (day), (SELECT 'top10' AS thr, quantile_cont(s, 0.9) AS q FROM top UNION ALL SELECT 'top05', quantile_cont(s, 0.95) FROM top) WHERE s >= q), kept AS (SELECT * FROM ev WHERE gap >= 3 OR gap IS NULL), q AS (SELECT quantile_cont(L_GPUExposure, 0.7) AS g, quantile_cont(L_CPUExposure, 0.7) AS c FROM panel), grp AS (SELECT DISTINCT firm, 'g' AS grp FROM panel, q WHERE L_GPUExposure > g UNION ALL SELECT DISTINCT firm, 'c' FROM panel, q WHERE L_CPUExposure > c), per AS (SELECT thr, grp, event, tau, avg(ar) AS m FROM kept, generate_series(-5, 20) t(tau), panel JOIN cal ON CAST(panel.date AS DATE) = cal.day JOIN grp USING (firm) WHERE cal.tpos = kept.tpos + tau GROUP BY 1, 2, 3, 4), st AS (SELECT thr, grp, tau, avg(m) AS m, CASE WHEN count(m) > 1 THEN var_samp(m) END / count(m) AS v FROM per GROUP BY 1, 2, 3)"


@query("eco13_contrast", f"WITH {CONTRAST} SELECT thr, tau, round(g.m, 9) AS mean_g, round(c.m, 9) AS mean_c, round(g.m - c.m, 9) AS diff, round(sqrt(g.v + c.v), 9) AS se_diff FROM (SELECT * FROM st WHERE grp = 'g') g JOIN (SELECT * FROM st WHERE grp = 'c') c USING (thr, tau)")
def _(spark, d):
    p = panel(spark, d).withColumn("day", F.col("date").cast("date"))
    q = p.agg(F.percentile("L_GPUExposure", F.lit(0.7)).alias("qg"), F.percentile("L_CPUExposure", F.lit(0.7)).alias("qc"))
    ever = p.join(F.broadcast(q)).groupBy("firm").agg(F.max(F.col("L_GPUExposure") > F.col("qg")).alias("g"), F.max(F.col("L_CPUExposure") > F.col("qc")).alias("c"))
    grp = ever.select("firm", F.explode(F.filter(F.array(F.when(F.col("g"), "g"), F.when(F.col("c"), "c")), lambda x: x.isNotNull())).alias("grp"))
    rows = p.join(_calendar(spark, d), "day").join(grp, "firm")
    top = p.groupBy("day").agg(F.max("GCS").alias("s"))
    cuts = top.agg(F.percentile("s", F.lit(0.9)).alias("top10"), F.percentile("s", F.lit(0.95)).alias("top05")).unpivot([], ["top10", "top05"], "thr", "q")
    ev = top.join(_calendar(spark, d), "day").join(F.broadcast(cuts)).filter("s >= q")
    at = W.partitionBy("thr").orderBy("tpos")
    ev = ev.withColumn("event", F.row_number().over(at)).withColumn("gap", F.col("tpos") - F.lag("tpos").over(at)).filter("gap >= 3 or gap is null")
    out = None
    for thr in ("top10", "top05"):
        one = E.contrast(E.event_study(rows, ev.filter(F.col("thr") == thr), F.col("grp"), "ar", -5, 20), "g", "c")
        one = one.select(F.lit(thr).alias("thr"), F.col("tau").cast("bigint").alias("tau"), *[F.round(x, 9).alias(x) for x in ("mean_g", "mean_c", "diff", "se_diff")])
        out = one if out is None else out.unionByName(one)
    return out


@query("eco01_three_frequencies")
def _(spark, d):
    """The published settings: windows of 252 days, 52 weeks and 36 months, lags 5, 2 and 1, least 120, 30 and 24 rows."""
    o = table(spark, d, "orders")
    out = None
    for unit, w, p, least in (("day", 252, 5, 120), ("week", 52, 2, 30), ("month", 36, 1, 24)):
        s = o.groupBy(F.date_trunc(unit, "o_orderdate").cast("date").alias("bucket")).agg(F.avg("o_totalprice").alias("value"), F.log1p(F.count(F.lit(1))).alias("x")).withColumn("freq", F.lit(unit))
        one = E.arx(s, "freq", "bucket", "value", ["x"], p, w, least).select("freq", text("bucket"), F.round("innovation", 3).alias("innovation"), F.round("r2", 6).alias("r2"))
        out = one if out is None else out.unionByName(one)
    return out


@query("eco25_topic_innovation", f"WITH {NOTES}, t AS (SELECT source, strftime(date, '%Y-%m') AS bucket, count(*) AS n, ln(1 + count(*)) AS v FROM notes WHERE date IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY source ORDER BY bucket) AS p, sum(n) OVER (PARTITION BY source) AS total FROM t) SELECT source, bucket, round(v - CASE WHEN regr_count(v, p) OVER w >= 12 THEN regr_intercept(v, p) OVER w + regr_slope(v, p) OVER w * p END, 4) AS innovation FROM l WHERE total >= 20 WINDOW w AS (PARTITION BY source ORDER BY bucket ROWS BETWEEN 36 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    g = notes(spark, d).filter("date is not null and source is not null").groupBy("source", D.month_key(F.col("date")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.log1p(F.count(F.lit(1))).alias("v"))
    c = g.withColumn("total", F.sum("n").over(W.partitionBy("source"))).filter("total >= 20")
    return E.ar1(c, "source", "bucket", "v", 36, 12).select("source", "bucket", F.round("innovation", 4).alias("innovation"))


@query("eco22_monthly_mix", "SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (category = 'G1') AS g1, count(*) FILTER (category = 'G2') AS g2, count(*) FILTER (category = 'G3') AS g3, count(*) FILTER (category = 'G4') AS g4 FROM panel_daily GROUP BY 1 HAVING count(*) >= 200")
def _(spark, d):
    p = table(spark, d, "panel_daily").withColumn("month", D.month_key(F.col("date")))
    g = p.groupBy("month").pivot("category", ["G1", "G2", "G3", "G4"]).agg(F.count(F.lit(1))).join(p.groupBy("month").agg(F.count(F.lit(1)).alias("n")).filter("n >= 200"), "month")
    return g.select("month", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in ("G1", "G2", "G3", "G4")])


@query("eco16_index_variants", f"WITH {SIGNAL}, v AS (SELECT 'mean' AS variant, source, bucket, avg(v) AS v FROM signal GROUP BY 2, 3 UNION ALL SELECT 'max', source, bucket, max(v) FROM signal GROUP BY 2, 3), z AS (SELECT variant, bucket, CASE WHEN count(v) OVER w >= 4 AND stddev_samp(v) OVER w > 1e-6 THEN greatest(-6, least(6, (v - avg(v) OVER w) / stddev_samp(v) OVER w)) END AS z FROM v WINDOW w AS (PARTITION BY variant, source ORDER BY bucket ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT variant, CAST(bucket AS VARCHAR) AS bucket, round(avg(z), 5) AS z FROM z GROUP BY 1, 2")
def _(spark, d):
    s = signal(spark, d)
    v = s.groupBy("source", "bucket").agg(F.avg("v").alias("mean"), F.max("v").alias("max")).unpivot(["source", "bucket"], ["mean", "max"], "variant", "v")
    z = v.withColumn("z", R.lagged_z(F.col("v"), ["variant", "source"], ["bucket"], 10, 4))
    return z.groupBy("variant", "bucket").agg(F.round(F.avg("z"), 5).alias("z")).select("variant", text("bucket"), "z")


@query("eco18_placebo")
def _(spark, d):
    r = panel(spark, d).select(F.col("date").alias("day"), "ar", "UGCS_std", "L_GPUExposure", "L_CPUExposure")
    cal = r.groupBy("day").agg(F.max("UGCS_std").alias("u")).filter("u is not null")
    x = E.placebo(r, "ar", "L_GPUExposure", "L_CPUExposure", "day", cal, "u", 200, 11)
    real = x.filter("rep = -1").select(F.abs("delta").alias("real"))
    return x.filter("rep >= 0").join(F.broadcast(real)).agg(F.count(F.lit(1)).alias("reps"), F.avg((F.abs("delta") >= F.col("real")).cast("double")).alias("share"))


@query("eco21_multiple_tests", "WITH t(k, p) AS (VALUES (1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, 0.005), (6, 0.5)), r AS (SELECT k, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM t) SELECT k, CAST(p AS DOUBLE) AS p, round(least(1.0, p * n), 6)::DOUBLE AS bonferroni, round(least(1.0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS bh FROM r")
def _(spark, d):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, 0.005), (6, 0.5)], "k int, p double")
    return E.adjusted(t, "p").select("k", "p", r6(F.col("bonferroni")).alias("bonferroni"), r6(F.col("bh")).alias("bh"))


@query("eco22_composition", f"WITH {PANEL}, e AS (SELECT quantile_cont(L_GPUExposure, 0.25) AS a, quantile_cont(L_GPUExposure, 0.5) AS b, quantile_cont(L_GPUExposure, 0.75) AS c FROM panel) SELECT CASE WHEN L_GPUExposure <= a THEN 1 WHEN L_GPUExposure <= b THEN 2 WHEN L_GPUExposure <= c THEN 3 ELSE 4 END AS bin, count(ar) AS n, round(avg(ar), 6) AS mean, round(1.96 * stddev_samp(ar) / sqrt(count(ar)), 6) AS half FROM panel, e WHERE L_GPUExposure IS NOT NULL GROUP BY 1")
def _(spark, d):
    p = panel(spark, d).filter("L_GPUExposure is not null")
    e = p.agg(*[F.percentile("L_GPUExposure", F.lit(q)).alias(n) for q, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))])
    x = F.col("L_GPUExposure")
    b = F.when(x <= F.col("a"), 1).when(x <= F.col("b"), 2).when(x <= F.col("c"), 3).otherwise(4)
    return p.join(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count("ar").alias("n"), r6(F.avg("ar")).alias("mean"), r6(1.96 * F.stddev_samp("ar") / F.sqrt(F.count("ar"))).alias("half"))


@query("eco23_window_cars", f"WITH {STUDY}, s(a, b) AS (VALUES (-1, 1), (0, 5), (0, 10), (0, 20)) SELECT concat('[', a, ',', b, ']') AS span, round(sum(mean_ar), 6) AS car, round(sum(mean_ar) / nullif(sqrt(sum(se * se)), 0), 4) AS t FROM study, s WHERE tau BETWEEN a AND b GROUP BY a, b")
def _(spark, d):
    return E.window_cars(_study(spark, d), [(-1, 1), (0, 5), (0, 10), (0, 20)]).select("span", r6(F.col("car")).alias("car"), r4(F.col("t")).alias("t"))


@query("eco24_clusters")
def _(spark, d):
    s = _series(spark, d).groupBy("bucket").pivot("source").agg(F.first("v"))
    names = [c for c in s.columns if c != "bucket"]
    r = s.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).collect()[0]  # a matrix of topics
    import numpy as np

    m = np.array([[r[f"{i}_{j}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    return spark.createDataFrame([(int(a), int(b), float(h)) for a, b, h in E.average_linkage(m)], "a int, b int, height double")


@query("eco25_topic_index", f"WITH {NOTES}, t AS (SELECT source, strftime(date, '%Y-%m') AS bucket, count(*) AS n, ln(1 + avg(length(body))) AS v FROM notes WHERE date IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM t) SELECT source, bucket, n, round(CASE WHEN v IS NOT NULL AND count(v) OVER w >= 6 AND stddev_samp(v) OVER w > 1e-6 THEN greatest(-6, least(6, (v - avg(v) OVER w) / stddev_samp(v) OVER w)) END, 5) AS z FROM c WHERE total >= 20 WINDOW w AS (PARTITION BY source ORDER BY bucket ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    g = notes(spark, d).filter("date is not null and source is not null").groupBy("source", D.month_key(F.col("date")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.log1p(F.avg(F.length("body"))).alias("v"))
    c = g.withColumn("total", F.sum("n").over(W.partitionBy("source"))).filter("total >= 20")
    return c.select("source", "bucket", "n", F.round(R.lagged_z(F.col("v"), ["source"], ["bucket"], 12, 6), 5).alias("z"))


# ------------------------------------------------------------------ evaluation


@query("mdl01_time_split", f"WITH {NOTES} SELECT CASE WHEN date <= DATE '2023-12-31' THEN 'train' WHEN date <= DATE '2024-12-31' THEN 'valid' WHEN date IS NOT NULL THEN 'test' END AS part, count(*) AS n FROM notes GROUP BY 1")
def _(spark, d):
    return notes(spark, d).groupBy(V.time_split(F.col("date"), "2023-12-31", "2024-12-31").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("mdl02_weighted_sample")
def _(spark, d):
    return V.weighted_sample(table(spark, d, "documents").filter("n_chars > 0").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 100, 5)


CONF = "conf AS (SELECT label AS truth, CAST(floor(9.999 * CAST(embedding[1] + 1 AS DOUBLE) / 2) AS INT) AS guess, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY 1, 2)"


def _conf(spark, d):
    e = table(spark, d, "embeddings").select("label", F.floor(9.999 * (F.element_at("embedding", 1) + F.lit(1).cast("float")).cast("double") / 2).cast("int").alias("g"))
    return V.confusion(e, "label", "g")


@query("mdl06_confusion", f"WITH {CONF} SELECT truth, guess, n FROM conf")
def _(spark, d):
    return _conf(spark, d)


@query("mdl06_class_scores", f"WITH {CONF}, t AS (SELECT truth AS cls, sum(n) AS t FROM conf GROUP BY 1), g AS (SELECT guess AS cls, sum(n) AS g FROM conf GROUP BY 1), h AS (SELECT truth AS cls, n AS h FROM conf WHERE truth = guess), x AS (SELECT cls, coalesce(t, 0) AS t, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM t FULL JOIN g USING (cls) LEFT JOIN h USING (cls)) SELECT cls, round(coalesce(h / nullif(g, 0), 0), 6) AS precision, round(coalesce(h / nullif(t, 0), 0), 6) AS recall FROM x")
def _(spark, d):
    return V.class_scores(_conf(spark, d)).select("cls", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("mdl06_macro_f1")
def _(spark, d):
    return V.macro_f1(_conf(spark, d))


@query("mdl06_auroc", "WITH s AS (SELECT CAST(label >= 5 AS INT) AS y, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings) SELECT round(sum(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auroc FROM (SELECT s FROM s WHERE y = 1) p, (SELECT s FROM s WHERE y = 0) q")
def _(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") >= 5).cast("int").alias("y"), F.element_at("embedding", 1).cast("double").alias("s"))
    return V.auroc(e, "y", "s").withColumn("auroc", r6(F.col("auroc").cast("double")))


@query("mdl07_batch_scores", "SELECT vec_id, round(CAST(list_sum(embedding) AS DOUBLE) / 64, 4) AS s FROM embeddings")
def _(spark, d):
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            m = np.stack([np.asarray(x, float) for x in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, 64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.mean(1))], names=["vec_id", "s"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, s double").withColumn("s", r4(F.col("s")))


@query("mdl08_row_shares", f"WITH {CONF} SELECT truth, guess, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM conf")
def _(spark, d):
    return V.row_shares(_conf(spark, d)).select("truth", "guess", r6(F.col("share")).alias("share"))


# ------------------------------------------------------------------ order and sets


@query("srt01_sort", "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def _(spark, d):
    return table(spark, d, "supplier").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey").select("s_nationkey", "s_suppkey")


@query("srt02_top", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def _(spark, d):
    return table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber")


@query("set01_union", "SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"))).distinct()


@query("set02_seeds", "SELECT url, min(seq) AS seq FROM (SELECT url, article_id AS seq FROM articles UNION ALL SELECT url, 1000000000 + news_id FROM news) WHERE url IS NOT NULL GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "articles").select("url", F.col("article_id").alias("seq"))
    n = table(spark, d, "news").select("url", (F.col("news_id") + 1000000000).alias("seq"))
    return a.unionByName(n).filter("url is not null").groupBy("url").agg(F.min("seq").alias("seq"))
