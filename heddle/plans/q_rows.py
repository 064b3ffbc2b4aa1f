"""Queries of sources, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import maths as M
from ..functions import strings as S
from ..operators import filters as X
from ..sources import readers as R
from ..sources import sinks as K
from .bindings import NOTES, notes, table
from .registry import query

md = lambda c: F.md5(c)
SPACES, NO_WIDTH = S.SPACES, S.NO_WIDTH
WORDS = ["board", "gpu", "kupfer", "算力", "芯片", "server", "光模块"]

# ------------------------------------------------------------------ sources


def _lines(spark, d):
    t = table(spark, d, "documents")
    good = F.to_json(F.struct("doc_id", "section", "n_chars"))
    return t.select(F.col("doc_id").alias("line_no"), F.when(F.col("source").isNull(), F.substring(good, 1, 12)).otherwise(good).alias("value"))


@query("src01_json_lines", "SELECT doc_id AS line_no, doc_id, section, n_chars FROM documents WHERE source IS NOT NULL")
def _(spark, d):
    return R.good_lines(R.parse_lines(_lines(spark, d), "value", "doc_id bigint, section string, n_chars bigint"))


@query("src02_broken_lines", "SELECT doc_id AS line_no FROM documents WHERE source IS NULL")
def _(spark, d):
    return R.bad_lines(R.parse_lines(_lines(spark, d), "value", "doc_id bigint, section string, n_chars bigint")).select("line_no")


@query("src03_json_documents", "SELECT coalesce(source, '') AS holder, doc_id FROM documents")
def _(spark, d):
    t = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("holder")).agg(F.to_json(F.collect_list(F.struct("doc_id"))).alias("l"))
    shape = F.when(F.length("holder") % 3 == 0, F.col("l")).otherwise(F.concat(F.lit('{"items":'), F.col("l"), F.lit("}")))
    return R.json_documents(t.select("holder", shape.alias("doc")), "doc", "doc_id bigint")


@query("src04_csv", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    from ..operators.dedup import _shared

    path = _shared(table(spark, d, "nation"))
    K.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path, bom=True)
    return R.csv(spark, path, "n_nationkey int, n_name string")


@query("src05_projection", "SELECT event_type, sum(value) AS total FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").select("event_type", "value").groupBy("event_type").agg(F.sum("value").alias("total")).select("event_type", F.round("total", 4).alias("total"))


@query("src06_key_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(spark, d):
    k = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.only_keys(table(spark, d, "lineitem"), k, "l_suppkey").select("l_orderkey", "l_linenumber")


@query("src07_numbers", "SELECT panel_id, ret, ar FROM panel_daily")
def _(spark, d):
    p = table(spark, d, "panel_daily").select("panel_id", *[F.coalesce(F.col(c).cast("string"), F.lit("--")).alias(c) for c in ("ret", "ar")])
    return R.numbers(p, ["ret", "ar"])


@query("src09_recursive_json", "SELECT r_regionkey AS k, r_name AS name FROM region")
def _(spark, d):
    from ..operators.dedup import _shared

    t = table(spark, d, "region")
    path = _shared(t)
    t.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 2).alias("part")).write.partitionBy("part").json(path)
    return R.good_lines(R.json_lines(spark, path, "k int, name string", recursive=True, pattern="*.json"))


@query("src10_priority_union", "SELECT n_name AS name, 0 AS priority FROM nation UNION ALL SELECT r_name, 1 FROM region")
def _(spark, d):
    return R.ordered_union([table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))])


@query("src13_vectors", "SELECT vec_id, len(embedding) AS dim, round(CAST(list_sum(embedding) AS DOUBLE), 4) AS total FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 4).alias("total"))


@query("src14_sectioned_words", "SELECT unnest(['grow', 'grow', 'grow', 'cut', 'cut']) AS grp, unnest(['raise', 'lift', 'build', 'lower', 'delay']) AS word")
def _(spark, d):
    lines = ["[grow]", "raise、lift", "build", "", "[cut]", "lower, delay"]
    return R.sectioned_words(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))


@query("src15_stop_words", NOTES and f"WITH {NOTES}, t AS (SELECT nid, unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z]+')) AS w FROM notes) SELECT nid, count(*) AS kept FROM t WHERE w NOT IN ('the', 'of', 'a') GROUP BY nid")
def _(spark, d):
    stop = R.stop_words(spark.createDataFrame([("the",), ("of",), (" a ",), ("# note",), ("",)], "value string"))
    t = notes(spark, d).select("nid", F.explode(F.regexp_extract_all(F.lower(F.coalesce("body", F.lit(""))), F.lit("([a-z]+)"))).alias("word"))
    return t.join(F.broadcast(stop), "word", "left_anti").groupBy("nid").agg(F.count(F.lit(1)).alias("kept"))


@query("snk05_insert_new", "SELECT min(news_id) AS n, uuid FROM news GROUP BY uuid HAVING count(*) > 0 AND uuid NOT IN (SELECT uuid FROM news WHERE source IS NULL AND uuid IS NOT NULL)")
def _(spark, d):
    n = table(spark, d, "news")
    old = n.filter("source is null and uuid is not null").select("uuid")
    from ..operators.dedup import _shared

    path = _shared(n)
    old.distinct().select("uuid", F.lit(None).cast("long").alias("n")).write.parquet(path)
    K.insert_new(n.filter("uuid is not null").groupBy("uuid").agg(F.min("news_id").alias("n")), path, ["uuid"])
    return spark.read.parquet(path).filter("n is not null").select("n", "uuid")


@query("snk09_relabel", "SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(s_nationkey AS VARCHAR) END AS nat FROM supplier")
def _(spark, d):
    labels = spark.createDataFrame([("1", "one"), ("2", "two")], "old string, new string")
    return K.relabel(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nat")), "nat", labels, "old", "new")


@query("snk08_ordered_export", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# ------------------------------------------------------------------ filters


@query("flt01_date_range", f"WITH {NOTES} SELECT nid FROM notes WHERE date BETWEEN DATE '2023-01-01' AND DATE '2024-06-30'")
def _(spark, d):
    return notes(spark, d).filter(F.col("date").between("2023-01-01", "2024-06-30")).select("nid")


@query("flt02_script_share", f"WITH {NOTES} SELECT nid FROM notes WHERE length(body) > 100 AND length(regexp_replace(substr(body, 1, 800), '[^\\p{{Han}}]', '', 'g')) / length(substr(body, 1, 800)) < 0.15")
def _(spark, d):
    return notes(spark, d).filter(X.foreign(F.col("body"))).select("nid")


@query("flt03_garbled", f"WITH {NOTES} SELECT nid FROM notes WHERE len(regexp_extract_all(substr(body, 1, 2000), 'Ã.|â€|ï¼|å|æ|ç')) >= 3")
def _(spark, d):
    return notes(spark, d).filter(X.garbled(F.col("body"))).select("nid")


@query("flt04_corrupt", "SELECT article_id FROM articles WHERE length(content) - length(replace(content, '�', '')) >= 2 OR length(content) - length(replace(content, '?', '')) > greatest(8, floor(length(content) / 5))")
def _(spark, d):
    return table(spark, d, "articles").filter(X.corrupt(F.col("content"))).select("article_id")


@query("flt05_least_length", f"WITH {NOTES} SELECT nid FROM notes WHERE length(body) >= 150")
def _(spark, d):
    return notes(spark, d).filter(X.long_enough(F.col("body"), 150)).select("nid")


@query("flt06_relevance_gate", f"WITH {NOTES} SELECT nid FROM notes WHERE regexp_matches(substr(body, 1, 3000), '(?i)board|server|算力|光模块')")
def _(spark, d):
    return notes(spark, d).filter(X.relevant(F.col("body"), "(?i)board|server|算力|光模块")).select("nid")


@query("flt07_competing_signal", f"WITH {NOTES} SELECT nid FROM notes WHERE len(regexp_extract_all(body, 'share|crown|revenue|亿元')) >= 2 AND len(regexp_extract_all(body, 'share|crown|revenue|亿元')) > len(regexp_extract_all(body, 'board|rack|芯片'))")
def _(spark, d):
    return notes(spark, d).filter(X.drowned(F.col("body"), "board|rack|芯片", "share|crown|revenue|亿元")).select("nid")


@query("flt08_blacklist", f"WITH {NOTES} SELECT nid FROM notes WHERE NOT regexp_matches(concat(coalesce(title, ''), '‖', coalesce(body, '')), 'lottery|horoscope|分享到')")
def _(spark, d):
    return notes(spark, d).filter(~F.concat(F.coalesce("title", F.lit("")), F.lit("‖"), F.coalesce("body", F.lit(""))).rlike("lottery|horoscope|分享到")).select("nid")


@query("flt09_keyword_hits", f"WITH {NOTES} SELECT nid, array_to_string(list_filter({WORDS!r}, lambda x: contains(lower(coalesce(body, '')), lower(x))), '|') AS hits FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", F.array_join(X.keyword_hits(F.col("body"), WORDS), "|").alias("hits"))


@query("flt10_core_or_context", f"""WITH {NOTES}, h AS (SELECT nid, list_filter(['gpu', 'hmx3'], lambda x: contains(lower(coalesce(body, '')), x)) AS core, list_filter(['rack', 'board'], lambda x: contains(lower(coalesce(body, '')), x)) AS tech, list_filter(['cluster', 'tender'], lambda x: contains(lower(coalesce(body, '')), x)) AS ctx FROM notes)
SELECT nid, array_to_string(list_sort(list_distinct(list_concat(core, CASE WHEN len(ctx) > 0 THEN tech ELSE [] END))), '|') AS hits FROM h""")
def _(spark, d):
    return notes(spark, d).select("nid", F.array_join(X.core_or_context(F.col("body"), ["gpu", "hmx3"], ["rack", "board"], ["cluster", "tender"]), "|").alias("hits"))


@query("flt11_keyword_groups", f"""WITH {NOTES}, h AS (SELECT nid, lower(coalesce(body, '')) AS b FROM notes)
SELECT nid, array_to_string(CASE WHEN contains(b, 'rack') AND contains(b, 'cluster') AND NOT contains(b, 'tender') THEN ['rack', 'cluster'] ELSE [] END || CASE WHEN contains(b, 'board') OR contains(b, 'wind') THEN list_filter(['board', 'wind'], lambda x: contains(b, x)) ELSE [] END, '|') AS hits FROM h""")
def _(spark, d):
    g = [{"all": ["rack", "cluster"], "exclude": ["tender"]}, {"any": ["board", "wind"]}]
    return notes(spark, d).select("nid", F.array_join(X.group_hits(F.col("body"), g), "|").alias("hits"))


@query("flt12_relevance_score", f"""WITH {NOTES}, h AS (SELECT nid, lower(coalesce(title, '')) AS t, lower(concat_ws(' ', title, body)) AS b, length(body) AS n FROM notes)
SELECT nid, CAST(10 * len(list_filter(['gpu', 'hmx3'], lambda x: contains(t, x))) + 5 * len(list_filter(['gpu', 'hmx3'], lambda x: contains(b, x))) + 2 * len(list_filter(['model'], lambda x: contains(b, x))) + 3 * len(list_filter(['rack', 'board'], lambda x: contains(b, x))) + len(list_filter(['wind', 'cluster'], lambda x: contains(b, x)))
 + CASE WHEN contains(t, 'model') THEN 8 ELSE 0 END + CASE WHEN contains(t, 'rack') OR contains(t, 'board') THEN 6 ELSE 0 END - CASE WHEN n < 120 THEN 8 ELSE 0 END - CASE WHEN contains(b, 'lottery') THEN 100 ELSE 0 END AS BIGINT) AS score FROM h""")
def _(spark, d):
    s = X.relevance(F.col("title"), F.col("body"), ["gpu", "hmx3"], ["model"], ["rack", "board"], ["wind", "cluster"], ["lottery"])
    return notes(spark, d).select("nid", s.cast("bigint").alias("score"))


@query("flt13_missing_fields", "SELECT article_id, array_to_string(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(content), '') = '' THEN 'content' END, CASE WHEN coalesce(trim(source), '') = '' THEN 'source' END], lambda x: x IS NOT NULL), '|') AS missing FROM articles")
def _(spark, d):
    a = table(spark, d, "articles")
    return a.select("article_id", F.array_join(X.missing_fields(a, ["title", "content", "source"]), "|").alias("missing"))


@query("flt14_drop_reasons", f"""WITH {NOTES} SELECT CASE WHEN date IS NULL THEN 'no date' WHEN coalesce(body, '') = '' THEN 'empty' WHEN length(body) < 150 THEN 'short' WHEN NOT regexp_matches(body, '(?i)board|server|算力') THEN 'off topic' ELSE 'kept' END AS reason, count(*) AS n FROM notes GROUP BY 1""")
def _(spark, d):
    r = X.drop_reason([("no date", F.col("date").isNull()), ("empty", F.coalesce("body", F.lit("")) == ""), ("short", F.length("body") < 150), ("off topic", ~F.col("body").rlike("(?i)board|server|算力"))])
    return notes(spark, d).groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt15_sane_return", "SELECT panel_id, CASE WHEN abs(ret) <= 0.02 THEN ret END AS ret FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", X.sane(F.col("ret"), 0.02).alias("ret"))


# ------------------------------------------------------------------ strings

_sp = f"[{SPACES}]+"


@query("str01_clean_text", f"WITH {NOTES} SELECT nid, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '[\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g'), '<[^<>]{{0,200}}>', '', 'g'), '[{NO_WIDTH}]', '', 'g'), '{_sp}', ' ', 'g'), '^ | $', '', 'g')) AS h FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", md(S.clean_text(F.col("body"))).alias("h"))


@query("str02_clean_lines", f"WITH {NOTES} SELECT nid, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{{A0}}\\x{{3000}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\n ]+|[\\n ]+$', '', 'g')) AS h FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", md(S.clean_lines(F.col("body"))).alias("h"))


@query("str02_tags_to_space", f"WITH {NOTES} SELECT nid, md5(regexp_replace(regexp_replace(regexp_replace(body, '<[^<>]{{0,200}}>', ' ', 'g'), '{_sp}', ' ', 'g'), '^ | $', '', 'g')) AS h FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", md(S.tags_to_space(F.col("body"))).alias("h"))


@query("str04_match_title", f"WITH {NOTES} SELECT nid, lower(regexp_replace(title, '[^0-9A-Za-z\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS t FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", S.match_title(F.col("title")).alias("t"))


@query("str05_fingerprint", "SELECT supplier.s_suppkey, lower(regexp_replace(s_name, '[^\\p{L}\\p{N}]+', '', 'g')) AS f FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.fingerprint_text(F.col("s_name")).alias("f"))


@query("str06_hashes", f"WITH {NOTES} SELECT nid, md5(body) AS m, sha1(body) AS s1, sha256(body) AS s2, substr(sha256(body), 1, 16) AS short FROM notes")
def _(spark, d):
    b = F.col("body")
    return notes(spark, d).select("nid", F.md5(b).alias("m"), F.sha1(b).alias("s1"), F.sha2(b, 256).alias("s2"), S.short_id(b).alias("short"))


_host = "nullif(regexp_replace(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '')"


@query("str07_canonical_url", """WITH p AS (SELECT article_id, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 1)) AS sc, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 2)) AS ho, regexp_extract(url, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 3) AS pa, regexp_extract(url, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 4) AS qu, url FROM articles),
q AS (SELECT *, array_to_string(list_filter(string_split(qu, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','spm','from','share_token'], lower(string_split(x, '=')[1])) AND NOT starts_with(lower(x), 'utm_')), '&') AS kept FROM p)
SELECT article_id, CASE WHEN sc IN ('http', 'https') THEN sc || '://' || ho || regexp_replace(regexp_replace(pa, '/{2,}', '/', 'g'), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS u FROM q""")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", S.canonical_url(F.col("url")).alias("u"))


@query("str08_host", f"SELECT article_id, {_host} AS h FROM articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", S.host(F.col("url")).alias("h"))


@query("str09_source_name", f"SELECT article_id, coalesce(nullif(trim(source), ''), {_host}, 'corpus:' || substr(string_split(domain, '/')[1], 1, 24)) AS s FROM articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", S.source_name(F.col("source"), F.col("url"), F.col("domain")).alias("s"))


@query("str10_made_title", f"""WITH {NOTES}, f AS (SELECT nid, body, trim(regexp_extract(body, '^[^。！？!?\\n]*[。！？!?]?', 0)) AS s FROM notes) SELECT nid, substr(CASE WHEN length(s) < 6 THEN substr(body, 1, 80) ELSE s END, 1, 120) AS t FROM f""")
def _(spark, d):
    return notes(spark, d).select("nid", S.made_title(F.col("body")).alias("t"))


@query("str11_first_filled", "SELECT article_id, coalesce(nullif(trim(title), ''), nullif(trim(source), ''), nullif(trim(url), '')) AS v FROM articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", S.first_filled(F.col("title"), F.col("source"), F.col("url")).alias("v"))


@query("str12_record_key", "SELECT news_id, coalesce('id:' || nullif(trim(uuid), ''), 'url:' || nullif(trim(url), ''), 'td:' || nullif(trim(title), '') || '|' || publish_date, 'c:' || md5(coalesce(content, ''))) AS k FROM news")
def _(spark, d):
    return table(spark, d, "news").select("news_id", S.record_key(F.col("uuid"), F.col("url"), F.col("title"), F.col("publish_date"), F.col("content")).alias("k"))


@query("str13_prefixes", f"WITH {NOTES} SELECT nid, substr(title, 1, 24) AS t24, substr(title, 1, 40) AS t40 FROM notes")
def _(spark, d):
    return notes(spark, d).select("nid", F.substring("title", 1, 24).alias("t24"), F.substring("title", 1, 40).alias("t40"))


@query("str14_base64url", "SELECT article_id, url AS u FROM articles")
def _(spark, d):
    packed = F.regexp_replace(F.translate(F.base64(F.encode("url", "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    return table(spark, d, "articles").select("article_id", S.unwrap_base64url(packed).alias("u"))


# ------------------------------------------------------------------ dates

_ymd = r"try_strptime(concat(regexp_extract(substr({c}, 1, 24), '(\d{{4}})\D{{1,3}}(\d{{1,2}})\D{{1,3}}(\d{{1,2}})', 1), '-', lpad(regexp_extract(substr({c}, 1, 24), '(\d{{4}})\D{{1,3}}(\d{{1,2}})\D{{1,3}}(\d{{1,2}})', 2), 2, '0'), '-', lpad(regexp_extract(substr({c}, 1, 24), '(\d{{4}})\D{{1,3}}(\d{{1,2}})\D{{1,3}}(\d{{1,2}})', 3), 2, '0')), '%Y-%m-%d')::DATE"


@query("dt01_parse_ymd", f"SELECT article_id, CAST({_ymd.format(c='news_date')} AS VARCHAR) AS day FROM articles")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", D.parse_ymd(F.col("news_date")).cast("string").alias("day"))


@query("dt02_parse_any", f"""SELECT article_id, CAST(coalesce(CASE WHEN regexp_matches(trim(news_date), '^\\d{{9,13}}(\\.\\d+)?$') THEN CAST(make_timestamp(CAST(floor(CASE WHEN TRY_CAST(trim(news_date) AS DOUBLE) > 1e10 THEN TRY_CAST(trim(news_date) AS DOUBLE) / 1000 ELSE TRY_CAST(trim(news_date) AS DOUBLE) END) AS BIGINT) * 1000000) AS DATE) END, CASE WHEN regexp_matches(trim(news_date), '^\\d{{8}}$') THEN try_strptime(trim(news_date), '%Y%m%d')::DATE END, {_ymd.format(c='trim(news_date)')}) AS VARCHAR) AS day FROM articles""")
def _(spark, d):
    return table(spark, d, "articles").select("article_id", D.parse_any(F.col("news_date")).cast("string").alias("day"))


@query("dt03_parse_formats", "SELECT article_id, CAST(coalesce(try_strptime(news_date, '%Y-%m-%d %H:%M:%S'), try_strptime(news_date, '%Y.%m.%d %H:%M')) AS VARCHAR) AS ts FROM articles WHERE regexp_matches(news_date, '^\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d$|^\\d{4}\\.\\d\\d\\.\\d\\d \\d\\d:\\d\\d$')")
def _(spark, d):
    a = table(spark, d, "articles").filter(F.col("news_date").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$|^\d{4}\.\d\d\.\d\d \d\d:\d\d$"))
    return a.select("article_id", D.parse_formats(F.col("news_date"), ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm")).cast("string").alias("ts"))


@query("dt04_iso_week", f"WITH {NOTES} SELECT nid, CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS week FROM notes WHERE date IS NOT NULL")
def _(spark, d):
    return notes(spark, d).filter("date is not null").select("nid", D.iso_week(F.col("date")).alias("week"))


@query("dt05_calendar_keys", f"WITH {NOTES} SELECT nid, strftime(date, '%Y-%m') AS month, CAST(isodow(date) = 1 AS INT) AS mon, CAST(isodow(date) = 5 AS INT) AS fri, CAST(year(date) AS INT) AS year FROM notes WHERE date IS NOT NULL")
def _(spark, d):
    c = F.col("date")
    return notes(spark, d).filter("date is not null").select("nid", D.month_key(c).alias("month"), D.is_weekday(c, 0).alias("mon"), D.is_weekday(c, 4).alias("fri"), F.year(c).alias("year"))


@query("dt06_next_open_day", f"WITH {NOTES}, o AS (SELECT DISTINCT CAST(date AS DATE) AS day FROM panel_daily) SELECT CAST(x.date AS VARCHAR) AS day, CAST((SELECT min(day) FROM o WHERE o.day >= x.date) AS VARCHAR) AS open_day FROM (SELECT DISTINCT date FROM notes WHERE date IS NOT NULL) x")
def _(spark, d):
    o = table(spark, d, "panel_daily").select(F.col("date").cast("date").alias("day"))
    return D.next_open_day(notes(spark, d).filter("date is not null").select(F.col("date").alias("day")), o).select(F.col("day").cast("string").alias("day"), F.col("open_day").cast("string").alias("open_day"))


@query("dt07_positions", "SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day) AS tpos FROM (SELECT DISTINCT CAST(date AS DATE) AS day FROM panel_daily)")
def _(spark, d):
    return D.positions(table(spark, d, "panel_daily").select(F.col("date").cast("date").alias("day"))).select(F.col("day").cast("string").alias("day"), F.col("tpos").cast("bigint").alias("tpos"))


@query("dt08_windows", "SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS lo, CAST(least(CAST(m + INTERVAL 7 DAY AS DATE) - 1, DATE '2024-03-10') AS VARCHAR) AS hi FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-10', INTERVAL 7 DAY) t(m)")
def _(spark, d):
    return D.windows_between(spark, "2024-01-01", "2024-03-10", "7 days").select(F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("dt09_dense_spine", "SELECT event_type, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) USING (event_type, day)")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("day"))
    f = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    return D.dense(f, e, e, "event_type", "day", {"n": 0}).select("event_type", F.col("day").cast("string").alias("day"), "n")


# ------------------------------------------------------------------ numbers

r6 = lambda c: F.round(c, 6)


@query("mth01_signed_sqrt", "SELECT panel_id, round(sign(ar) * sqrt(abs(ar)), 6) AS v FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", r6(M.signed_sqrt(F.col("ar"))).alias("v"))


@query("mth02_clip", "SELECT panel_id, CASE WHEN ar IS NOT NULL THEN greatest(-1, least(1, ar)) END AS v FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", M.clip(F.col("ar"), -1, 1).alias("v"))


@query("mth03_balance", "SELECT o_orderkey, round((a - b) / (a + b + 1e-4), 6) AS v, round(CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END, 6) AS w FROM (SELECT l_orderkey AS o_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS b FROM lineitem GROUP BY 1)")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(n) for f, n in (("R", "a"), ("A", "b"))])
    return g.select("o_orderkey", r6(M.balance(F.col("a"), F.col("b"))).alias("v"), r6(M.balance_or_null(F.col("a"), F.col("b"))).alias("w"))


@query("mth04_density", "SELECT doc_id, round(least(1.0, 3 / (n_chars * 0.02 + 3)), 6) AS v FROM documents WHERE n_chars IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").filter("n_chars is not null").select("doc_id", r6(M.density(F.lit(3), F.col("n_chars"))).alias("v"))


@query("mth05_quantity", f"""WITH {NOTES}, x AS (SELECT nid, body, regexp_extract_all(body, '(\\d+(?:\\.\\d+)?)\\s*(million|亿|万)?', 1) AS n, regexp_extract_all(body, '(\\d+(?:\\.\\d+)?)\\s*(million|亿|万)?', 2) AS u FROM notes WHERE body IS NOT NULL),
y AS (SELECT nid, body, list_max(list_transform(list_zip(n, u), lambda z: CAST(z[1] AS DOUBLE) * CASE z[2] WHEN 'million' THEN 1e6 WHEN '亿' THEN 1e8 WHEN '万' THEN 1e4 ELSE 1 END)) AS m FROM x)
SELECT nid, round(log10(coalesce(m, 0) + 1) + CASE WHEN contains(body, 'record') THEN 0.5 ELSE 0 END + CASE WHEN contains(body, '大') THEN 0.5 ELSE 0 END, 6) AS v FROM y""")
def _(spark, d):
    return notes(spark, d).filter("body is not null").select("nid", r6(M.largest_quantity(F.col("body"), {"million": 1e6, "亿": 1e8, "万": 1e4}, ["record", "大"])).alias("v"))


@query("mth06_three_way", "SELECT panel_id, CASE WHEN ar > 0.3 THEN 1 WHEN ar < -0.3 THEN -1 ELSE 0 END AS v FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", M.three_way(F.col("ar"), 0.3).alias("v"))


@query("mth07_first_argmax", "SELECT panel_id, CASE WHEN greatest(coalesce(ar, 0), coalesce(mar, 0), coalesce(ret, 0)) <= 0 THEN -1 WHEN coalesce(ar, 0) >= coalesce(mar, 0) AND coalesce(ar, 0) >= coalesce(ret, 0) THEN 0 WHEN coalesce(mar, 0) >= coalesce(ret, 0) THEN 1 ELSE 2 END AS v FROM panel_daily")
def _(spark, d):
    z = [F.coalesce(c, F.lit(0.0)) for c in ("ar", "mar", "ret")]
    return table(spark, d, "panel_daily").select("panel_id", M.first_argmax(["a", "b", "c"], z).alias("v"))


@query("mth08_lexical_score", "SELECT panel_id, round(abs(GCS) * ln(1 + greatest(ar, 0)) * mar * UGCS_std, 6) AS v FROM panel_daily")
def _(spark, d):
    s = M.lexical_score(F.abs("GCS"), F.when(F.col("ar").isNotNull(), F.col("ar")), F.col("mar"), F.col("UGCS_std"))
    return table(spark, d, "panel_daily").select("panel_id", r6(s).alias("v"))


@query("mth09_confidence", "SELECT panel_id, round(0.5 * least(1, abs(ar)) + 0.5 * least(1, abs(mar)), 6) AS v FROM panel_daily WHERE ar IS NOT NULL AND mar IS NOT NULL")
def _(spark, d):
    c = lambda x: F.least(F.lit(1.0), F.abs(x))
    return table(spark, d, "panel_daily").filter("ar is not null and mar is not null").select("panel_id", r6(0.5 * c("ar") + 0.5 * c("mar")).alias("v"))


@query("mth10_composed_score", "SELECT panel_id, round(0.5 * ln(1 + abs(ar)) * (L_GPUExposure - L_CPUExposure) * (mar - ret) * (1 + 0.5 * (GCS - UGCS_std)), 6) AS v FROM panel_daily")
def _(spark, d):
    s = M.composed_score(F.lit(0.5), F.abs("ar"), F.col("L_GPUExposure"), F.col("L_CPUExposure"), F.col("mar"), F.col("ret"), F.col("GCS"), F.col("UGCS_std"))
    return table(spark, d, "panel_daily").select("panel_id", r6(s).alias("v"))


@query("mth11_one_sided", "SELECT panel_id, CASE WHEN ar IS NOT NULL THEN greatest(ar, 0) END AS pos, CASE WHEN ar IS NOT NULL THEN greatest(-ar, 0) END AS neg FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", M.clip(F.col("ar"), lo=0).alias("pos"), M.clip(-F.col("ar"), lo=0).alias("neg"))


@query("mth12_softmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, round(CAST(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))) AS DOUBLE), 6) AS p FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", M.argmax(F.col("e")).alias("best"), r6(F.array_max(M.softmax(F.col("e")))).alias("p"))


@query("mth13_terms", "SELECT panel_id, round(L_GPUExposure * GCS, 10) AS inter, round(ar * ar, 10) AS sq, CAST(category = 'G1' AS INT) AS d1 FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", F.round(F.col("L_GPUExposure") * F.col("GCS"), 10).alias("inter"), F.round(F.col("ar") * F.col("ar"), 10).alias("sq"), (F.col("category") == "G1").cast("int").alias("d1"))


@query("mth14_logs", "SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS l, round(ln(1 + abs(s_acctbal)), 6) AS l1 FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", r6(M.safe_ln(F.col("s_acctbal"))).alias("l"), r6(F.log1p(F.abs("s_acctbal"))).alias("l1"))


@query("mth15_basis_points", "SELECT panel_id, round(ret * 10000, 2) AS bp FROM panel_daily")
def _(spark, d):
    return table(spark, d, "panel_daily").select("panel_id", F.round(F.col("ret") * 10000, 2).alias("bp"))


@query("mth16_standard_error", "SELECT panel_id, round(abs(ar) / abs(mar), 6) AS se, round(ar - 1.96 * abs(ar) / abs(mar), 6) AS lo, round(ar + 1.96 * abs(ar) / abs(mar), 6) AS hi FROM panel_daily WHERE mar <> 0")
def _(spark, d):
    se = M.standard_error(F.col("ar"), F.col("mar"))
    return table(spark, d, "panel_daily").filter("mar <> 0").select("panel_id", r6(se).alias("se"), r6(F.col("ar") - 1.96 * se).alias("lo"), r6(F.col("ar") + 1.96 * se).alias("hi"))


# ------------------------------------------------------------------ pages


def _pages(spark, d):
    """Articles as pages whose title, day, JSON-LD and links stand in another place from row to row."""
    a = table(spark, d, "articles")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[<>&'\"\\\\]", " ")
    k, day = F.pmod("article_id", F.lit(4)), F.date_format("retrieved_at", "yyyy-MM-dd")
    title = clean(F.col("title"))
    pick = lambda *cs: F.when(k == 0, cs[0]).when(k == 1, cs[1]).when(k == 2, cs[2]).otherwise(cs[3])
    cat, none = F.concat, F.lit("")
    head = pick(cat(F.lit("<meta property='og:title' content='"), title, F.lit("'>")), cat(F.lit("<meta name='twitter:title' content='"), title, F.lit("'>")), none, none)
    head_day = pick(cat(F.lit("<meta property='article:published_time' content='"), day, F.lit("T01:02:03Z'>")), none, none, none)
    ld = cat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"h'), F.col("article_id").cast("string"), F.lit('"'), pick(none, cat(F.lit(',"datePublished":"'), day, F.lit('T01:00:00Z"')), none, none), F.lit(',"publisher":{"name":"'), clean(F.col("source")), F.lit('"}}]}</script>'))
    top = pick(none, none, cat(F.lit("<h1>"), title, F.lit("</h1>")), none)
    when = pick(none, none, cat(F.lit("<time datetime='"), day, F.lit("'></time>")), none)
    body = F.regexp_replace(F.coalesce("content", F.lit("")), "[<>&]", " ")
    paras = F.array_join(F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    link = cat(F.lit("<nav><a href='/n/"), F.pmod("article_id", F.lit(7)).cast("string"), F.lit("'>n</a><a href='https://other.example/"), F.col("language"), F.lit("'>o</a></nav>"))
    html = cat(F.lit("<html><head><title>"), title, F.lit("</title>"), head, head_day, F.lit("<script>var a='</p>';</script>"), ld, F.lit("</head><body>"), link, top, when, F.lit("<article>"), paras, F.lit("</article><footer>f</footer></body></html>"))
    host = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    url = F.concat(host, pick(none, none, none, cat(F.lit("/"), F.date_format("retrieved_at", "yyyy/MM/dd"))), F.lit("/p#"), F.col("article_id").cast("string"))
    return a.select("article_id", url.alias("url"), html.alias("html"), "title", "content")


PAGE_URL = "regexp_extract(url, '^([a-z]+://[^/]+)', 1) || CASE WHEN article_id % 4 = 3 THEN strftime(retrieved_at, '/%Y/%m/%d') ELSE '' END || '/p#' || CAST(article_id AS VARCHAR)"


@query("htm01_page_title", f"SELECT {PAGE_URL} AS url, nullif(trim(regexp_replace(regexp_replace(coalesce(title, ''), '[<>&''\"\\\\]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS title FROM articles")
def _(spark, d):
    return H.pages(_pages(spark, d), "url", "html").select("url", F.nullif(F.trim(F.regexp_replace("title", r"[\s\p{Z}]+", " ")), F.lit("")).alias("title"))


@query("htm02_page_day", f"SELECT {PAGE_URL} AS url, strftime(retrieved_at, '%Y-%m-%d') AS day FROM articles")
def _(spark, d):
    return H.pages(_pages(spark, d), "url", "html").select("url", "day")


@query("htm03_json_ld", f"SELECT {PAGE_URL} AS url, 'h' || article_id AS headline, regexp_replace(coalesce(source, ''), '[<>&''\"\\\\]', ' ', 'g') AS publisher FROM articles")
def _(spark, d):
    return H.pages(_pages(spark, d), "url", "html").select("url", "headline", "publisher")


@query("htm04_page_body")
def _(spark, d):
    return H.pages(_pages(spark, d), "url", "html").select("url", F.length("body").alias("n"))


@query("htm05_links", "SELECT regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/n/' || (article_id % 7) AS link, count(*) AS n FROM articles GROUP BY 1 UNION ALL SELECT 'https://other.example/' || language, count(*) FROM articles GROUP BY 1")
def _(spark, d):
    return H.links(_pages(spark, d), "url", "html").groupBy("link").agg(F.count(F.lit(1)).alias("n"))
