"""Sources, sinks, deduplication, inference and streams on small inputs."""

import math
import random
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heddle.functions import html as H
from heddle.functions import strings as S
from heddle.operators import dedup, econ, evaluate, frames
from heddle.sources import readers, sinks
from heddle.streaming import streams


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr).collect()[0][0]


# ------------------------------------------------------------------ sources and sinks


def test_json_lines_keep_broken_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2,\n\n{"k": 3}\n', encoding="utf-8")
    df = readers.json_lines(spark, str(tmp_path), "k int, v string", recursive=True, pattern="*.jsonl")
    assert sorted(r["k"] for r in readers.good_lines(df).collect()) == [1, 3]
    assert [r[readers.CORRUPT] for r in readers.bad_lines(df).collect()] == ['{"k": 2,']


def test_numbered_lines(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("\n".join(f"line {i}" for i in range(1, 501)), encoding="utf-8")
    got = readers.numbered_lines(spark, str(p)).collect()
    assert sorted((r["line_no"], r["value"]) for r in got) == [(i, f"line {i}") for i in range(1, 501)]


def test_csv_drops_the_byte_order_mark(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿date,n\n2024-01-02,3\nx,--\n", encoding="utf-8")
    rows = readers.csv(spark, str(p), "date date, n int").collect()
    assert [(str(r["date"]), r["n"]) for r in rows] == [("2024-01-02", 3), ("None", None)]


def test_insert_new_and_stage(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    sinks.insert_new(a, path, ["k"])
    sinks.insert_new(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    calls = []
    build = lambda: calls.append(1) or a
    for _ in range(2):
        sinks.stage(spark, build, str(tmp_path), "s", "input-1")
    assert len(calls) == 1
    up = sinks.upsert(spark.createDataFrame([(2, "new"), (9, "i")], "k int, v string"), a, ["k"])
    assert sorted((r["k"], r["v"]) for r in up.collect()) == [(1, "a"), (1, "b"), (2, "new"), (9, "i")]


def test_split_complete_and_report(spark, tmp_path):
    df = spark.createDataFrame([("t", None), ("t", "c"), (" ", "c")], "title string, content string")
    assert sinks.report(df, str(tmp_path / "stage"), n=F.count(F.lit(1)), empty=F.count_if(F.col("content").isNull())) == {"n": 3, "empty": 1}
    sinks.split_complete(df, str(tmp_path / "out"), ["title", "content"])
    assert spark.read.parquet(str(tmp_path / "out")).filter("is_complete = 'true'").count() == 1


def test_existing(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    assert readers.existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == ([str(tmp_path / "a")], [str(tmp_path / "b")])


# ------------------------------------------------------------------ strings and pages


def test_canonical_url(spark):
    c = lambda u: one(spark, S.canonical_url(F.col("u")), u=u)
    assert c("HTTPS://News.X.example//a//b/?utm_source=q&id=3&spm=1#top") == "https://news.x.example/a/b?id=3"
    assert c("ftp://x/y") is None


def test_clean_text(spark):
    assert one(spark, S.clean_text(F.col("t")), t=" a　 b<br/>​c\x07 ") == "a bc"
    assert one(spark, S.clean_lines(F.col("t")), t="a \r\n\r\n\r\n\r\n b\t\tc\n") == "a\n\nb c"


PAGE = """<html><head><title>T</title><meta property="og:title" content="OG"><script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"LD","datePublished":"2024-03-04"}]}</script></head>
<body><nav><p>menu menu menu menu menu</p></nav><div class="post-content"><h1>H</h1><p>A long enough paragraph stands here.</p><p>And one more of them stands here, too.</p></div><a href="/x">X</a><footer><p>foot</p></footer></body></html>"""


def test_page():
    p = H.Page(PAGE, "https://e.example/a/")
    assert H.title_of(p) == "OG" and H.date_of(p, "") == "2024-03-04" and p.links == [("https://e.example/x", "X")]
    assert "menu" not in H.content_of(p, 20) and "long enough" in H.content_of(p, 20)
    assert H.title_of(H.Page("<h1>only</h1><p>x")) == "only" and H.content_of(H.Page("")) == "" and H.date_of(H.Page(""), "https://e/2024/0102/x") == "2024-01-02"


# ------------------------------------------------------------------ deduplication


def test_greedy_is_no_cascade(spark):
    rows = [(1, "a", "u1"), (2, "b", "u1"), (3, "b", "u2"), (4, None, None), (5, None, None)]
    got = dedup.greedy_keys(spark.createDataFrame(rows, "id int, k string, u string"), "id", ["k", "u"])
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_against_one_pass(spark, seed):
    rng = random.Random(seed)
    rows = pd.DataFrame({"id": range(60), "a": [rng.choice("abcdefgh") if rng.random() < 0.8 else None for _ in range(60)], "b": [rng.choice("stuvwxyz") for _ in range(60)]})
    got = sorted(r["id"] for r in dedup.greedy_keys(spark.createDataFrame(rows), "id", ["a", "b"]).select("id").collect())
    assert got == dedup.greedy_reference(rows, "id", ["a", "b"])


# ------------------------------------------------------------------ inference


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 8), st.integers(3, 200))
def test_t_tail(t, df):
    x = np.linspace(t, t + 400, 400001)
    f = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    assert abs(econ.t_two_sided(t, df) - 2 * np.trapezoid(f, x)) < 1e-5


def test_panel_fit_against_dummies(spark):
    rng = np.random.default_rng(2)
    n, d = 12, 15
    rows = [(f"f{i}", t) for i in range(n) for t in range(d) if rng.random() < 0.9]
    fe, de = rng.normal(size=n), rng.normal(size=d)
    x = rng.normal(size=(len(rows), 2))
    y = np.array([fe[int(f[1:])] + de[t] for f, t in rows]) + x @ [0.5, -1.0] + rng.normal(size=len(rows))
    df = spark.createDataFrame([(f, t, float(a), float(b), float(c)) for (f, t), (a, b), c in zip(rows, x, y)], "firm string, day int, a double, b double, y double")
    fit = econ.panel_fit(df, "y", ["a", "b"], "firm", "day", sweeps=30)
    m = np.column_stack([x, *[[float(f == f"f{i}") for f, _ in rows] for i in range(n)], *[[float(t == k) for _, t in rows] for k in range(1, d)]])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    assert np.allclose(fit["coef"], b[:2], atol=1e-6)
    # clustered covariance by hand on the residualised regressors
    z = m[:, 2:]
    xr = x - z @ np.linalg.lstsq(z, x, rcond=None)[0]
    e = y - m @ b
    inv = np.linalg.inv(xr.T @ xr)
    s = xr * e[:, None]
    outer = lambda g: sum(np.outer(v, v) for v in pd.DataFrame(s).groupby(g).sum().to_numpy())
    big, k = len(rows), 2
    dof = big - k - (n + d - 1)
    v = inv @ (n / (n - 1) * (big - 1) / dof * outer([f for f, _ in rows]) + d / (d - 1) * (big - 1) / dof * outer([t for _, t in rows]) - (big - 1) / dof * s.T @ s) @ inv
    if (np.diag(v) > 0).all():
        assert np.allclose(fit["se"], np.sqrt(np.diag(v)), rtol=1e-4)
    assert fit["n"] == big and 0 < fit["within_r2"] < 1


def test_arx_against_window_functions(spark):
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=80)).tolist()
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, t int, y double")
    a = {r["t"]: r["innovation"] for r in econ.arx(df, "k", "t", "y", [], 1, 20, 10).collect()}
    b = {r["t"]: r["innovation"] for r in econ.ar1(df, "k", "t", "y", 20, 10).collect()}
    for t in range(25, 80):
        assert abs(a[t] - b[t]) < 1e-6


def test_placebo_has_no_effect_on_noise(spark):
    rng = np.random.default_rng(8)
    rows = [(i, t, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(20) for t in range(40)]
    p = spark.createDataFrame(rows, "firm int, day int, y double, g double, c double")
    cal = spark.createDataFrame([(t, float(rng.normal())) for t in range(40)], "day int, u double")
    out = econ.placebo(p, "y", "g", "c", "day", cal, "u", 50, 3).toPandas()
    assert len(out) == 51 and abs(out[out.rep >= 0].delta.mean()) < 0.1


def test_lagged_z_matches_pandas(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=50)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t int, x double")
    got = [r[0] for r in df.orderBy("t").select(frames.lagged_z(F.col("x"), ["k"], ["t"], 10, 4)).collect()]
    s = pd.Series(v)
    want = ((s - s.shift(1).rolling(10, min_periods=4).mean()) / s.shift(1).rolling(10, min_periods=4).std()).clip(-6, 6)
    assert all((g is None and math.isnan(w)) or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_macro_f1_and_auroc(spark):
    df = spark.createDataFrame([(i % 2, int(i % 2 == 0 or i % 5 == 0), float(i % 7)) for i in range(100)] + [(-1, 0, 0.0)], "y int, g int, s double")
    r = evaluate.macro_f1(evaluate.confusion(df, "y", "g")).collect()[0]
    assert r["n"] == 100 and 0 <= r["macro_f1"] <= 1
    a = evaluate.auroc(df, "y", "s").collect()[0][0]
    p = [float(i % 7) for i in range(100) if i % 2]
    q = [float(i % 7) for i in range(100) if not i % 2]
    assert abs(a - sum((x > z) + (x == z) / 2 for x in p for z in q) / len(p) / len(q)) < 1e-9


def test_average_linkage():
    c = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    m = econ.average_linkage(c)
    assert m[0][:2] == (0, 1) and abs(m[1][2] - 0.85) < 1e-9


# ------------------------------------------------------------------ streams


def test_running_rank_goes_on_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, i long").coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", 4)], "k string, i long").coalesce(1).write.mode("append").parquet(src)
    s = streams.running_rank(streams.parquet_stream(spark, src, files_per_batch=1), "k", "i")
    streams.run_available(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert sorted(got[got.k == "a"]["rank"]) == [1, 2, 3] and sorted(got[got.k == "b"]["rank"]) == [1]
    assert np.allclose(got.weight, 1 / got["rank"])


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, f"2024-01-0{1 + i % 5} 0{i % 10}:00:00", i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, ts string, u int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(src)
    s = streams.tumbling(streams.parquet_stream(spark, src), "ts", ["u"], "1 day", "5 days", n=F.count(F.lit(1)))
    q = s.writeStream.format("memory").queryName("t_buckets").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    want = df.groupBy(F.window("ts", "1 day").start.alias("bucket"), "u").agg(F.count(F.lit(1)).alias("n"))
    key = lambda d: sorted((str(r["bucket"]), r["u"], r["n"]) for r in d.collect())
    assert key(spark.table("t_buckets")) == key(want)


# ------------------------------------------------------------------ package


def test_the_rest_does_not_need_the_text_subpackage():
    code = "import sys; sys.modules['heddle.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and 'p4_found' in q and 'p1_found' not in q"
    from tests_root import ROOT

    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_both_ways_of_demeaning_agree(spark):
    import random

    from heddle.operators import econ

    rng = random.Random(3)
    rows = [(f"f{i}", t, rng.random(), rng.random() * t) for i in range(7) for t in range(12) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "firm string, day int, x double, y double")
    a, b = (sorted((r["firm"], r["day"], round(r["x"], 9), round(r["y"], 9)) for r in econ.within(df, ["x", "y"], "firm", "day", 4, pairs=n).collect()) for n in (1000, 0))
    assert a == b and len(a) == len(rows)


def test_a_thin_panel_is_not_fitted(spark):
    from heddle.operators import econ

    df = spark.createDataFrame([(f"f{i % 3}", i, float(i % 5), float(i % 7)) for i in range(40)], "firm string, day int, y double, x double")
    assert econ.panel_fit(df, "y", ["x"], "firm", "day", least=200) is None and econ.fits([("a", df, "y", ["x"])], "firm", "day") == [] and econ.fits([], "firm", "day") == []


def test_effects_never_reach_the_driver(spark, monkeypatch):
    from heddle.operators import econ
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refused(self, *a, **k):
        raise AssertionError("rows of groups on the driver")

    rows = [(f"f{i % 7}" if i % 7 else None, i % 5, i % 11 * 0.5, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "firm string, day int, x double, y double")
    ways = []
    with monkeypatch.context() as m:
        m.setattr(Classic, "toPandas", refused)
        m.setattr(Classic, "collect", refused)
        for pairs in (1000, 40, 0):  # rows in one task, sums by pair in one task, aggregates
            ways.append(econ.within(df, ["x", "y"], "firm", "day", 4, pairs=pairs))
    got = [sorted((r["firm"] or "", r["day"], round(r["x"], 9), round(r["y"], 9)) for r in w.collect()) for w in ways]
    assert len(got[0]) == 60 and got[0] == got[1] == got[2]


def test_tfidf_moves_texts_once(spark):
    import math
    from collections import Counter

    from heddle.operators import text as T

    docs = [(1, "a b a c"), (2, "a d"), (2, "d e"), (3, None), (4, "b a. f"), (None, "a g")]
    df = spark.createDataFrame(docs, "id long, body string")
    n = spark.createDataFrame([(6,)], "n long")
    words = {}
    for i, b in docs:
        words.setdefault(i, Counter()).update((b or "").replace(".", "").split())
    df_of = Counter(w for c in words.values() for w in c)
    want = {}
    for i, c in words.items():
        w = {t: k * (math.log(7 / (1 + df_of[t])) + 1) for t, k in c.items()}
        want |= {(i, t): round(v / math.sqrt(sum(x * x for x in w.values())), 9) for t, v in w.items()}
    for most in (T.COMMON, 0):  # sent to every worker, or met by token
        got = T.tfidf(df, "id", "body", n, most)
        assert {(r["id"], r["token"]): round(r["weight"], 9) for r in got.collect()} == want
    plan = T.tfidf(df, "id", "body", n)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # by id, not by token


def test_a_battery_has_few_jobs_and_its_fits_are_those_of_panel_fit(spark):
    rng = random.Random(7)
    rows = [(f"f{i % 13}" if i % 50 else None, i % 31 if i % 47 else None, rng.random(), rng.random() if i % 9 else None, rng.gauss(0, 1) if i % 7 else float("nan")) for i in range(900)]
    df = spark.createDataFrame(rows, "firm string, day int, y double, x double, z double").cache()
    specs = [(f"s{k}", df, "y", ["x", "z"] if k % 2 else ["z"]) for k in range(6)] + [("thin", df.limit(150), "y", ["x"])]
    spark.sparkContext.setJobGroup("battery", "")
    got = econ.fits(specs, "firm", "day")
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("battery")) <= 3 * len(specs)  # twelve or more a spec before
    spread = econ.fits(specs, "firm", "day", held=0)
    assert [n for n, _ in got] == [n for n, _ in spread] == [f"s{k}" for k in range(6)]
    for (_, a), (_, b), s in zip(got, spread, specs):
        c = econ.panel_fit(df, "y", s[3], "firm", "day", corrected=False)
        for k in ("coef", "se", "p", "n", "n_firm", "n_day", "within_r2", "v"):
            assert np.allclose(a[k], b[k], rtol=1e-9) and np.allclose(a[k], c[k], rtol=1e-9), k


def test_sixteen_outcomes_run_a_job_each(spark, sf):
    from heddle import core_queries as C

    spark.sparkContext.setJobGroup("outcomes", "")
    C.QUERIES["eco19_outcome_battery"](spark, sf)
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("outcomes")) <= 40  # six and more a fit before


def test_fits_of_a_battery_share_a_job_and_the_reading_of_their_rows(spark):
    rng = random.Random(11)
    rows = [(f"f{i % 17}", i % 29 if i % 40 else None, *(rng.gauss(0, 1) if i % (5 + k) else None for k in range(10)), rng.random(), rng.random() if i % 6 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "firm string, day int, " + ", ".join(f"y{k} double" for k in range(10)) + ", x double, z double")
    specs = [(f"s{k}{len(xs)}", df, f"y{k}", xs) for k in range(10) for xs in (["x"], ["x", "z"])]  # more than a task makes, of rows that differ
    spark.sparkContext.setJobGroup("shared", "")
    got = econ.fits(specs, "firm", "day")
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("shared")) <= 6  # one more a fit before
    assert [n for n, _ in got] == [s[0] for s in specs]
    for i in (0, 7, 19):
        want = econ.panel_fit(df, *specs[i][2:], "firm", "day", corrected=False)
        for k in ("coef", "se", "n", "n_firm", "n_day", "within_r2", "v"):
            assert np.allclose(got[i][1][k], want[k], rtol=1e-9), (i, k)
    assert [r["var"] for r in econ.result_rows(spark, got[1:2], {"s02": ["z"]}).collect()] == ["z"]
