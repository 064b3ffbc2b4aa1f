"""Panel regressions in Spark, and the same from sums and unrolled sweeps in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import econ as E
from ..operators import frames as R
from .bindings import PANEL, panel, table
from .registry import query

XS = ["gx", "cx"]
CONTROLS = ["L_turnover_w", "L_size_w"]
HORIZONS = [0, 1, 3, 5, 10, 20]
SWEEPS = 12

# ------------------------------------------------------------------ SQL


def fit_sql(p: str, sample: str, y: str, pair: list[str], others: list[str] = (), sweeps: int = SWEEPS, cluster: bool = True) -> str:
    """CTEs that end in {p}_f: one row with coefficients b1, b2 of a pair of regressors beside others, their errors, and what tests need.

    Sweeps of means by firm and day; the others are projected out in turn, which leaves the pair's coefficients, residuals
    and clustered errors as in the whole regression.
    """
    names = ["y", "a", "b", *[f"o{i}" for i in range(len(others))]]
    cols = dict(zip(names, [y, *pair, *others]))
    out = [f"{p}_0 AS (SELECT firm, day, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for n, c in cols.items())} FROM {sample} WHERE firm IS NOT NULL AND day IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in cols.values())})"]
    last = f"{p}_0"
    for k in range(2 * sweeps):
        by = ("firm", "day")[k % 2]
        out.append(f"{p}_{k + 1} AS (SELECT firm, day, {', '.join(f'{n} - avg({n}) OVER w AS {n}' for n in names)} FROM {last} WINDOW w AS (PARTITION BY {by}))")
        last = f"{p}_{k + 1}"
    out.append(f"{p}_w AS MATERIALIZED (SELECT * FROM {last})")
    last = f"{p}_w"
    for k in range(len(others)):
        left = [n for n in names if n not in [f"o{i}" for i in range(k + 1)]]
        out.append(f"{p}_r{k} AS MATERIALIZED (SELECT firm, day, {', '.join(f'{n} - o{k} * (sum({n} * o{k}) OVER () / sum(o{k} * o{k}) OVER ()) AS {n}' for n in left)} FROM {last})")
        last = f"{p}_r{k}"
    size = 2 + len(others)
    out += [
        f"{p}_m AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM {last})",
        f"{p}_c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM {p}_m)",
        f"{p}_e AS MATERIALIZED (SELECT firm, day, e, e * a AS s1, e * b AS s2 FROM (SELECT firm, day, a, b, y - b1 * a - b2 * b AS e FROM {last}, {p}_c))",
    ]
    meat = lambda rows: f"SELECT count(*) AS g, sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM {rows}"
    group = lambda by: f"(SELECT sum(s1) AS s1, sum(s2) AS s2 FROM {p}_e GROUP BY {by})"
    if cluster:
        out += [f"{p}_mf AS ({meat(group('firm'))})", f"{p}_md AS ({meat(group('day'))})", f"{p}_mi AS ({meat(group('firm, day'))})"]
        out.append(f"{p}_q AS (SELECT c.*, (n - 1) / greatest(n - {size} - f.g - d.g + 1, 1)::DOUBLE AS adj, f.m11 + d.m11 - i.m11 AS m11, f.m12 + d.m12 - i.m12 AS m12, f.m22 + d.m22 - i.m22 AS m22, f.m11 AS f11, f.m12 AS f12, f.m22 AS f22 FROM {p}_c c, {p}_mf f, {p}_md d, {p}_mi i)")
        var = lambda m: f"adj * (bb * bb * {m}11 - 2 * bb * ab * {m}12 + ab * ab * {m}22) / (det * det) AS {m}v1, adj * (ab * ab * {m}11 - 2 * aa * ab * {m}12 + aa * aa * {m}22) / (det * det) AS {m}v2, adj * (-bb * ab * {m}11 + (aa * bb + ab * ab) * {m}12 - aa * ab * {m}22) / (det * det) AS {m}v12"
        out.append(f"{p}_v AS (SELECT n, b1, b2, CASE WHEN mv1 < 0 OR mv2 < 0 THEN fv1 ELSE mv1 END AS v1, CASE WHEN mv1 < 0 OR mv2 < 0 THEN fv2 ELSE mv2 END AS v2, CASE WHEN mv1 < 0 OR mv2 < 0 THEN fv12 ELSE mv12 END AS v12 FROM (SELECT *, {var('m')}, {var('f')} FROM {p}_q))")
    else:
        out.append(f"{p}_v AS (SELECT n, b1, b2, s2 * bb / det AS v1, s2 * aa / det AS v2, -s2 * ab / det AS v12 FROM (SELECT c.*, (SELECT sum(e * e) FROM {p}_e) / (n - {size}) AS s2 FROM {p}_c c))")
    out.append(f"{p}_f AS (SELECT n, b1, b2, sqrt(v1) AS se1, sqrt(v2) AS se2, (b1 - b2) * (b1 - b2) / (v1 + v2 - 2 * v12) AS chi2, 1 - (SELECT sum(e * e) FROM {p}_e) / (SELECT sum(y * y) FROM {p}_w) AS r2 FROM {p}_v WHERE n >= {E.GUARD})")
    return ", ".join(out)


def battery_sql(head: str, specs: list[tuple[str, str, str, list[str], list[str]]]) -> str:
    """(spec, var, coef, se, n) of all specs (name, sample, outcome, pair, others)."""
    parts = [fit_sql(f"f{k}", sample, y, pair, others) for k, (_, sample, y, pair, others) in enumerate(specs)]
    rows = [f"SELECT '{s[0]}' AS spec, '{v}' AS var, round(b{i}, 7) AS coef, round(se{i}, 7) AS se, n FROM f{k}_f" for k, s in enumerate(specs) for i, v in enumerate(s[3], 1)]
    return f"WITH {head}, {', '.join(parts)} " + " UNION ALL ".join(rows)


def carried(y: str, h: int) -> str:
    """The sum of the next h rows of a firm, as frames.forward_sum defines it."""
    if h == 0:
        return y
    f = f"OVER (PARTITION BY firm ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count({y}) {f} >= {max(1, h // 2)} AND row_number() OVER (PARTITION BY firm ORDER BY day) + {h - 1} <= count(*) OVER (PARTITION BY firm) THEN sum({y}) {f} END"


OUTCOMES = ", ".join(f"{carried(y, h)} AS {y}_h{h}" for y in ("ar", "mar") for h in HORIZONS)
REG = f"{PANEL}, reg0 AS (SELECT firm, date AS day, ar, mar, ret, category, UGCS_std AS u, L_GPUExposure AS g, L_CPUExposure AS c, L_GPUExposure * UGCS_std AS gx, L_CPUExposure * UGCS_std AS cx, L_turnover_w, L_size_w FROM panel), reg AS MATERIALIZED (SELECT *, {OUTCOMES} FROM reg0)"

# ------------------------------------------------------------------ Spark


def _reg(spark, d):
    p = panel(spark, d)
    return p.select("firm", F.col("date").alias("day"), "ar", "mar", "ret", "category", F.col("UGCS_std").alias("u"), F.col("L_GPUExposure").alias("g"), F.col("L_CPUExposure").alias("c"), (F.col("L_GPUExposure") * F.col("UGCS_std")).alias("gx"), (F.col("L_CPUExposure") * F.col("UGCS_std")).alias("cx"), *CONTROLS)


def _horizons(r, hs=HORIZONS, ys=("ar", "mar")):
    return r.withColumns({f"{y}_h{h}": R.forward_sum(F.col(y), ["firm"], ["day"], h) if h else F.col(y) for y in ys for h in hs})


def _rows(spark, specs):
    """(spec, var, coef, se, n) of the pair of each spec (name, rows, outcome, pair, others)."""
    got = E.fits([(n, x, y, [*pair, *others]) for n, x, y, pair, others in specs], "firm", "day")
    return E.result_rows(spark, got, {s[0]: s[3] for s in specs}).select("spec", "var", F.round("coef", 7).alias("coef"), F.round("se", 7).alias("se"), "n")


def _battery(name, head, specs):
    """Registers a battery: specs(spark, d) and its SQL specs (name, sample, outcome, pair, others) in the same order."""
    sql = battery_sql(head, [s[:1] + s[2:] for s in specs])

    def register(rows):
        query(name, sql)(lambda spark, d: _rows(spark, [(s[0], x, *s[3:]) for s, x in zip(specs, rows(spark, d))]))
        return rows

    return register


@query("eco04_within", f"WITH {PANEL}, w0 AS (SELECT panel_id, firm, date, L_turnover_w AS x FROM panel WHERE L_turnover_w IS NOT NULL), " + ", ".join(f"w{k + 1} AS (SELECT panel_id, firm, date, x - avg(x) OVER (PARTITION BY {('firm', 'date')[k % 2]}) AS x FROM w{k})" for k in range(2 * SWEEPS)) + f" SELECT panel_id, round(x, 6) AS x FROM w{2 * SWEEPS}")
def _(spark, d):
    p = panel(spark, d).filter("L_turnover_w is not null").select("panel_id", "firm", "date", F.col("L_turnover_w").alias("x"))
    return E.within(p, ["x"], "firm", "date", SWEEPS).select("panel_id", F.round("x", 6).alias("x"))


ONE = fit_sql("f", "reg", "ar", XS)


def _pair(cols: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS var, {cols.format(i=i)} FROM f_f" for i, v in enumerate(XS, 1))


def _one(spark, d, y="ar", cluster=True):
    fit = E.panel_fit(_reg(spark, d), y, XS, "firm", "day", cluster=cluster, least=E.GUARD, corrected=False)
    return E.result_rows(spark, [("one", fit)] if fit else []), fit


@query("eco06_two_way_clusters", f"WITH {REG}, {ONE} " + _pair("round(b{i}, 7) AS coef, round(se{i}, 7) AS se, n"))
def _(spark, d):
    return _one(spark, d)[0].select("var", F.round("coef", 7).alias("coef"), F.round("se", 7).alias("se"), "n")


@query("eco07_plain_errors", f"WITH {REG}, {fit_sql('f', 'reg', 'ar', XS, cluster=False)} " + _pair("round(b{i}, 7) AS coef, round(se{i}, 7) AS se, n"))
def _(spark, d):
    return _one(spark, d, cluster=False)[0].select("var", F.round("coef", 7).alias("coef"), F.round("se", 7).alias("se"), "n")


@query("eco08_tests", f"WITH {REG}, {fit_sql('f', 'reg', 'mar', XS)} " + _pair("round(b{i} / se{i}, 4) AS t, round(b{i} - 1.96 * se{i}, 7) AS lo, round(b{i} + 1.96 * se{i}, 7) AS hi, round(r2, 6) AS within_r2"))
def _(spark, d):
    return _one(spark, d, "mar")[0].select("var", F.round("t", 4).alias("t"), F.round("lo", 7).alias("lo"), F.round("hi", 7).alias("hi"), F.round("within_r2", 6).alias("within_r2"))


@query("eco08_p_values")
def _(spark, d):
    return _one(spark, d, "mar")[0].select("var", "p")


@query("eco09_wald", f"WITH {REG}, {ONE} SELECT round(chi2, 5) AS chi2 FROM f_f")
def _(spark, d):
    fit = _one(spark, d)[1]
    return spark.createDataFrame([(round(float(E.wald_equal(fit, *XS)[0]), 5),)] if fit else [], "chi2 double")


@_battery("eco10_horizons", REG, [(f"{y}_h{h}", None, "reg", f"{y}_h{h}", XS, CONTROLS) for h in HORIZONS for y in ("ar", "mar")])
def _(spark, d):
    return [_horizons(_reg(spark, d))] * (2 * len(HORIZONS))


EXTREME = [(f"{t}_h{h}", None, "high", f"ar_h{h}", [f"g{t}", f"c{t}"], [*XS, *CONTROLS]) for t in ("top10", "top05") for h in (1, 5, 10, 20)] + [(f"square_h{h}", None, "high", f"ar_h{h}", ["gsquare", "csquare"], [*XS, *CONTROLS]) for h in (1, 5, 10)]


@_battery("eco11_extremes", f"{REG}, cuts AS (SELECT quantile_cont(u, 0.9) AS q10, quantile_cont(u, 0.95) AS q05 FROM (SELECT DISTINCT day, u FROM reg)), high AS MATERIALIZED (SELECT reg.*, " + ", ".join(f"{x}x * CAST(coalesce(u >= q{t}, false) AS INT) AS {x}top{t}" for t in ("10", "05") for x in "gc") + ", greatest(u, 0) * greatest(u, 0) * g AS gsquare, greatest(u, 0) * greatest(u, 0) * c AS csquare FROM reg, cuts)", EXTREME)
def _(spark, d):
    r = _horizons(_reg(spark, d), (1, 5, 10, 20), ("ar",))
    cuts = r.select("day", "u").distinct().agg(F.percentile("u", F.lit(0.9)).alias("q10"), F.percentile("u", F.lit(0.95)).alias("q05"))
    up = F.when(F.col("u").isNotNull(), F.greatest("u", F.lit(0.0)))
    x = r.join(F.broadcast(cuts)).withColumns({f"{k}top{t}": F.col(f"{k}x") * F.coalesce(F.col("u") >= F.col(f"q{t}"), F.lit(False)).cast("int") for t in ("10", "05") for k in "gc"} | {f"{k}square": up * up * F.col(k) for k in "gc"})
    return [x] * len(EXTREME)


SLICES = [0.5, 0.75, 0.9, 0.95]


@_battery("eco12_upper_tail", f"{REG}, " + ", ".join(f"tail{k} AS MATERIALIZED (SELECT * FROM reg WHERE u >= (SELECT quantile_cont(u, {q}) FROM reg))" for k, q in enumerate(SLICES)), [(f"q{q}", None, f"tail{k}", "ar_h1", XS, CONTROLS) for k, q in enumerate(SLICES)])
def _(spark, d):
    r = _horizons(_reg(spark, d), (1,), ("ar",))
    cuts = r.agg(*[F.percentile("u", F.lit(q)).alias(f"q{k}") for k, q in enumerate(SLICES)])
    return [r.join(F.broadcast(cuts)).filter(f"u >= q{k}") for k in range(len(SLICES))]


SLOW = {"week": (1, 2, 4), "month": (1, 2, 3)}


def _slow_sql(unit: str) -> str:
    hs = ", ".join(f"{carried('ar', h)} AS ar_h{h}" for h in (0, *SLOW[unit]))
    return f"{unit}0 AS (SELECT firm, CAST(date_trunc('{unit}', day) AS DATE) AS day, coalesce(sum(ar), 0) AS ar, " + ", ".join(f"arg_max({c}, day) FILTER ({c} IS NOT NULL) AS {c}" for c in ("g", "c", "u", *CONTROLS)) + f" FROM reg0 GROUP BY 1, 2), {unit}s AS MATERIALIZED (SELECT *, g * u AS gx, c * u AS cx, {hs} FROM {unit}0)"


@_battery("eco14_local_projections", f"{REG}, {_slow_sql('week')}, {_slow_sql('month')}", [(f"day+{h}", None, "reg", f"ar_h{h}", XS, CONTROLS) for h in HORIZONS] + [(f"{u}+{h}", None, f"{u}s", f"ar_h{h}", XS, CONTROLS) for u in SLOW for h in (0, *SLOW[u])])
def _(spark, d):
    r = _reg(spark, d)
    out = [_horizons(r, HORIZONS, ("ar",))] * len(HORIZONS)
    for u, hs in SLOW.items():
        m = r.groupBy("firm", F.date_trunc(u, "day").cast("date").alias("t")).agg(F.coalesce(F.sum("ar"), F.lit(0.0)).alias("ar"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("day"))).alias(c) for c in ("g", "c", "u", *CONTROLS)]).withColumnRenamed("t", "day")
        m = _horizons(m.withColumns({"gx": F.col("g") * F.col("u"), "cx": F.col("c") * F.col("u")}), (0, *hs), ("ar",))
        out += [m] * (1 + len(hs))
    return out


BACK = 180  # days of documents behind a topic's index
TOPIC_SQL = f"days AS (SELECT DISTINCT day FROM reg), secs AS (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL), t0 AS (SELECT section, day, ln(1 + (SELECT count(*) FROM documents x WHERE x.section = secs.section AND CAST(x.publish_day AS DATE) < CAST(day AS DATE) AND CAST(x.publish_day AS DATE) >= CAST(day AS DATE) - {BACK})) AS v FROM days, secs), t1 AS (SELECT section, day, dense_rank() OVER (ORDER BY section) AS k, (v - avg(v) OVER s) / stddev_samp(v) OVER s AS z FROM t0 WINDOW s AS (PARTITION BY section))"


@_battery("eco15_by_topic", f"{REG}, {TOPIC_SQL}, " + ", ".join(f"topic{k} AS MATERIALIZED (SELECT reg.* EXCLUDE (gx, cx), g * z AS gx, c * z AS cx FROM reg JOIN t1 USING (day) WHERE k = {k} AND (SELECT count(*) FROM t1 WHERE k = {k}) >= 30)" for k in range(1, 5)), [(f"topic {k}", None, f"topic{k}", "ar_h1", XS, CONTROLS) for k in range(1, 5)])
def _(spark, d):
    r = _horizons(_reg(spark, d), (1,), ("ar",))
    n = table(spark, d, "documents").filter("section is not null").groupBy("section", F.col("publish_day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days, secs = r.select(F.col("day").cast("date").alias("day")).distinct(), n.select("section").distinct()
    grid = days.join(F.broadcast(secs)).select("section", "day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"))
    back = W.partitionBy("section").orderBy(F.unix_date("day")).rangeBetween(-BACK, -1)
    t = n.filter("day is not null").select("section", "day", "n", F.lit(0).alias("asked")).unionAll(grid).withColumn("v", F.log1p(F.coalesce(F.sum("n").over(back), F.lit(0)))).filter("asked = 1")
    s = W.partitionBy("section")
    z = t.select("section", "day", F.try_divide(F.col("v") - F.avg("v").over(s), F.nullif(F.stddev_samp("v").over(s), F.lit(0.0))).alias("z"), F.count(F.lit(1)).over(s).alias("days"), F.dense_rank().over(W.orderBy("section")).alias("k")).filter("days >= 30")
    m = r.drop("gx", "cx").withColumn("on", F.col("day").cast("date")).join(F.broadcast(z.withColumnRenamed("day", "on")), "on").withColumns({"gx": F.col("g") * F.col("z"), "cx": F.col("c") * F.col("z")})
    return [m.filter(F.col("k") == k) for k in range(1, 5)]


@_battery("eco17_exposure_variants", f"{REG}, base AS (SELECT firm, arg_min(g, day) FILTER (g IS NOT NULL) AS g0, arg_min(c, day) FILTER (c IS NOT NULL) AS c0 FROM reg0 GROUP BY 1), variants AS MATERIALIZED (SELECT reg.*, g0 * u AS g0x, c0 * u AS c0x, " + ", ".join(f"u * CAST(category = 'G{k}' AS INT) AS u{k}" for k in (2, 3, 4)) + " FROM reg JOIN base USING (firm))", [("fixed base", None, "variants", "ar_h1", ["g0x", "c0x"], CONTROLS), ("categories", None, "variants", "ar_h1", ["u2", "u3"], ["u4", *CONTROLS])])
def _(spark, d):
    r = _horizons(_reg(spark, d), (1,), ("ar",))
    base = R.first_value(r, "firm", ["g", "c"], "day").toDF("firm", "g0", "c0")
    x = r.join(base, "firm").withColumns({"g0x": F.col("g0") * F.col("u"), "c0x": F.col("c0") * F.col("u")} | {f"u{k}": F.col("u") * (F.col("category") == f"G{k}").cast("int") for k in (2, 3, 4)})
    return [x, x]


SENTIMENT = {"hits": "count(*)", "items": "count(DISTINCT nid)", "sources": "count(DISTINCT source)", "chars": "coalesce(sum(length(content)), 0)", "titled": "count(title)", "words": "coalesce(sum(coalesce(len(keyword_hits), 0)), 0)", "repeats": "count(*) - count(DISTINCT nid)", "late": "count(*) FILTER (hit_time > crawl_time)"}


@_battery("eco19_outcome_battery", f"{REG}, said AS (SELECT regexp_extract(h.thscode, '([0-9]{{6}})', 1) AS firm, CAST(h.hit_time AS DATE) AS day, " + ", ".join(f"{v} AS {k}" for k, v in SENTIMENT.items()) + " FROM firm_news_hits h LEFT JOIN news n ON h.nid = n.news_id WHERE h.thscode IS NOT NULL AND h.hit_time IS NOT NULL GROUP BY 1, 2), voiced AS MATERIALIZED (SELECT reg.*, " + ", ".join(f"ln(1 + coalesce({k}, 0)) AS {k}" for k in SENTIMENT) + " FROM reg LEFT JOIN said ON reg.firm = said.firm AND CAST(reg.day AS DATE) = said.day)", [(f"{k}{n}", None, "voiced", k, XS, c) for k in SENTIMENT for n, c in (("", []), (" with controls", CONTROLS))])
def _(spark, d):
    r = _reg(spark, d)
    words = F.size(F.coalesce("keyword_hits", F.array().cast("array<string>")))
    n = table(spark, d, "news").select("news_id", "source", "crawl_time", F.length("content").alias("chars"), F.when(F.col("title").isNotNull(), 1).alias("titled"), words.alias("words"))  # texts stay where they are read
    h = table(spark, d, "firm_news_hits").filter("thscode is not null and hit_time is not null").select("nid", "hit_time", F.regexp_extract("thscode", r"(\d{6})", 1).alias("firm"), F.col("hit_time").cast("date").alias("on"))
    j = h.join(n, h["nid"] == n["news_id"], "left")
    count = {
        "hits": F.count(F.lit(1)), "items": F.count_distinct("nid"), "sources": F.count_distinct("source"), "chars": F.sum("chars"), "titled": F.count("titled"),
        "words": F.sum("words"), "repeats": F.count(F.lit(1)) - F.count_distinct("nid"), "late": F.count_if(F.col("hit_time") > F.col("crawl_time")),
    }
    said = j.groupBy("firm", "on").agg(*[v.alias(k) for k, v in count.items()])
    x = r.withColumn("on", F.col("day").cast("date")).join(said, ["firm", "on"], "left").withColumns({k: F.log1p(F.coalesce(k, F.lit(0)).cast("double")) for k in SENTIMENT})
    return [x] * (2 * len(SENTIMENT))


@query("eco20_detectable", f"WITH {REG}, {ONE} " + _pair("round(se{i} * (1.959963985 + 0.841621234), 7) AS mdes"))
def _(spark, d):
    return _one(spark, d)[0].select("var", F.round(E.detectable(F.col("se")), 7).alias("mdes"))
