"""Panel inference: within transform, least squares, clustered errors, event studies, placebo, multiple testing.

Data stay distributed; only sums of K x K products of regressors reach the driver.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ special functions


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def chi2_1_tail(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


# ------------------------------------------------------------------ regressions


PAIRS = 2_000_000  # rows, or different pairs of groups, that one task may hold
EFFECTS = 100_000  # groups whose effects every worker may hold
EACH = 8  # fits that a task makes of rows that it reads once
GUARD = 200  # rows below which nothing is fitted


def _swept(fe1: str, fe2: str, k: int, sweeps: int):
    """A function for mapInArrow in one task: from counts and sums of k columns by row or pair of groups, (side, fe1, fe2, effects) of each group of fe1 (side 0) and of fe2 (side 1)."""

    def run(batches):
        import pyarrow as pa

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        codes, keys = [], []
        for fe in (fe1, fe2):
            d = t[fe].combine_chunks().dictionary_encode("encode")  # null is a group as well
            codes.append(d.indices.to_numpy())
            keys.append(d.dictionary)
        w, size = t["_n"].to_numpy().astype(float), [len(x) for x in keys]
        n = [np.bincount(c, weights=w, minlength=m) for c, m in zip(codes, size)]
        effects = [np.zeros((m, k)) for m in size]
        for c in range(k):
            v = t[f"_s{c}"].to_numpy()
            s = [np.bincount(x, weights=v, minlength=m) for x, m in zip(codes, size)]
            a, b = np.zeros(size[0]), np.zeros(size[1])
            for _ in range(sweeps):
                a = (s[0] - np.bincount(codes[0], weights=w * b[codes[1]], minlength=size[0])) / n[0]
                b = (s[1] - np.bincount(codes[1], weights=w * a[codes[0]], minlength=size[1])) / n[1]
            effects[0][:, c], effects[1][:, c] = a, b
        for side, m in enumerate(size):
            ends = [keys[x] if x == side else pa.nulls(m, keys[x].type) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, side, np.int32)), *ends, *[pa.array(x) for x in effects[side].T]], names=["_side", fe1, fe2, *[f"_e{c}" for c in range(k)]])

    return run


def within(df: DataFrame, cols: list[str], fe1: str, fe2: str, sweeps: int = 12, pairs: int = PAIRS, kept: bool = False) -> DataFrame:
    """Columns less their means by fe1 and fe2 in turn, `sweeps` times; exact after one sweep on a balanced panel. The columns must hold no nulls.

    A sweep changes effects of groups only, x - a[fe1] - b[fe2]: rows stay where they are, and what moves is one mean a
    group, combined on the map side. The sweeps run in one task on the rows, or the sums by pair of groups, where these are
    few, and else as aggregates of the stored rows; all give the same effects, and none of them reaches the driver.
    `kept` rows are read from a stored table already.
    """
    from .joins import stored

    rows = df if kept else stored(df)
    values = [F.col(c).cast("double") for c in cols]
    if rows.count() <= pairs:
        few = rows.select(fe1, fe2, F.lit(1).cast("long").alias("_n"), *[v.alias(f"_s{k}") for k, v in enumerate(values)])
    else:
        few = stored(rows.groupBy(fe1, fe2).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s{k}") for k, v in enumerate(values)]))
        few = few if few.count() <= pairs else None
    if few is not None:
        kinds = [f"`{fe}` {df.schema[fe].dataType.simpleString()}" for fe in (fe1, fe2)]
        schema = ", ".join(["_side int", *kinds, *[f"_e{k} double" for k in range(len(cols))]])
        out = stored(few.repartition(1).mapInArrow(_swept(fe1, fe2, len(cols), sweeps), schema))
        effects = [out.filter(F.col("_side") == side).select(fe, *[F.col(f"_e{k}").alias(f"_{fe}_{k}") for k in range(len(cols))]) for side, fe in enumerate((fe1, fe2))]
        effects = [F.broadcast(e) if e.count() <= EFFECTS else e for e in effects]
    else:
        effects = [None, None]
        for _ in range(sweeps):
            for k, fe in enumerate((fe1, fe2)):
                x = rows if effects[1 - k] is None else _less(rows, effects[1 - k], (fe1, fe2)[1 - k], cols)
                effects[k] = stored(x.groupBy(fe).agg(*[F.avg(c).alias(f"_{fe}_{m}") for m, c in enumerate(cols)]))
    for fe, e in zip((fe1, fe2), effects):
        rows = _less(rows, e, fe, cols)
    return rows.select(*df.columns)


def _less(rows: DataFrame, effects: DataFrame, fe: str, cols: list[str]) -> DataFrame:
    """Columns less the effects of their group; a null group is one as well."""
    e = effects.withColumnRenamed(fe, "_key")
    return rows.join(e, rows[fe].eqNullSafe(e["_key"]), "left").select(*[c for c in rows.columns if c not in cols], *[(F.col(c) - F.col(f"_{fe}_{k}")).alias(c) for k, c in enumerate(cols)])


def _products(xs: list[str], y: str) -> list[Column]:
    names = [*xs, y]
    return [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"p_{i}_{j}"] or 0.0
    return m


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(coefficients, inverse of X'X, rows, y'y) from one aggregate of K x K sums."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *_products(xs, y)).collect()[0]  # one row of sums
    m = _matrix(r, len(xs) + 1)
    return *_solved(m), r["n"], m[-1, -1]


def _solved(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, inverse of X'X) from the products of the regressors and, last, the outcome."""
    xtx, xty = m[:-1, :-1], m[:-1, -1]
    try:
        inv = np.linalg.inv(xtx)
    except np.linalg.LinAlgError:
        inv = np.linalg.pinv(xtx)
    return inv @ xty, inv


def _meat(scored: DataFrame, xs: list[str], by: str | None) -> tuple[np.ndarray, int]:
    """Sum of outer products of scores summed by cluster, and the number of clusters."""
    s = [f"s_{i}" for i in range(len(xs))]
    g = scored.groupBy(by).agg(*[F.sum(c).alias(c) for c in s]) if by else scored
    r = g.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(s) for j, b in enumerate(s) if j >= i]).collect()[0]
    return _matrix(r, len(xs)), r["n"]


def _complete(df: DataFrame, use: list[str], firm: str, day: str) -> DataFrame:
    """Rows without null or NaN in any used column, those cast to double."""
    ok = F.lit(True)
    for c in use:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.filter(ok & F.col(firm).isNotNull() & F.col(day).isNotNull()).select(firm, day, *[F.col(c).cast("double").alias(c) for c in use])


SUMS = "spec int, n long, n_firm long, n_day long, m array<double>, rss double, firm array<double>, day array<double>, both array<double>"


def _columns(batches) -> tuple[list[np.ndarray], list[int], list[np.ndarray]]:
    """Codes of the first two columns and their numbers of groups, and the others, where a null is NaN; a batch is let go once it is read."""
    parts, codes = None, [{}, {}]
    for b in batches:
        parts = parts or [[] for _ in b.columns]
        for i, c in enumerate(b.columns):
            if i < 2:
                d = c.dictionary_encode()
                c = np.array([codes[i].setdefault(x, len(codes[i])) for x in d.dictionary.to_pylist()], np.int32)[d.indices.to_numpy()]
            else:
                c = np.array(c.to_numpy(zero_copy_only=False), float)
            parts[i].append(c)
    cols = []
    while parts:
        cols.append(np.concatenate(parts.pop(0)))
    return cols[:2], [len(x) for x in codes], cols[2:]


def _summed(specs: list[tuple[int, int, list[int]]], sweeps: int):
    """A function for mapInArrow in one task: from firm, day and columns, a row of all sums (SUMS) that a fit needs for each spec (number, outcome, regressors as places among the columns) with rows.

    Specs with the same complete rows share their groups, and the regressors less their means.
    """

    def run(batches):
        import pyarrow as pa

        codes, size, cols = _columns(batches)
        like: dict[bytes, list[tuple[int, int, list[int]]]] = {}
        for s in specs if cols else ():
            like.setdefault(np.packbits(~np.any([np.isnan(cols[c]) for c in (s[1], *s[2])], axis=0)).tobytes(), []).append(s)
        for bits, own in like.items():
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(codes[0])))
            if not len(at):
                continue
            by = [x[at] for x in codes]
            pairs = np.unique(by[0].astype(np.int64) * size[1] + by[1], return_inverse=True)[1]
            count = [np.bincount(x, minlength=m) for x, m in zip(by, size)]
            there = [np.maximum(x, 1) for x in count]

            def less(c: int) -> np.ndarray:
                v = cols[c][at]
                s = [np.bincount(x, weights=v, minlength=m) for x, m in zip(by, size)]
                a, b = np.zeros(size[0]), np.zeros(size[1])
                for _ in range(sweeps):
                    a = (s[0] - np.bincount(by[0], weights=b[by[1]], minlength=size[0])) / there[0]
                    b = (s[1] - np.bincount(by[1], weights=a[by[0]], minlength=size[1])) / there[1]
                return v - a[by[0]] - b[by[1]]

            held: dict[int, np.ndarray] = {}
            for k, (number, y, xs) in enumerate(own):
                held |= {c: less(c) for c in xs if c not in held}
                names = [*[held[c] for c in xs], held[y] if y in held else less(y)]
                m = np.array([[a @ b for b in names] for a in names])
                e = names[-1] - sum(x * b for x, b in zip(names, _solved(m)[0]))
                meats = []
                for g in (*by, pairs):
                    g = np.array([np.bincount(g, weights=x * e) for x in names[:-1]])
                    meats.append((g @ g.T).ravel().tolist())
                row = [number, len(at), *[np.count_nonzero(x) for x in count], m.ravel().tolist(), float(e @ e), *meats]
                held = {c: v for c, v in held.items() if any(c in (s[1], *s[2]) for s in own[k + 1 :])}
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.int64()] * 3, pa.list_(pa.float64()), pa.float64(), *[pa.list_(pa.float64())] * 3])], names=[c.split()[0] for c in SUMS.split(", ")])

    return run


def panel_fit(df: DataFrame, y: str, xs: list[str], firm: str, day: str, sweeps: int = 12, cluster: bool = True, least: int = 0, corrected: bool = True, kept: bool = False) -> dict | None:
    """Two-way fixed effects with errors clustered by firm and day; None with fewer than `least` complete rows.

    V = (firm + day - intersection) (N - 1) / (N - K - firms - days + 1), by clusters of firm alone where a variance comes
    out negative; without clusters V has the residual variance over N - K. Corrected, the firm and day terms are also
    multiplied by G / (G - 1) for their G clusters, and the plain variance has the effects' degrees of freedom taken off.
    Rows with a null or NaN in any used column are left out; `kept` is that of `within`.
    """
    from .joins import stored

    use = [y, *xs]
    w = stored(within(_complete(df, use, firm, day), use, firm, day, sweeps, kept=kept))
    beta, inv, n, yy = ols(w, y, xs)
    if n < least:
        return None
    k = len(xs)
    e = F.col(y) - sum(F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta))
    scored = w.withColumn("_e", e).select(firm, day, F.col("_e"), *[(F.col(x) * F.col("_e")).alias(f"s_{i}") for i, x in enumerate(xs)])
    rss = scored.agg(F.sum(F.col("_e") * F.col("_e"))).collect()[0][0] or 0.0
    mf, nf = _meat(scored, xs, firm)
    md, nd = _meat(scored, xs, day)
    mi = _meat(scored.groupBy(firm, day).agg(*[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(k)]), xs, None)[0] if cluster else None
    return _fit(xs, beta, inv, n, yy, rss, mf, nf, md, nd, mi, corrected)


def _fit(xs: list[str], beta: np.ndarray, inv: np.ndarray, n: int, yy: float, rss: float, mf: np.ndarray, nf: int, md: np.ndarray, nd: int, mi: np.ndarray | None, corrected: bool) -> dict:
    """The fit of `panel_fit` from its sums; without mi, those by firm and day, errors are not clustered."""
    k = len(xs)
    if mi is not None:
        adjust = (n - 1) / max(n - k - nf - nd + 1, 1)
        more = lambda g: g / max(g - 1, 1) if corrected else 1.0
        v = adjust * inv @ (more(nf) * mf + more(nd) * md - mi) @ inv
        if (np.diag(v) < 0).any():
            v = adjust * inv @ (more(nf) * mf) @ inv
    else:
        v = inv * rss / max(n - k - (nf + nd - 1 if corrected else 0), 1)
    se = np.sqrt(np.maximum(np.diag(v), 0))
    t = np.divide(beta, se, out=np.full(k, np.nan), where=se > 0)
    df_t = n - k - 1
    return {
        "xs": xs, "coef": beta, "se": se, "t": t, "p": np.array([t_two_sided(float(x), df_t) for x in t]), "lo": beta - 1.96 * se, "hi": beta + 1.96 * se,
        "n": n, "n_firm": nf, "n_day": nd, "within_r2": 1 - rss / yy if yy else float("nan"), "v": v,
    }


def fits(specs: list[tuple[str, DataFrame, str, list[str]]], firm: str, day: str, threads: int = 6, sweeps: int = 12, held: int = PAIRS) -> list[tuple[str, dict]]:
    """(name, fit) of each spec (name, rows, outcome, regressors) that has rows enough, over rows that are made once for all that share them.

    Fits of at most `held` rows run in one job, whose tasks read the rows once for up to EACH of them and hand on their sums; larger ones are spread over the workers, side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from .joins import stored

    if not specs:
        return []
    used = {id(s[1]): (s[1], {c: None for x in specs if x[1] is s[1] for c in (firm, day, x[2], *x[3])}) for s in specs}
    rows = {k: stored(x.select(*c)) for k, (x, c) in used.items()}
    few = {k for k, x in rows.items() if x.count() <= held}
    tasks = []
    for k in few:
        own = sorted((i for i, s in enumerate(specs) if id(s[1]) == k), key=lambda i: specs[i][3])  # those with the same regressors are likely to have the same rows
        for part in (own[i : i + EACH] for i in range(0, len(own), EACH)):
            cols = list(dict.fromkeys(c for i in part for c in (*specs[i][3], specs[i][2])))
            there = rows[k].filter(F.col(firm).isNotNull() & F.col(day).isNotNull()).select(firm, day, *[F.col(c).cast("double").alias(c) for c in cols])
            tasks.append(there.coalesce(1).mapInArrow(_summed([(i, cols.index(specs[i][2]), [cols.index(c) for c in specs[i][3]]) for i in part], sweeps), SUMS))
    sums = {r["spec"]: r for r in functools.reduce(DataFrame.unionAll, tasks).collect()} if tasks else {}  # one row a fit

    def fit(i: int) -> dict | None:
        _, x, y, xs = specs[i]
        if id(x) not in few:
            return panel_fit(rows[id(x)], y, xs, firm, day, sweeps, least=GUARD, corrected=False, kept=True)
        if i not in sums or sums[i]["n"] < GUARD:
            return None
        r, m = sums[i], np.array(sums[i]["m"]).reshape(len(xs) + 1, -1)
        mf, md, mi = (np.array(r[c]).reshape(len(xs), -1) for c in ("firm", "day", "both"))
        return _fit(xs, *_solved(m), r["n"], m[-1, -1], r["rss"], mf, r["n_firm"], md, r["n_day"], mi, False)

    with ThreadPoolExecutor(threads) as pool:
        got = pool.map(inheritable_thread_target(specs[0][1].sparkSession)(fit), range(len(specs)))
        return [(s[0], f) for s, f in zip(specs, got) if f is not None]


def wald_equal(fit: dict, a: str, b: str) -> tuple[float, float]:
    """Chi-square with one degree of freedom, and its p, for equal coefficients."""
    i, j = fit["xs"].index(a), fit["xs"].index(b)
    var = fit["v"][i, i] + fit["v"][j, j] - 2 * fit["v"][i, j]
    x = (fit["coef"][i] - fit["coef"][j]) ** 2 / var if var > 0 else float("nan")
    return x, chi2_1_tail(x) if x == x else float("nan")


def result_rows(spark, fits: list[tuple[str, dict]], only: dict[str, list[str]] | None = None) -> DataFrame:
    """(spec, var, coef, se, t, p, lo, hi, n, n_firm, n_day, within_r2), of some regressors of each spec if `only` names them."""
    rows = [
        (spec, x, *(float(f[k][i]) for k in ("coef", "se", "t", "p", "lo", "hi")), int(f["n"]), int(f["n_firm"]), int(f["n_day"]), float(f["within_r2"]))
        for spec, f in fits
        for i, x in enumerate(f["xs"])
        if only is None or x in only[spec]
    ]
    return spark.createDataFrame(rows, "spec string, var string, coef double, se double, t double, p double, lo double, hi double, n long, n_firm long, n_day long, within_r2 double")


# ------------------------------------------------------------------ series


def one_step(order: str, y: str, xs: list[str], p: int, w: int, least: int):
    """A function for applyInPandas: one-step forecasts of one series from a constant, p lags and lagged regressors over the w rows before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(order)
        v = d[y].to_numpy(float)
        n = len(v)
        cols = [np.ones(n)] + [np.concatenate((np.full(k, np.nan), v[:-k])) for k in range(1, p + 1) if k <= n]
        cols += [np.concatenate(([np.nan], d[x].to_numpy(float)[:-1])) for x in xs]
        m = np.stack(cols, 1) if n else np.zeros((0, 1))
        good = np.isfinite(m).all(1) & np.isfinite(v)
        pred, r2 = np.full(n, np.nan), np.full(n, np.nan)
        for t in range(n):
            lo = max(0, t - w)
            use = np.flatnonzero(good[lo:t]) + lo
            if len(use) < least or not np.isfinite(m[t]).all():
                continue
            b = np.linalg.lstsq(m[use], v[use], rcond=None)[0]
            pred[t] = m[t] @ b
            tot = ((v[use] - v[use].mean()) ** 2).sum()
            r2[t] = 1 - ((v[use] - m[use] @ b) ** 2).sum() / tot if tot > 0 else np.nan
        out = d.copy()
        out["forecast"], out["innovation"], out["r2"] = pred, v - pred, r2
        return out.astype({"forecast": float, "innovation": float, "r2": float}).replace({np.nan: None})

    return run


def arx(df: DataFrame, key: str, order: str, y: str, xs: list[str], p: int, w: int, least: int) -> DataFrame:
    """Adds forecast, innovation and in-sample r2 to each series; series are parallel, one is as long as its calendar."""
    keep = df.select(key, order, y, *xs)
    schema = f"{keep.schema.simpleString()[7:-1].replace(':', ' ')}, forecast double, innovation double, r2 double"
    return keep.groupBy(key).applyInPandas(one_step(order, y, xs, p, w, least), schema)


def ar1(df: DataFrame, key: str, order: str, y: str, w: int, least: int) -> DataFrame:
    """The ARX of one lag and no regressors, in window functions: adds forecast and innovation."""
    base = Window.partitionBy(key).orderBy(order)
    f = base.rowsBetween(-w, -1)
    x = df.withColumn("_lag", F.lag(y).over(base))
    n = F.regr_count(F.col(y), F.col("_lag")).over(f)
    fc = F.when(n >= least, F.regr_intercept(F.col(y), F.col("_lag")).over(f) + F.regr_slope(F.col(y), F.col("_lag")).over(f) * F.col("_lag"))
    return x.withColumn("forecast", fc).withColumn("innovation", F.col(y) - F.col("forecast")).drop("_lag")


# ------------------------------------------------------------------ events


def event_study(panel: DataFrame, events: DataFrame, group: Column, ar: str, lo: int, hi: int) -> DataFrame:
    """(grp, tau, mean_ar, se, n_events): mean over firms, then over events. panel has tpos, events has tpos and event."""
    taus = events.select("event", F.col("tpos").alias("t0"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("tau")).withColumn("tpos", F.col("t0") + F.col("tau"))
    x = panel.withColumn("grp", group).filter("grp is not null").join(taus, "tpos")
    per = x.groupBy("grp", "event", "tau").agg(F.avg(ar).alias("m"))
    out = per.groupBy("grp", "tau").agg(F.avg("m").alias("mean_ar"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n_events"))
    return out.select("grp", "tau", "mean_ar", (F.col("sd") / F.sqrt("n_events")).alias("se"), "n_events")


def cumulative(study: DataFrame) -> DataFrame:
    """Adds car and its error, cumulated over tau."""
    w = Window.partitionBy("grp").orderBy("tau").rowsBetween(Window.unboundedPreceding, 0)
    return study.withColumn("car", F.sum("mean_ar").over(w)).withColumn("car_se", F.sqrt(F.sum(F.col("se") * F.col("se")).over(w)))


def contrast(study: DataFrame, a: str, b: str) -> DataFrame:
    """(tau, mean_<a>, mean_<b>, diff, se_diff): two groups' means and their difference, its error as of independent ones."""
    x, y = (study.filter(F.col("grp") == g).select("tau", F.col("mean_ar").alias(f"mean_{g}"), F.when(F.col("n_events") > 1, F.col("se")).alias(f"_{k}")) for k, g in enumerate((a, b)))
    return x.join(y, "tau").select("tau", f"mean_{a}", f"mean_{b}", (F.col(f"mean_{a}") - F.col(f"mean_{b}")).alias("diff"), F.sqrt(F.col("_0") * F.col("_0") + F.col("_1") * F.col("_1")).alias("se_diff"))


def window_cars(study: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """(grp, span, car, t) over windows of tau."""
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spans])).alias("s")
    x = study.select("grp", "tau", "mean_ar", "se", s).filter("tau between s.a and s.b")
    g = x.groupBy("grp", "s").agg(F.sum("mean_ar").alias("car"), F.sqrt(F.sum(F.col("se") * F.col("se"))).alias("e"))
    return g.select("grp", F.format_string("[%d,%d]", "s.a", "s.b").alias("span"), "car", F.try_divide("car", "e").alias("t"))


def permuted(days: DataFrame, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, day, value): the values of a calendar dealt to its days anew in each repetition, by the order of a hash."""
    d = days.select("day", value).join(F.broadcast(days.sparkSession.range(reps).withColumnRenamed("id", "rep")))
    by_day = Window.partitionBy("rep").orderBy("day")
    by_hash = Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), F.col("rep"), F.col("day").cast("string")), "day")
    a = d.select("rep", "day", F.row_number().over(by_day).alias("k"))
    b = d.select("rep", value, F.row_number().over(by_hash).alias("k"))
    return a.join(b, ["rep", "k"]).select("rep", "day", value)


def placebo(panel: DataFrame, y: str, g: str, c: str, day: str, calendar: DataFrame, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, delta): difference of the coefficients of value x g and value x c with the value's dates permuted; rep -1 is the real one.

    Every repetition is a group of one aggregate of sums over day and pooled means removed; no refit on the driver.
    """
    cal = calendar.select(F.col(day).alias("day"), F.col(value))
    dealt = permuted(cal, value, reps, seed).unionByName(cal.select(F.lit(-1).cast("long").alias("rep"), "day", value))
    p = panel.filter(F.col(y).isNotNull() & F.col(g).isNotNull() & F.col(c).isNotNull()).select(F.col(day).alias("day"), F.col(y).alias("y"), F.col(g).alias("g"), F.col(c).alias("c"))
    # value is constant in a day: sums by day first, so the repetitions multiply days, not rows
    m = p.groupBy("day").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in ("gg", "gc", "cc", "gy", "cy")], *[F.sum(a).alias(f"m_{a}") for a in "gcy"])
    cent = {f"{a}{b}": F.col(f"s_{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}") / F.col("n") for a, b in ("gg", "gc", "cc", "gy", "cy")}
    m = m.select("day", *[v.alias(k) for k, v in cent.items()])
    v = F.col(value)
    x = dealt.join(m, "day").groupBy("rep").agg(
        *[F.sum(v * v * F.col(k)).alias(k) for k in ("gg", "gc", "cc")], *[F.sum(v * F.col(k)).alias(k) for k in ("gy", "cy")]
    )
    det = F.col("gg") * F.col("cc") - F.col("gc") * F.col("gc")
    return x.select("rep", F.try_divide((F.col("cc") * F.col("gy") - F.col("gc") * F.col("cy")) - (F.col("gg") * F.col("cy") - F.col("gc") * F.col("gy")), det).alias("delta"))


def adjusted(tests: DataFrame, p: str) -> DataFrame:
    """Adds Bonferroni and Benjamini-Hochberg values to a table of tests."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(p))
    x = tests.withColumn("_n", n).withColumn("_r", rank)
    w = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).withColumn("bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w))).drop("_n", "_r")


def detectable(se: Column, alpha_z: float = 1.959963985, power_z: float = 0.841621234) -> Column:
    """Smallest effect found with 80 % power at 5 %."""
    return se * (alpha_z + power_z)


def average_linkage(corr: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of hierarchical clustering on 1 - correlation, average linkage; a small matrix of topics."""
    n = len(corr)
    groups = {i: [i] for i in range(n)}
    d = 1 - np.asarray(corr, float)
    out, nxt = [], n
    while len(groups) > 1:
        keys = sorted(groups)
        best = min(((float(np.mean(d[np.ix_(groups[a], groups[b])])), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]))
        h, a, b = best
        out.append((a, b, h))
        groups[nxt] = groups.pop(a) + groups.pop(b)
        nxt += 1
    return out
