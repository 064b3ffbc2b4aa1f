"""Window frames: lagged rolling moments, forward sums, winsorising, clusters of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import clip

NO_DEVIATION = 1e-6  # below it a series stands still, whatever the rounding of its sums


def lagged_z(x: Column, keys: list[str], order: list[str], w: int, least: int, bound: float = 6.0) -> Column:
    """(x - mean) / deviation of the w rows before, null with fewer than `least` values or no deviation, bounded."""
    f = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-w, -1)
    dev = F.stddev_samp(x).over(f)
    sd = F.when((F.count(x).over(f) >= least) & (dev > NO_DEVIATION), dev)
    return clip((x - F.avg(x).over(f)) / sd, -bound, bound)


def change(x: Column, keys: list[str], order: list[str], pad: bool = True) -> Column:
    """x / previous x - 1; with pad gaps take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cur = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if pad else x
    prev = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if pad else F.lag(x).over(w)
    return F.try_divide(cur, prev) - 1


def rolling(agg, x: Column, keys: list[str], order: list[str], w: int, least: int) -> Column:
    """An aggregate of the last w rows including this one, null with fewer than `least` values."""
    f = (Window.partitionBy(*keys) if keys else Window).orderBy(*order).rowsBetween(-(w - 1), 0)
    return F.when(F.count(x).over(f) >= least, agg(x).over(f))


def market_model(y: Column, x: Column, keys: list[str], order: list[str], w: int, least: int) -> Column:
    """y - (a + b x) with a and b from the w rows before; null before position w and with fewer than `least` pairs."""
    f = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-w, -1)
    n = F.regr_count(y, x).over(f)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return F.when((pos > w) & (n >= least), y - (F.regr_intercept(y, x).over(f) + F.regr_slope(y, x).over(f) * x))


def winsorised(df: DataFrame, col: str, group: str, lo: float = 0.01, hi: float = 0.99, least: int = 20) -> DataFrame:
    """Adds <col>_w: bounded at the group's quantiles; groups with fewer than `least` values stay as they are."""
    q = df.groupBy(group).agg(F.count(col).alias("_n"), F.percentile(col, F.lit(lo)).alias("_lo"), F.percentile(col, F.lit(hi)).alias("_hi"))
    x = df.join(q, group, "left")
    v = F.col(col)
    return x.withColumn(f"{col}_w", F.when((F.col("_n") >= least) & v.isNotNull(), F.greatest(F.least(v, F.col("_hi")), F.col("_lo"))).otherwise(v)).drop("_n", "_lo", "_hi")


def forward_sum(x: Column, keys: list[str], order: list[str], h: int, least: int | None = None) -> Column:
    """Sum of the next h rows, null with fewer than `least` values (half of h) or where fewer than h rows follow this one's next."""
    least = max(1, h // 2) if least is None else least
    w = Window.partitionBy(*keys).orderBy(*order)
    f = w.rowsBetween(1, h)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return F.when((F.count(x).over(f) >= least) & (F.row_number().over(w) + h - 1 <= n), F.sum(x).over(f))


def trailing_ratio(a: Column, b: Column, keys: list[str], order: list[str], w: int, least: int, eps: float = 1e-6) -> Column:
    """(sum a - sum b) / (sum a + sum b + eps) over the w rows before this one, null with fewer than `least` rows."""
    f = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-w, -1)
    sa, sb = F.sum(a).over(f), F.sum(b).over(f)
    return F.when(F.count(F.lit(1)).over(f) >= least, (sa - sb) / (sa + sb + eps))


def cross_z(x: Column, by: list[str]) -> Column:
    """z-score within a cross-section; null without deviation."""
    w = Window.partitionBy(*by)
    return (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))


def thin_fallback(x: Column, n: Column, by: list[str], least: int = 20) -> tuple[Column, Column]:
    """(value, flag): thin values (n below least; a null n is not thin) take the mean of the thick ones of their group."""
    thin = F.coalesce(n < least, F.lit(False))
    mean = F.avg(F.when(~thin, x)).over(Window.partitionBy(*by))
    return F.when(thin, mean).otherwise(x), thin.cast("int")


def gap_events(pos: Column, order: list[str], gap: int = 3) -> Column:
    """1 where an event stands at least `gap` positions after the previous event, kept or not. A few events, one window."""
    prev = F.lag(pos).over(Window.orderBy(*order))
    return F.coalesce((pos - prev >= gap), F.lit(True)).cast("int")


def first_value(df: DataFrame, key: str, cols: list[str], order: str) -> DataFrame:
    """The first value that is not null of each column, each column for itself."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def round_robin(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows taken from the groups in turn (the limit is the feature)."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", rn).orderBy("turn", group).limit(n)
