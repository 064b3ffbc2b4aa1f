"""Splits, sampling and evaluation of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_split(day: Column, train_end: str, valid_end: str) -> Column:
    return F.when(day <= F.lit(train_end).cast("date"), "train").when(day <= F.lit(valid_end).cast("date"), "valid").when(day.isNotNull(), "test")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) fixed by seed and keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)


def weighted_sample(df: DataFrame, id_col: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the chance of each by its weight (Efraimidis and Spirakis); the same for the same seed."""
    return df.withColumn("_k", F.ln(uniform(seed, F.col(id_col))) / weight).orderBy(F.desc("_k"), id_col).limit(n).drop("_k")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n); rows with truth below 0 are unlabelled and left out."""
    return df.filter(F.col(truth) >= 0).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def row_shares(conf: DataFrame) -> DataFrame:
    return conf.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def class_scores(conf: DataFrame) -> DataFrame:
    """(cls, precision, recall, f1) from a confusion table; undefined ratios are 0."""
    t = conf.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("t"))
    g = conf.groupBy(F.col("guess").alias("cls")).agg(F.sum("n").alias("g"))
    h = conf.filter("truth = guess").select(F.col("truth").alias("cls"), F.col("n").alias("h"))
    x = t.join(g, "cls", "full").join(h, "cls", "left").fillna(0, ["t", "g", "h"])
    pr, rc = F.coalesce(F.try_divide("h", "g"), F.lit(0.0)), F.coalesce(F.try_divide("h", "t"), F.lit(0.0))
    return x.select("cls", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"))


def macro_f1(conf: DataFrame, least: int = 20) -> DataFrame:
    """(macro_f1, accuracy, n): null scores with fewer than `least` rows. Mean over classes that occur."""
    n = conf.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    f = class_scores(conf).agg(F.avg("f1").alias("f"))
    return n.join(F.broadcast(f)).select(F.when(F.col("n") >= least, F.col("f")).alias("macro_f1"), F.when(F.col("n") >= least, F.col("hit") / F.col("n")).alias("accuracy"), "n")


def auroc(df: DataFrame, truth: str, score: str, buckets: int = 64) -> DataFrame:
    """(auroc): rank-sum form with ties at half. Counts by score first, then running sums within score ranges and over the ranges."""
    g = df.filter((F.col(truth) >= 0) & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(truth) > 0).cast("long")).alias("p"), F.sum((F.col(truth) <= 0).cast("long")).alias("q"))
    cuts = g.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)]).alias("cuts"))  # one row
    x = g.join(F.broadcast(cuts)).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    before = F.coalesce(F.sum("q").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = x.groupBy("b").agg(F.sum("q").alias("q")).select("b", before.alias("base"))  # one row a range
    within = F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    y = x.withColumn("w", within).join(F.broadcast(base), "b")
    return y.agg(F.try_divide(F.sum(F.col("p") * (F.col("base") + F.col("w") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auroc"))


def balance_weights(df: DataFrame, label: str, lo: float = 0.2, hi: float = 5.0) -> DataFrame:
    """(label, n, weight): total / (classes * n), bounded."""
    c = df.filter(F.col(label) >= 0).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    raw = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    return c.select("label", "n", F.greatest(F.lit(lo), F.least(F.lit(hi), raw)).alias("weight"))
