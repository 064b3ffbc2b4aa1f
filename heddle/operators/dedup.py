"""Order-aware removal of duplicates. 'First' is always by an explicit, total order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the first by ascending order, nulls first. Null keys are keys.

    An aggregate, not a window: each task keeps one row a key before anything is
    shuffled, so a key that holds most rows costs no more than another.
    """
    cols = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), by).alias("_first")) if cols else df.select(*keys).distinct()
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def by_content(df: DataFrame, content: str, order: list[str]) -> DataFrame:
    """The first of equal contents. Only hash and order columns are shuffled with the row's key; the text is joined by Spark in the same exchange."""
    return first_of(df.withColumn("_h", F.md5(content)), ["_h"], order).drop("_h")


def by_title_and_day(df: DataFrame, title: str, day: str, order: list[str], n: int = 40) -> DataFrame:
    """The first of equal (title's first n characters, day); rows without title stay."""
    key = F.substring(F.trim(F.col(title)), 1, n)
    x = df.withColumn("_k", key)
    return first_of(x.filter("_k <> ''"), ["_k", day], order).unionByName(x.filter("_k is null or _k = ''")).drop("_k")


def event_clusters(df: DataFrame, title: str, content: str, week: str, order: list[str], n: int = 24, least: int = 12) -> DataFrame:
    """Adds event_id (first row's id), rank and weight 1/rank within (title head or content hash, week). order starts with the id."""
    key = F.when(F.length(F.substring(title, 1, n)) >= least, F.substring(title, 1, n)).otherwise(F.substring(F.md5(content), 1, 16))
    x = df.withColumn("_k", key)
    w = Window.partitionBy("_k", week)
    rank = F.row_number().over(w.orderBy(*order))
    return x.withColumn("event_id", F.min(order[0]).over(w)).withColumn("dup_rank", rank).withColumn("dup_weight", 1.0 / F.col("dup_rank")).drop("_k")


def longest_of(df: DataFrame, key: Column, text: str, order: list[str]) -> DataFrame:
    """The row with the longest text for each key, the first on a tie; blank and null keys are one key."""
    k = F.coalesce(F.trim(key), F.lit(""))
    return first_of(df.withColumn("_k", k), ["_k"], [-F.coalesce(F.length(text), F.lit(0)), *order]).drop("_k")


def statuses(df: DataFrame, hash_col: str, accepted: Column, order: list[str]) -> DataFrame:
    """Adds status: rejected, accepted, or duplicate of an earlier accepted row."""
    ok = F.coalesce(accepted, F.lit(False))
    w = Window.partitionBy(hash_col, ok).orderBy(*order)
    return df.withColumn("status", F.when(~ok, "rejected").when(F.row_number().over(w) == 1, "accepted").otherwise("duplicate"))


def _shared(df: DataFrame) -> str:
    return shared_folder(df.sparkSession)


def greedy_keys(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Rows kept by a pass in id order that drops a row if any of its keys was seen on a row kept before.

    Null keys never match. Each round settles at once every row that has no undecided
    earlier row among those it shares a key with: it is kept unless an earlier kept row
    shares a key. The first undecided row of each key is settled in every round, so the
    rounds are as many as the longest chain of rows, not the rows; only ids and hashed
    keys move, and each round is written to the shared folder.
    """
    _shared(df)
    cells = F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k).cast("string"))) for k in keys])
    rows = df.select(F.col(id_col).alias("id"), F.filter(cells, lambda x: x.isNotNull()).alias("ks"))
    free = rows.filter(F.size("ks") == 0).select("id")
    todo = rows.filter(F.size("ks") > 0).select("id", F.explode("ks").alias("k")).checkpoint()
    kept = None
    while True:
        head = todo.groupBy("k").agg(F.min("id").alias("first"))
        state = todo.join(head, "k").groupBy("id").agg(F.min((F.col("id") == F.col("first")).cast("int")).alias("leads"))
        lead = state.filter("leads = 1").select("id").checkpoint()  # first on each of its keys: kept
        kept = lead if kept is None else kept.unionByName(lead)
        gone = todo.join(lead, "id", "left_semi").select("k").distinct()
        hit = todo.join(gone, "k", "left_semi").select("id").distinct()
        todo = todo.join(hit, "id", "left_anti").checkpoint()
        if todo.isEmpty():
            break
    return df.join(kept.unionByName(free).withColumnRenamed("id", id_col), id_col, "left_semi")


def greedy_reference(rows: pd.DataFrame, id_col: str, keys: list[str]) -> list:
    """The same by one pass over a small frame, for tests."""
    seen: set = set()
    out = []
    for r in rows.sort_values(id_col).to_dict("records"):
        ks = [(k, r[k]) for k in keys if pd.notna(r[k])]
        if not any(k in seen for k in ks):
            seen.update(ks)
            out.append(r[id_col])
    return out
