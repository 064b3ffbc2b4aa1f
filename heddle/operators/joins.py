"""Joins with tables whose size is checked first, and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

BROADCAST_ROWS = 500_000  # rows of a few short columns that every worker may hold
SALTS = 16


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: its lineage is cut, and its size is known."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner", n: int = SALTS) -> DataFrame:
    """A join whose hot keys are spread over n tasks: right is copied n times, left goes to one of them by salt."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """A join with a stored table: sent to every worker where its counted rows are few, else salted against hot keys."""
    return left.join(F.broadcast(right), on, how) if right.count() <= most else salted_join(left, right, on, salt, how)
