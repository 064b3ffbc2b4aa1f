"""Shared pieces of the text operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

MASK64 = (1 << 64) - 1


def signed(h: int) -> int:
    """An unsigned 64-bit hash as a Spark long."""
    return h - (1 << 64) if h >> 63 else h


def arrow_map(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow with columns as lists; one output batch for each input batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = rows({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt over the cores where its files give fewer tasks than cores, as a small table in one file does."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(2 * n, key)


def has_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "inner", n: int = 16) -> DataFrame:
    """A join whose hot keys are spread over n tasks: right is copied n times, left goes to one of them by salt."""
    left = left.withColumn("_salt", F.pmod(salt, F.lit(n)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


BROADCAST_ROWS = 500_000  # rows of a few short columns that every worker may hold


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: its lineage is cut, and its size is known."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column | None, how: str = "inner") -> DataFrame:
    """A join with a stored table: sent to every worker where its counted rows are few, else by a shuffle, salted against hot keys where a salt is given."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how) if salt is None else salted_join(left, right, on, salt, how)


PAIR_BLOCK = 2_000  # rows of one group in a task's block of pairs


def pairs_within(rows: DataFrame, keys: list[str], differ: str | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(keys, article_a, article_b), article_a < article_b, of all rows (keys, id, rows) of one group, those with equal `differ` left out; rows is the group's size.

    A large group is dealt into blocks, and pairs of blocks are the tasks: none holds more than two blocks of a group.
    """
    dealt = rows.withColumn("n", F.ceil(F.col("rows") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    # a row of block b meets each block c under the smaller of (b, c) and the larger
    each = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    meet = each.select(*keys, "id", *([differ] if differ else []), "b", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"))
    a, b = meet.filter("b = x").alias("a"), meet.filter("b = y").alias("b")
    on = (F.col("a.x") != F.col("a.y")) | (F.col("a.id") < F.col("b.id"))
    if differ:
        on = on & (F.col(f"a.{differ}") != F.col(f"b.{differ}"))
    for k in [*keys, "x", "y"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.least("a.id", "b.id").alias("article_a"), F.greatest("a.id", "b.id").alias("article_b"))
