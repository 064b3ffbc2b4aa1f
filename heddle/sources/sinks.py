"""Writers: JSON lines, CSV, insert-if-new, split tables, stage tables and reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with bom the first column's name carries a byte order mark for spreadsheets."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def content_print(spark: SparkSession, path: str) -> str:
    """A fingerprint of the files under a path: their names, lengths and times of change; the path itself where there are none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return path
    files, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """Keeps a small state as JSON: written beside its place, then renamed onto it, so that a reader sees the old or the new one."""
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    how = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    how[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    context.rename(beside, p, how)


def load_state(spark: SparkSession, path: str) -> dict | None:
    """The state kept at path, or None."""
    if not exists(spark, path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def new_rows(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target does not hold, one a key."""
    return df.join(target.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def insert_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows that are new to the table at path, which may not exist yet."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.dropDuplicates(keys).write.parquet(path)
        return
    new_rows(df, spark.read.parquet(path), keys).write.mode("append").parquet(path)


def upsert(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target with rows of equal key replaced, and new rows added."""
    return target.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df)


def split_complete(df: DataFrame, path: str, required: list[str]) -> None:
    """Two folders, is_complete=true and false, by whether all required fields are filled."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    df.withColumn("is_complete", ok).write.mode("overwrite").partitionBy("is_complete").parquet(path)


def stage(spark: SparkSession, build, folder: str, name: str, *inputs: str, force: bool = False) -> DataFrame:
    """A stage table kept by name and a fingerprint of its inputs' files; built only if missing, changed or forced."""
    key = hashlib.sha256(json.dumps([name, *[[x, content_print(spark, x)] for x in inputs]]).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(df: DataFrame, path: str, **measures) -> dict:
    """Writes the stage table and returns its counters, read off the written columns in one aggregate; also kept as JSON beside the table."""
    df.write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    row = spark.read.parquet(path).agg(*[v.alias(k) for k, v in measures.items()])
    row.coalesce(1).write.mode("overwrite").json(path + "-report")
    return row.collect()[0].asDict()  # one row


def relabel(df: DataFrame, column: str, labels: DataFrame, old: str, new: str) -> DataFrame:
    """Values of a column replaced by a small table of labels; others stay."""
    m = labels.select(F.col(old).alias(column), F.col(new).alias("_new"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)
