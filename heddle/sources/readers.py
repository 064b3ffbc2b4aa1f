"""Tolerant readers: JSON lines and documents, CSV with gaps, sectioned word lists, dated folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Rows of JSON lines files with a fixed schema; a broken line keeps its text in _corrupt_record."""
    r = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.json(path)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Like json_lines over a column of text."""
    full = f"{schema}, {CORRUPT} string"
    return lines.withColumn("_p", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).select(*[c for c in lines.columns if c != column], "_p.*")


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNotNull())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file in order, from 1: places within partitions plus the sizes of the partitions before."""
    t = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = t.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("base"))
    # the id holds the partition in its upper bits and the row within it in the lower 33
    return t.join(F.broadcast(base), "_p").select((F.col("base") + F.expr("_i & 8589934591") + 1).alias("line_no"), "value")


def json_documents(docs: DataFrame, column: str, item_schema: str) -> DataFrame:
    """Items of JSON documents: a top-level list, else a list under data, items or records, else the object itself."""
    arr = f"array<struct<{_struct(item_schema)}>>"
    d = docs.withColumn("_t", F.trim(column))
    listed = F.when(F.col("_t").startswith("["), F.from_json("_t", arr))
    inner = F.coalesce(*[F.from_json(F.get_json_object("_t", f"$.{k}"), arr) for k in ("data", "items", "records")])
    single = F.array(F.from_json("_t", f"struct<{_struct(item_schema)}>"))
    return d.withColumn("_item", F.explode(F.coalesce(listed, inner, single))).select(*[c for c in docs.columns if c != column], "_item.*")


def _struct(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parse_datatype_string(schema))


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name goes. Without schema every column is text."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if schema:
        want = T._parse_datatype_string(schema)
        df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want])
    return df.select(*columns) if columns else df


def numbers(df: DataFrame, columns: list[str], missing: str = "--") -> DataFrame:
    """Text columns as numbers: the missing mark, blanks and anything unreadable become null, thousands commas go."""
    return df.withColumns({c: F.nullif(F.regexp_replace(F.trim(c), ",", ""), F.lit(missing)).try_cast("double") for c in columns})


def only_keys(facts: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Facts whose key is in the key table."""
    return facts.join(keys.select(on).distinct(), on, "left_semi")


def ordered_union(parts: list[DataFrame]) -> DataFrame:
    """All parts with their priority, the first part 0; missing columns are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def existing(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths that exist and paths that are missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, gone = [], []
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        (there if h.getFileSystem(conf).exists(h) else gone).append(p)
    return there, gone


def sectioned_words(lines: DataFrame, header: str = r"^\[(.+)\]$", separators: str = "[、,，;；]") -> DataFrame:
    """(grp, word) of a word list in sections: lines has line_no and value; a header line names what follows."""
    head = F.nullif(F.regexp_extract(F.trim("value"), header, 1), F.lit(""))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a word list, read by one task
    x = lines.withColumn("_h", head).withColumn("grp", F.last("_h", ignorenulls=True).over(w)).filter("_h is null and grp is not null")
    words = F.filter(F.transform(F.split("value", separators), lambda s: F.trim(s)), lambda s: s != "")
    return x.select("grp", F.explode(words).alias("word")).distinct()


def stop_words(lines: DataFrame) -> DataFrame:
    return lines.select(F.trim("value").alias("word")).filter("word <> '' and not startswith(word, '#')").distinct()


def folder(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """All files below a folder as one table; files that cannot be read are skipped."""
    r = spark.read.format(fmt).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    return (r.schema(schema) if schema else r).load(path)
