"""Dates, calendars and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_ymd(c: Column) -> Column:
    """The first year-month-day within the first 24 characters, if it is a real date."""
    head = F.substring(c, 1, 24)
    g = lambda k: F.regexp_extract(head, r"(\d{4})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})", k)
    return F.try_to_date(F.concat(g(1), F.lit("-"), F.lpad(g(2), 2, "0"), F.lit("-"), F.lpad(g(3), 2, "0")), "yyyy-MM-dd")


def parse_any(c: Column) -> Column:
    """Epoch seconds or milliseconds, yyyymmdd, or year-month-day with any separators."""
    t = F.trim(c)
    n = t.try_cast("double")
    epoch = F.when(t.rlike(r"^\d{9,13}(\.\d+)?$"), F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n)).cast("date"))
    packed = F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    return F.coalesce(epoch, packed, parse_ymd(t))


def parse_formats(c: Column, formats: tuple[str, ...]) -> Column:
    """The first of several patterns that reads the value."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def iso_week(d: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def is_weekday(d: Column, k: int) -> Column:
    """1 on weekday k (0 is Monday), else 0."""
    return (F.weekday(d) == k).cast("int")


def next_open_day(days: DataFrame, open_days: DataFrame) -> DataFrame:
    """(day, open_day): each day with the same or next open day, null after the last. Both inputs have a column day."""
    spine = days.select("day").distinct()
    opened = open_days.select("day").distinct().withColumn("open", F.col("day"))
    span = spine.unionByName(opened.select("day")).distinct().join(opened, "day", "left")
    w = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)  # a calendar: one row a day
    return span.withColumn("open_day", F.first("open", ignorenulls=True).over(w)).join(spine, "day", "left_semi").select("day", "open_day")


def positions(days: DataFrame) -> DataFrame:
    """(day, tpos): consecutive numbers of distinct open days."""
    d = days.select("day").distinct()
    return d.withColumn("tpos", F.row_number().over(Window.orderBy("day")))


def windows_between(spark, start: str, end: str, step: str) -> DataFrame:
    """(lo, hi): consecutive windows of one step, e.g. '1 month' or '7 days', the last cut at end."""
    s = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"interval {step}"))).alias("lo"))
    return s.select("lo", F.least(F.date_sub(F.expr(f"cast(lo + interval {step} as date)"), 1), F.to_date(F.lit(end))).alias("hi"))


def dense(facts: DataFrame, keys: DataFrame, days: DataFrame, key: str, day: str, fill: dict) -> DataFrame:
    """Every key on every day, measures missing filled. The spine is a key table times a calendar."""
    spine = keys.select(key).distinct().join(F.broadcast(days.select(day).distinct()))
    return spine.join(facts, [key, day], "left").fillna(fill)
