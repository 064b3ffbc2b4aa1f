"""Attributes as known at event time (problem 7).

A row holds in valid time from its date and in recorded time from the moment it was
known, until better rows take its place: the two axes are split into disjoint rectangles,
each with one current row. An event asks at one moment on both axes, so of the rectangles
those that the diagonal crosses are built, as the stretches in which it crosses them.
They are indexed by a grid of time cells, cut at its lines; each event point finds its
cell by equality and the rectangle within it by order. An entity of any size is spread
over its cells; only one best row for each cell is carried on to later cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_DAYS = 7


def firm_code(c: Column) -> Column:
    """The six digits that name a firm, however the code is written; null without exactly six in a row."""
    return F.nullif(F.regexp_extract(c, r"(?<!\d)(\d{6})(?!\d)", 1), F.lit(""))


def micros(c: Column) -> Column:
    """Microseconds of a zone-free timestamp taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def as_known(events: DataFrame, versions: DataFrame, cell_days: int = CELL_DAYS) -> DataFrame:
    """(event_id, version_id) of the row that held at each event; events without one give none.

    events: event_id, entity, at. versions: version_id, entity, day (date), valid_from and
    known_at. All times in microseconds. Of the rows in force the latest day holds, then
    the latest known_at, then the smallest version_id. Nulls in entity or times never
    match; repeated rows are separate versions.
    """
    width = cell_days * 86_400_000_000
    e = events.filter("entity is not null and at is not null").select("entity", "at", F.col("event_id").cast("long").alias("event_id")).withColumn("cell", F.floor(F.col("at") / width).cast("long"))
    r = rectangles(versions, width, e.select("entity", "cell").distinct())
    none = F.lit(None).cast("long")
    both = r.select("entity", "cell", F.col("from").alias("at"), "version_id", none.alias("event_id")).unionByName(e.withColumn("version_id", none)).withColumn("is_event", F.col("event_id").isNotNull())
    # a cell's rectangles are disjoint and without gaps from its first on: the last that began holds, that of the same moment too
    w = Window.partitionBy("entity", "cell").orderBy("at", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("held", F.last("version_id", ignorenulls=True).over(w)).filter("is_event and held is not null").select("event_id", F.col("held").alias("version_id"))


def rectangles(versions: DataFrame, width: int | None = None, also: DataFrame | None = None) -> DataFrame:
    """(entity, cell, version_id, from, until): the disjoint current-version stretches in each cell of the grid, from included, until not.

    Without a width there is one cell, and until is null where a version still holds. Cells without a version of their own are left out unless they are in `also` (entity, cell); there the version
    carried from earlier cells holds throughout.
    """
    rank = F.struct(F.col("day"), F.col("known_at"), (-F.col("version_id")).alias("neg"))
    v = versions.filter("entity is not null and valid_from is not null and known_at is not null and day is not null").select("entity", F.greatest("valid_from", "known_at").alias("from"), rank.alias("best"))
    v = v.groupBy("entity", "from").agg(F.max("best").alias("best")).withColumn("cell", F.floor(F.col("from") / width).cast("long") if width else F.lit(0).cast("long"))

    # the best row of each cell, then of all cells before it; one short row a cell
    kind = v.schema["best"].dataType
    tops = v.groupBy("entity", "cell").agg(F.max("best").alias("top"))
    if also is not None:
        tops = tops.unionByName(also.withColumn("top", F.lit(None).cast(kind))).groupBy("entity", "cell").agg(F.max("top").alias("top"))
    before = F.max("top").over(Window.partitionBy("entity").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.select("entity", "cell", (F.col("cell") * (width or 1)).alias("from"), before.alias("best")).filter("best is not null")

    w = Window.partitionBy("entity", "cell").orderBy("from", "best")
    held = v.select("entity", "cell", "from", "best").unionByName(carried).withColumn("held", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = held.withColumn("prev", F.lag("held").over(w)).filter("prev is null or held <> prev")
    until = F.coalesce(F.lead("from").over(w), (F.col("cell") + 1) * width if width else F.lit(None).cast("long"))
    return change.select("entity", "cell", (-F.col("held.neg")).alias("version_id"), "from", until.alias("until")).filter("until is null or from < until")


def exposure_at_hits(hits: DataFrame, panel: DataFrame, zone_hours: int = 8) -> DataFrame:
    """(hit_id, panel_id): for each hit the panel row of its firm that held at hit_time; a row counts from 00:00 of its date at UTC+zone_hours."""
    start = micros(F.col("date")) - F.lit(zone_hours * 3_600_000_000)
    versions = panel.filter("L_GPUExposure is not null and not isnan(L_GPUExposure)").select(
        F.col("panel_id").cast("long").alias("version_id"), firm_code(F.col("thscode")).alias("entity"), F.col("date").alias("day"), start.alias("valid_from"), micros(F.col("known_at")).alias("known_at")
    )
    events = hits.select(F.col("hit_id").alias("event_id"), firm_code(F.col("thscode")).alias("entity"), micros(F.col("hit_time")).alias("at"))
    return as_known(events, versions).select(F.col("event_id").alias("hit_id"), F.col("version_id").alias("panel_id"))
