"""Problem 5: texts that look the same but are stored differently, as pairs or as classes."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import consistent_forms
from .pages import PAIR_BLOCK, arrow_map, has_text, pairs_within, signed, sized_join, spread, stored


def consistent(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form): the consistent form of each text. Null stays null, empty stays empty."""
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, form string", lambda c: {"id": c["id"], "form": consistent_forms(c["text"])}
    )


def _keys(cols: dict[str, list]) -> dict[str, list]:
    forms = consistent_forms(cols["text"])
    key = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in forms]
    stored_as = [signed(xxhash.xxh3_64_intdigest(x.replace("\r\n", "\n").replace("\r", "\n").encode("utf-8", "surrogatepass"))) for x in cols["text"]]
    return {"field": cols["field"], "id": cols["id"], "key": key, "stored": stored_as}


def mixed_rows(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(field, id, key, stored, rows): the rows of classes of one consistent form that are stored in more than one way, with the class's size.

    Texts are parsed once; classes stored alike throughout are dropped on counts before anything is joined.
    """
    src = None
    for c in text_cols:
        part = df.filter(has_text(F.col(c))).select(F.lit(c).alias("field"), F.col(id_col).cast("long").alias("id"), F.col(c).alias("text"))
        src = part if src is None else src.unionAll(part)
    keys = stored(arrow_map(spread(src, "id"), "field string, id long, key binary, stored long", _keys))
    classes = keys.groupBy("field", "key").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo <> hi")
    return stored(sized_join(keys, stored(classes.select("field", "key", "rows")), ["field", "key"], F.col("id")))


def look_alike_pairs(df: DataFrame, id_col: str, text_cols: list[str], block: int = PAIR_BLOCK) -> DataFrame:
    """(field, article_a, article_b), article_a < article_b: same consistent form, different as stored.

    Null and empty texts give nothing; texts of invisible characters alone look alike; texts that differ in line ends
    alone count as equal. A class of many rows is dealt into blocks, and pairs of blocks are the tasks, so that no task
    holds more than two blocks of it; `look_alike_classes` gives the same in one row an article.
    """
    return pairs_within(mixed_rows(df, id_col, text_cols), ["field", "key"], "stored", block).select("field", "article_a", "article_b")


def look_alike_classes(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(field, article_id, class_id, links): each article of a class that is stored in more than one way, the class's smallest id, and how many of the class are stored otherwise."""
    rows = mixed_rows(df, id_col, text_cols)
    ways = rows.groupBy("field", "key", "stored").agg(F.count(F.lit(1)).alias("alike"), F.min("id").alias("first"))
    classes = ways.groupBy("field", "key").agg(F.min("first").alias("class_id"))
    small = stored(ways.join(classes, ["field", "key"]).select("field", "key", "stored", "alike", "class_id"))
    return sized_join(rows, small, ["field", "key", "stored"], F.col("id")).select("field", F.col("id").alias("article_id"), "class_id", (F.col("rows") - F.col("alike")).alias("links"))
