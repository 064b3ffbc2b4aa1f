"""Problem 9: filling containers of fixed capacity with documents.

Sizes are whole tokens, so an instance is a histogram with at most `capacity`
entries however many documents there are; that histogram alone goes to the driver.
There the Martello-Toth dominance test fixes small sets that provably dominate every
other way to fill a container with its largest item, the instance shrinks, and the
remainder is packed by best fit. The plan is a table of runs (size, from rank, first
container, items a container) that the documents, ranked within their size, look up.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import tokenizer

ROWS_A_SHARD = 1_000_000


def dominating(s: int, room: int, sizes: list[int], counts: dict[int, int]) -> list[int] | None:
    """Items that fill the room beside the largest item s at least as well as any other choice, or None if no test holds.

    A single item k dominates when it fills the room, when no two others fit, or when at
    most two others fit and it is as large as any such pair.
    """
    top = bisect_right(sizes, room)
    if not top:
        return []
    k = sizes[top - 1]
    if k == room:
        return [k]
    small: list[int] = []
    for x in sizes[:3]:
        small += [x] * min(counts[x], 3 - len(small))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return [k]
    if len(small) < 3 or sum(small) > room:
        best, i, j = 0, 0, top - 1
        while i <= j:
            t = sizes[i] + sizes[j]
            if t > room or (i == j and counts[sizes[i]] < 2):
                j -= 1
            else:
                best = max(best, t)
                i += 1
        if k >= best:
            return [k]
    return None


def best_fit(room: int, sizes: list[int], counts: dict[int, int], used: Counter) -> list[int]:
    """Fills the room with the largest items that fit; the last steps look for one or two items that leave least."""
    out: list[int] = []
    left = lambda x: counts[x] - used[x]
    while True:
        top = bisect_right(sizes, room) - 1
        while top >= 0 and left(sizes[top]) <= 0:
            top -= 1
        if top < 0:
            return out
        k = sizes[top]
        if k == room:
            return [*out, k]
        # a pair that leaves less than k alone, where pairs are all that fits
        best, pick = k, (k,)
        if room < 3 * sizes[0]:
            i, j = 0, top
            while i <= j:
                a, b = sizes[i], sizes[j]
                if a + b > room or left(b) <= 0 or (i == j and left(a) < 2):
                    j -= 1
                elif left(a) <= 0:
                    i += 1
                else:
                    if a + b > best:
                        best, pick = a + b, (a, b)
                    i += 1
        for x in pick:
            used[x] += 1
            room -= x
        out += pick


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, from rank, first container, items of this size a container), and the number of containers.

    Sizes must lie in 1..capacity. Equal containers are made at once, so the work
    depends on the number of different sizes, not on the number of items.
    """
    counts = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(counts)
    given: Counter[int] = Counter()
    runs: list[tuple[int, int, int, int]] = []
    container = 0
    while sizes:
        s = sizes[-1]
        used = Counter({s: 1})
        room = capacity - s
        counts[s] -= 1
        if counts[s] == 0:
            sizes.pop()
        fixed = dominating(s, room, sizes, counts)
        counts[s] += 1
        if not sizes or sizes[-1] != s:
            insort(sizes, s)
        for x in fixed if fixed is not None else best_fit(room, sizes, counts, used.copy()):
            used[x] += 1
        times = max(1, min(counts[x] // u for x, u in used.items()))
        for x, u in used.items():
            runs.append((x, given[x], container, u))
            given[x] += u * times
            counts[x] -= u * times
            if counts[x] == 0:
                del sizes[bisect_left(sizes, x)]
        container += times
    return runs, container


def ranked(items: DataFrame, keys: list[str], order: list[str], total: int) -> DataFrame:
    """Adds rank, counted from 0 within the keys, with hot keys spread over shards: ranks within a shard plus the shard's offset."""
    shards = max(16, -(-total // ROWS_A_SHARD))
    it = items.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    per = it.groupBy(*keys, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_shard").orderBy(*order)) - 1
    return it.withColumn("_r", rank).join(per, [*keys, "_shard"]).withColumn("rank", F.col("_off") + F.col("_r")).drop("_shard", "_off", "_r")


def pack(sizes: DataFrame, capacity: int, total: int | None = None) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container) for sizes (doc_id, tokens).

    Containers are numbered from 0. A document longer than the capacity is divided into
    full pieces, each with a container of its own, and a rest that is packed like any
    other item; nothing else is divided. A size of 0 or null takes no space and goes to
    container 0.
    """
    spark = sizes.sparkSession
    cap = F.lit(capacity).cast("long")
    base = sizes.select("doc_id", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("n"))
    last = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / cap)).otherwise(F.lit(0)).cast("long")
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("first_token"), F.least(cap, F.col("n") - F.col("piece") * cap).alias("tokens")
    )
    # at most `capacity` rows
    hist = {r["tokens"]: r["c"] for r in pieces.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("c")).collect()}
    runs, _ = plan(hist, capacity)
    runs.sort()
    table = tuple(np.array([r[k] for r in runs], np.int64) for k in range(4))
    shared = spark.sparkContext.broadcast(table)  # its length depends on the capacity, not on the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, start, first, each = shared.value
        lo = {}
        if len(size):
            cuts = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1])))
            lo = {int(size[a]): (int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(size)])}
        for b in batches:
            t, r = np.asarray(b.column(3)), np.asarray(b.column(4))
            box = np.zeros(len(t), np.int64)
            for s in np.unique(t).tolist():
                if s > 0:
                    a, z = lo[s]
                    at = np.flatnonzero(t == s)
                    i = a + np.searchsorted(start[a:z], r[at], "right") - 1
                    box[at] = first[i] + (r[at] - start[i]) // each[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(box)], names=["doc_id", "piece", "first_token", "tokens", "container"])

    it = ranked(pieces, ["tokens"], ["doc_id", "piece"], sum(hist.values()) if total is None else total)
    return it.select("doc_id", "piece", "first_token", "tokens", "rank").mapInArrow(run, "doc_id long, piece int, first_token long, tokens long, container long")


def pack_documents(docs: DataFrame, packs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = tokenizer.TOKENIZER_DIR) -> DataFrame:
    """(pack_no, container, doc_id, piece, first_token, tokens) for each row of the small table of packs (pack_no, capacity, tokenizer)."""
    out, counted = None, {}
    for p in packs.select("pack_no", "capacity", "tokenizer").orderBy("pack_no").collect():  # a table of settings
        if p["tokenizer"] not in counted:
            path = _store(tokenizer.token_counts(docs, id_col, text_col, p["tokenizer"], folder))
            counted[p["tokenizer"]] = path
        one = pack(counted[p["tokenizer"]], p["capacity"]).select(F.lit(p["pack_no"]).cast("int").alias("pack_no"), "container", "doc_id", "piece", "first_token", "tokens")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "pack_no int, container long, doc_id long, piece int, first_token long, tokens long")
    return out


def _store(df: DataFrame) -> DataFrame:
    """Written once to the shared folder: lengths are read several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_no, containers, tokens, fill): the share of the containers' space in use."""
    per = packed.groupBy("pack_no").agg(F.countDistinct(F.when(F.col("tokens") > 0, F.col("container"))).alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(packs.select("pack_no", "capacity"), "pack_no").select("pack_no", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
