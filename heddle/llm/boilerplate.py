"""Problem 1: page furniture and main body.

The pages of a host are concatenated as streams of line tokens, and a suffix array over
the streams finds the substrings that repeat across pages. A run of two lines or more
that enough different stories of the host share is furniture, unless it always stands
inside a story; numbers and the titles of linked stories are left out of its tokens, so
that runs hold together from page to page. A single line counts alone only where it is
repeated word for word. Lines whose own words name their role (cues) need
no more than one story: a cue is a prior worth the stories that a run needs. What neither
covers is the body.

Hosts are dealt into shards of a bounded number of pages, whose counts add up: of each
run a shard hands on no more of its stories than the threshold asks for, which leaves the
decision exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .forms import consistent_forms
from .furniture import BULLET, CUES, END_LINE, LINK_MARK, SENTENCE_END, roles
from .pages import arrow_map, has_text, salted_join, signed, sized_join, spread, stored

LEAST_RUN = 2  # lines of a run
LEAST_STORIES = 5  # different stories of a host that share a run
MOST_INSIDE = 0.95  # share of a run's places that stand inside a story
MOST_SLOTS = 2  # numbers of a line that may differ from page to page
KEYS = 6  # lines of a page by which its story is known
SHARD_PAGES = 32_768  # pages of a host in one task


PREFIX = re.compile(r"^(www|m|news)\.(?=.*\.)")


def home(host: str | None) -> str:
    """The host that a domain belongs to: without www., m. or news. before it; a null domain is a host of its own."""
    return PREFIX.sub("", (host or "").strip().lower(), count=1)


def _h(x: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")))


# Defaults: closing remarks of stories that name the next report, which many stories share word for word.
CLOSING = re.compile(r"(后续|接下来|未来|至于|How |What |Whether |Who |When |Why |Will |Wie |Was |Ob |Wer |今後|果たして|Cómo |Comment )[^。.!?;]{1,100}(\.\.\.|…)+$")
# Defaults: closing remarks in brackets, that a party gave no comment.
NO_COMMENT = re.compile(r"\(.{2,60}(不予置评|未予置评|未作回应|declined to comment|did not comment|コメントを控え|コメントしていない|keine Stellungnahme|keinen Kommentar|nicht äußern).{0,60}\)$")


def of_story(line: str) -> bool:
    """A line that is the story's however often it stands: its end mark, its closing question or remark."""
    return bool(END_LINE.match(line) or CLOSING.match(line) or NO_COMMENT.match(line))


NUMBER = re.compile(r"\d[\d.,]*")
LINK_CUE = re.compile(CUES["links"][0])
STORY_TOKEN = 0


def page_tokens(host: str, lines: list[str], kinds: list[int]) -> list[int]:
    """A token for each non-blank line of a page, within its host.

    STORY_TOKEN stands for what is the story's by definition; odd tokens for lines kept word for word, even ones for
    lines of which numbers or a linked story's title are left out. A marked line counts by its mark and the line that
    heads its list, so a story's own list is never taken for a list of links; closed sentences, bulleted lines and
    lines of many numbers keep them.
    """
    out, head = [], ""
    for x, role in zip(lines, kinds):
        if not x:
            continue
        if not role and of_story(x):
            out.append(STORY_TOKEN)
            head = x
            continue
        m = len(x) <= 160 and not BULLET.match(x) and LINK_MARK.match(x)
        kept = False
        if m:
            form = "\x01" + re.sub(r"\d+", "0", m[1].strip()) + "\x00" + head
        else:
            kept = not role and (BULLET.match(x) or SENTENCE_END.search(x) or len(NUMBER.findall(x)) > MOST_SLOTS)
            form = head = "\x01" + x.split(":", 1)[0] if LINK_CUE.match(x) else x if kept else re.sub(r"\d+", "0", x)
        t = _h(host + "\n" + form) & ~1
        word_for_word = form == x and bool(kept or not NUMBER.search(x))
        out.append(t | word_for_word or 2)
    return out


def pair_keys(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """A key of each token and the next of its page; 0 where one of them is the story's or there is none."""
    t = tokens.astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    if len(t) > 1:
        x = (t[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (t[1:] + np.uint64(0x7F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:-1] = np.where((t[:-1] != 0) & (t[1:] != 0) & (page[1:] == page[:-1]), x ^ (x >> np.uint64(29)), 0)
    return out.astype(np.int64)


def _pages(cues: bool, with_form: bool, kept: list[str]):
    def run(cols: dict[str, list]) -> dict[str, list]:
        names = ["id", "host", "lines", "tokens", "pairs", "cues", "keys", "own", *(["form", "chars", "bytes"] if with_form else [])]
        out: dict[str, list] = {k: [] for k in [*names, *kept]}
        for at, (i, host, text, form) in enumerate(zip(cols["id"], cols["host"], cols["text"], consistent_forms(cols["text"]))):
            for k in kept:
                out[k].append(cols[k][at])
            host = home(host)
            lines = [x.strip() for x in form.split("\n")]
            kinds = roles(lines) if cues else [0] * len(lines)
            full = [(k, x, r) for k, (x, r) in enumerate(zip(lines, kinds)) if x]
            longest = sorted({x for _, x, r in full if not r}, key=lambda x: (-len(x), x))[:KEYS]
            place = {x: k for k, x in enumerate(longest)}
            tokens = page_tokens(host, lines, kinds)
            row = [i, _h(host), [k for k, _, _ in full], tokens, None, [bool(r) for _, _, r in full], [_h(x) | 1 for x in longest], [place.get(x, -1) for _, x, _ in full]]
            if with_form:
                row += [form, len(text), len(text.encode("utf-8", "surrogatepass"))]
            for name, v in zip(names, row):
                out[name].append(v)
        size = np.fromiter(map(len, out["tokens"]), np.int64, len(out["tokens"]))
        flat = np.fromiter((t for x in out["tokens"] for t in x), np.int64, int(size.sum()))
        pairs, ends = pair_keys(flat, np.repeat(np.arange(len(size)), size)).tolist(), np.cumsum(size).tolist()
        out["pairs"] = [pairs[e - n : e] for e, n in zip(ends, size.tolist())]
        return out

    return run


def page_table(df: DataFrame, id_col: str, text_col: str, host_col: str | None, cues: bool = True, with_form: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """Each page with text, parsed once and stored: its lines' numbers, tokens, pairs and cues, the hashes of its longest story lines, and, if asked for, its consistent form and length as stored; with string columns to keep."""
    host, keep = F.col(host_col) if host_col else F.lit(None).cast("string"), keep or {}
    src = df.filter(has_text(F.col(text_col))).select(F.col(id_col).cast("long").alias("id"), host.alias("host"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in keep.items()])
    schema = "id long, host long, lines array<int>, tokens array<long>, pairs array<long>, cues array<boolean>, keys array<long>, own array<int>" + (", form string, chars long, bytes long" if with_form else "")
    return stored(arrow_map(spread(src, "id"), schema + "".join(f", {k} string" for k in keep), _pages(cues, with_form, list(keep))))


def suffix_runs(tokens: np.ndarray, page: np.ndarray, longest: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of concatenated streams by prefix doubling, and each neighbour's common prefix length (at most longest, a power of two).

    Streams never run into each other: a suffix ends with its page.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < longest:
        nxt = np.full(n, -1, np.int64)
        m = max(n - step, 0)
        nxt[:m] = np.where(page[step : step + m] == page[:m], rank[step : step + m], -1)
        rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    home_a, home_b = page[a], page[b]
    live = np.ones(n - 1, bool) if n > 1 else np.zeros(0, bool)
    got = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # greedy by powers of two
        w = 1 << k
        ok = live & (a < n) & (b < n)
        same = np.zeros_like(ok)
        same[ok] = (ranks[k][a[ok]] == ranks[k][b[ok]]) & (got[ok] + w <= longest)
        # only blocks that lie within both pages count
        inside = np.zeros_like(ok)
        idx = np.flatnonzero(same)
        inside[idx] = (a[idx] + w <= n) & (b[idx] + w <= n)
        idx = np.flatnonzero(inside)
        inside[idx] = (page[a[idx] + w - 1] == home_a[idx]) & (page[b[idx] + w - 1] == home_b[idx])
        got[inside] += w
        a[inside] += w
        b[inside] += w
    if n > 1:
        lcp[1:] = got
    return order, lcp


def inside_story(repeated: np.ndarray, page: np.ndarray, cue: np.ndarray) -> np.ndarray:
    """Repeated lines whose unbroken sequence of repeated lines touches no edge of the page and holds no cue."""
    n = len(page)
    new_page = np.concatenate(([True], page[1:] != page[:-1]))
    edge = new_page | np.concatenate((new_page[1:], [True]))
    starts = repeated & (new_page | ~np.concatenate(([False], repeated[:-1])))
    run = np.cumsum(starts)
    closed = np.ones(int(run[-1]) + 1 if n else 1, bool)
    closed[run[repeated & (edge | cue)]] = False
    return repeated & closed[run]


def shard_runs(tokens: list[np.ndarray], keys: list[np.ndarray], own: list[np.ndarray], cues: list[np.ndarray], whole: bool, least: int = LEAST_STORIES) -> dict[str, np.ndarray]:
    """Rows (key, size, k, story, places, inside) of the runs of some pages of one host.

    size is the run's lines, 1 or LEAST_RUN. Of each of the page's longest lines k that are no part of the run up to
    `least` stories are told, the smallest hashes, so that the shards' rows add up to an exact test; places and inside
    stand in rows of their own, with k -1. Where the pages are the whole host, runs below the threshold are left out.
    """
    flat, size = np.concatenate(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    page = np.repeat(np.arange(len(tokens)), size)
    own_at = np.concatenate(own)
    story = np.zeros((len(keys), KEYS), np.int64)
    for i, k in enumerate(keys):
        story[i, : len(k)] = k
    order, lcp = suffix_runs(flat, page)
    first = np.cumsum(np.concatenate(([True], lcp[1:] < 1))) - 1
    seen = np.bincount(np.unique(first * np.int64(len(tokens)) + page[order]) // len(tokens))  # pages of each line
    repeated = np.zeros(len(flat), bool)
    repeated[order] = seen[first] > 1
    cue = np.concatenate(cues)
    repeated = (repeated | cue) & (flat != STORY_TOKEN)
    inside = inside_story(repeated, page, cue)
    nxt = np.minimum(np.arange(len(flat)) + 1, len(flat) - 1)
    pairs = pair_keys(flat, page)
    out: dict[str, list] = {k: [] for k in ("key", "size", "k", "story", "places", "inside")}

    def add(key, lines, k, told, places, within):
        for name, v in zip(out, (key, np.full(len(key), lines), np.full(len(key), k), told, places, within)):
            out[name].append(np.asarray(v, np.int64))

    for lines, depth, key_of, ok in ((1, 1, flat, (flat & 1) == 1), (LEAST_RUN, LEAST_RUN, pairs, pairs != 0)):
        at = np.flatnonzero(ok[order])
        if not len(at):
            continue
        block = (np.cumsum(np.concatenate(([True], lcp[1:] < depth))) - 1)[at]
        pos = order[at]
        if whole:  # runs on too few pages are on too few stories
            often = np.bincount(block)[block] >= least
            block, pos = block[often], pos[often]
            if not len(pos):
                continue
        block = np.unique(block, return_inverse=True)[1]
        n = int(block[-1]) + 1
        key = np.zeros(n, np.int64)
        key[block] = key_of[pos]
        places, within = np.bincount(block, minlength=n), np.bincount(block, weights=inside[pos], minlength=n)
        told, most = [], np.zeros(n, np.int64)
        for k in range(KEYS):
            s = story[page[pos], k]
            use = (s != 0) & (own_at[pos] != k)
            if lines > 1:
                use &= own_at[nxt[pos]] != k
            both = np.stack([block[use], s[use]], 1)[np.lexsort((s[use], block[use]))]
            if not len(both):
                continue
            both = both[np.concatenate(([True], (both[1:] != both[:-1]).any(1)))]
            start = np.flatnonzero(np.concatenate(([True], both[1:, 0] != both[:-1, 0])))
            rank = np.arange(len(both)) - np.repeat(start, np.diff(np.append(start, len(both))))
            most[both[start, 0]] = np.maximum(most[both[start, 0]], np.diff(np.append(start, len(both))))
            told.append((k, both[rank < least]))
        good = most >= least if whole else np.ones(n, bool)
        g = np.flatnonzero(good)
        add(key[g], lines, -1, np.zeros(len(g)), places[g], within[g])
        for k, both in told:
            both = both[good[both[:, 0]]]
            zero = np.zeros(len(both))
            add(key[both[:, 0]], lines, k, both[:, 1], zero, zero)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


RUN_SCHEMA = "key long, size int, k int, story long, places long, inside long"


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    a = column.combine_chunks()
    flat, cuts = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
    return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


def _shard(t: pa.Table) -> pa.Table:
    got = shard_runs(_lists(t["tokens"]), _lists(t["keys"]), _lists(t["own"]), _lists(t["cues"]), t["shards"][0].as_py() == 1)
    kinds = {"size": pa.int32(), "k": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items()})


def host_runs(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(key, size): the runs and single lines that enough stories of a host share; a stored table."""
    p = pages.filter(F.size("tokens") > 0).select("id", "host", "tokens", "keys", "own", "cues")
    large = p.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / shard_pages).cast("int").alias("shards")).filter("shards > 1")
    # large hosts are at most pages / shard_pages rows
    dealt = salted_join(p, large, ["host"], F.col("id"), "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    tasks = max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // shard_pages))
    told = dealt.select("host", "shard", "shards", "tokens", "keys", "own", "cues").repartition(tasks, "host", "shard").groupBy("host", "shard").applyInArrow(_shard, RUN_SCHEMA)
    by_key = told.groupBy("key", "size", "k").agg(F.count_distinct(F.when(F.col("k") >= 0, F.col("story"))).alias("stories"), F.sum("places").alias("places"), F.sum("inside").alias("inside"))
    runs = by_key.groupBy("key", "size").agg(F.max("stories").alias("stories"), F.sum("places").alias("places"), F.sum("inside").alias("inside"))
    often = runs.filter((F.col("stories") >= LEAST_STORIES) & (F.col("inside") <= MOST_INSIDE * F.col("places")))
    return stored(often.select("key", "size"))


def covered(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, line_no, cue, size): each line that a repeated run covers, once for each size of run."""
    z = F.posexplode(F.arrays_zip("lines", "tokens", "pairs", "cues")).alias("k", "x")
    rows = pages.select("id", "lines", "cues", z)
    after = F.struct(F.try_element_at("lines", F.col("k") + 2).alias("line_no"), F.try_element_at("cues", F.col("k") + 2).alias("cue"))
    here = F.struct(F.col("x.lines").alias("line_no"), F.col("x.cues").alias("cue"))
    none = F.lit(None).cast("struct<line_no:int,cue:boolean>")
    line = F.struct(F.col("x.tokens").alias("key"), F.lit(1).alias("size"), here.alias("a"), none.alias("b"))
    pair = F.struct(F.col("x.pairs").alias("key"), F.lit(LEAST_RUN).alias("size"), here.alias("a"), after.alias("b"))
    keyed = rows.select("id", F.explode(F.array(line, pair)).alias("r")).select("id", "r.*").filter((F.col("key") != 0) & ((F.col("size") > 1) | (F.col("key").bitwiseAND(F.lit(1)) == 1)))
    hit = sized_join(keyed, runs, ["key", "size"], F.col("id"))
    return hit.select("id", "size", F.explode(F.array("a", "b")).alias("r")).filter("r is not null").select("id", "r.line_no", "r.cue", "size").distinct()


def cue_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines whose own words name their role."""
    return pages.select("id", F.explode(F.arrays_zip("lines", "cues")).alias("r")).filter("r.cues").select("id", F.col("r.lines").alias("line_no"))


def _found(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    runs = covered(pages, host_runs(pages, shard_pages)).filter("not cue").select("id", "line_no").distinct()
    return cue_lines(pages).unionAll(runs)


def furniture_lines(df: DataFrame, id_col: str, text_col: str, host_col: str, cues: bool = True, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """(article_id, line_no) of each non-blank line of a content that is not main body.

    Null and empty contents give nothing; a null host counts as one host. Ids must be unique. Without cues repeated runs
    alone decide.
    """
    return _found(page_table(df, id_col, text_col, host_col, cues), shard_pages).select(F.col("id").alias("article_id"), "line_no")


def evidence(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(evidence, lines): found lines by what told them first: a 'run', a 'line' repeated alone, or a 'cue' only."""
    pages = page_table(df, id_col, text_col, host_col)
    runs = covered(pages, host_runs(pages)).groupBy("id", "line_no").agg(F.max("size").alias("size"))
    both = cue_lines(pages).join(runs, ["id", "line_no"], "full")
    return both.groupBy(F.when(F.col("size") > 1, "run").when(F.col("size") == 1, "line").otherwise("cue").alias("evidence")).agg(F.count(F.lit(1)).alias("lines"))


def without_cues(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(lines, by_runs, shared, recall): what repeated runs find with every cue switched off, against all that is found."""
    a = furniture_lines(df, id_col, text_col, host_col).withColumn("a", F.lit(1))
    b = furniture_lines(df, id_col, text_col, host_col, cues=False).withColumn("b", F.lit(1))
    both = a.join(b, ["article_id", "line_no"], "full")
    return both.agg(F.count("a").alias("lines"), F.count("b").alias("by_runs"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared")).withColumn("recall", F.round(F.try_divide("shared", "lines"), 4))


def story_table(df: DataFrame, id_col: str, text_col: str, host_col: str | None = None, keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, form, chars, bytes, out): each content's consistent form, its length as stored, and the numbers of its furniture lines; without a host column by cues alone."""
    pages = page_table(df, id_col, text_col, host_col, with_form=True, keep=keep)
    cue = F.transform(F.filter(F.arrays_zip("lines", "cues"), lambda r: r["cues"]), lambda r: r["lines"])
    rows = pages.select("id", "form", "chars", "bytes", *(keep or {}), cue.alias("out"))
    if host_col is None:
        return rows
    gone = stored(covered(pages, host_runs(pages)).filter("not cue").groupBy("id").agg(F.collect_set("line_no").alias("gone")))
    return sized_join(rows, gone, ["id"], None, "left").withColumn("out", F.concat("out", F.coalesce("gone", F.array().cast("array<int>")))).drop("gone")


def story_lines(form: str, out: list[int]) -> list[str]:
    """The story lines of a consistent form, trimmed, without blank ones."""
    gone = set(out)
    return [y for k, x in enumerate(form.split("\n")) if k not in gone and (y := x.strip())]


def _bodies(cols: dict[str, list]) -> dict[str, list]:
    return {"id": cols["id"], "body": ["\n".join(x for k, x in enumerate(form.split("\n")) if k not in set(out)) for form, out in zip(cols["form"], cols["out"])]}


def main_bodies(df: DataFrame, id_col: str, text_col: str, host_col: str | None = None) -> DataFrame:
    """(id, body): the story lines of each content in the consistent form; by cues alone without a host column. A null content stays null, an empty one empty."""
    bodies = arrow_map(story_table(df, id_col, text_col, host_col), "id long, body string", _bodies)
    none = df.filter(~has_text(F.col(text_col)) | F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return bodies.unionByName(none)
