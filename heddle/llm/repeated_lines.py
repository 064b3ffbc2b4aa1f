"""Problem 6: lines repeated across the documents of one source.

Every line is parsed into a template by a tree of fixed depth: its number of tokens, then
its first tokens, with a wildcard for each token that holds a digit. A line's path depends
on the line alone, so the trees of all partitions merge by adding the documents of equal
paths. A template that covers too few documents of a source cannot hold a repeated line:
the merged tree comes first, and only lines of templates that cover enough documents are
counted and joined, the rest of a corpus never moves. Lines are then told apart as they
stand, or, with slots, by all their tokens with the wildcards.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import consistent_forms
from .pages import arrow_map, has_text, signed, sized_join, spread, stored

DEPTH = 4  # tokens on a path of the tree
TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\s぀-ヿ㐀-鿿]+")
DIGIT = re.compile(r"\d")


def template(line: str, depth: int | None = DEPTH) -> str:
    """The tree path of a line: token count, then its first tokens (all without a depth), with '*' for tokens holding digits."""
    tokens = TOKEN.findall(line)
    return f"{len(tokens)}\x1f" + "\x1f".join("*" if DIGIT.search(t) else t for t in tokens[:depth])


def _h(x: str) -> int:
    return signed(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")))


def _lines(slots: bool):
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("src", "id", "lines")}
        memo: dict[str, tuple[int, int]] = {}
        for src, i, form in zip(cols["source"], cols["id"], consistent_forms(cols["text"])):
            if not form:
                continue
            seen, rows = set(), []
            for k, x in enumerate(form.split("\n")):
                x = " ".join(x.split())
                if not x:
                    continue
                h = memo.get(x)
                if h is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    h = memo[x] = (_h(template(x)), _h(template(x, None) if slots else x))
                rows.append((k, *h, h[0] not in seen, h[1] not in seen))
                seen.update(h)
            if rows:
                out["src"].append(_h(src))
                out["id"].append(i)
                out["lines"].append([dict(zip(("line_no", "tpl", "line", "new_tpl", "new_line"), r)) for r in rows])
        return out

    return run


def line_table(df: DataFrame, id_col: str, text_col: str, source_col: str, slots: bool = False) -> DataFrame:
    """Each document's lines with their templates, parsed once and stored; new_tpl and new_line tell the first of a document, so that sums count documents."""
    src = df.filter(has_text(F.col(text_col)) & F.col(source_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    schema = "src long, id long, lines array<struct<line_no:int,tpl:long,line:long,new_tpl:boolean,new_line:boolean>>"
    return stored(arrow_map(spread(src, "id"), schema, _lines(slots)))


def covering(lines: DataFrame, least: int) -> DataFrame:
    """(src, tpl): the merged tree's templates that cover enough documents of a source; a stored table."""
    first = F.filter("lines", lambda x: x["new_tpl"])
    rows = lines.select("src", F.explode(first).alias("x")).select("src", "x.tpl")
    return stored(rows.groupBy("src", "tpl").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least).select("src", "tpl"))


def survivors(lines: DataFrame, least: int) -> DataFrame:
    """(src, id, line_no, line, new_line): the lines of covering templates."""
    rows = lines.select("src", "id", F.explode("lines").alias("x")).select("src", "id", "x.*")
    return sized_join(rows, covering(lines, least), ["src", "tpl"], F.col("id")).select("src", "id", "line_no", "line", "new_line")


def repeated_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, least: int = 6, slots: bool = False) -> DataFrame:
    """(article_id, line_no) of each non-blank line that stands in at least `least` documents of its source.

    Lines are compared in the consistent form, white space trimmed and collapsed; with slots, tokens that hold digits are
    equal. Null sources and null or empty texts give nothing. Ids must be unique.
    """
    lines = survivors(line_table(df, id_col, text_col, source_col, slots), least)
    docs = lines.filter("new_line").groupBy("src", "line").agg(F.count(F.lit(1)).alias("docs"))
    often = stored(docs.filter(F.col("docs") >= least).select("src", "line"))
    return sized_join(lines.select("src", "line", "id", "line_no"), often, ["src", "line"], F.col("id")).select(F.col("id").alias("article_id"), "line_no")


def without_lines(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): each text without the lines found for it; a null text stays null."""
    per_doc = found.groupBy(F.col("article_id").alias("id")).agg(F.collect_set("line_no").alias("gone"))
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = F.split("text", "\n")
    kept = F.filter(F.transform(pieces, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), s["i"]))
    return base.join(per_doc, "id", "left").select("id", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("text"))
