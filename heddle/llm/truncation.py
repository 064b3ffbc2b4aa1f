"""Problem 3: texts that break off before their end.

The last line of the main body is judged. An end mark, a closing remark or a rhetorical
ellipsis closes it, broken characters or markup and marks set after a cut break it off.
Of lines without any of these, evidence of length comes first: a text as long as the
limit that its content type states, or as the length at which its source's longest texts
end together. Next, the final token is looked up in a trie of the corpus vocabulary: an
unknown token that is a proper prefix of known words was cut. A text that was cut between
words leaves whole words, so last a running sentence without its end mark counts as cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boilerplate import story_lines, story_table
from .furniture import END_LINE
from .pages import arrow_map, signed, sized_join, stored

LIMIT_TEXTS = 5  # different texts of one source and kind that end at its longest length
RARE_TAIL = 0.002  # share of the corpus's unpunctuated lines that are longer than a complete one is taken to be
LONGEST_LINE = 400  # longer lines count as this long in the histogram of lengths

# Defaults: what a transfer leaves where it stopped, in the consistent form.
BROKEN = re.compile("(�|<[a-zA-Z/!][^<>]*|</?|&#?[a-zA-Z0-9]{1,8}|\\[ ?\\+ ?\\d+ (chars|characters|words|Zeichen|字)\\]|\\[\\+\\d+ chars\\]|\\[(\\.\\.\\.|more|truncated|詳細|详细|全文)\\])$")
ENDED = re.compile(r"[。.!?][\"”“’‘」』»›)）】》\]]*$")
ELLIPSIS = re.compile(r"(\.\.\.|…)+$")
# Defaults: openings of a closing question, which may trail off by intent.
RHETORICAL = re.compile(r"(后续|接下来|未来|至于|How |What |Whether |Who |When |Why |Will |Wie |Was |Ob |Wer |今後|果たして|Cómo |Comment )[^。.!?;]{1,100}$")
RUNNING = re.compile(r"[。，,;；“「『«„]|: [a-z]|[.!?] ")
STATED = re.compile(r"(\d{3,6})")
CJK = "぀-ヿ㐀-鿿"
HAN = re.compile(f"[{CJK}]")
LETTERS = rf"[^\W\d_{CJK}]+"
WORD = re.compile(rf"{LETTERS}(?:['’]{LETTERS})?")
DIGITS = re.compile(r"\d")
CLOSED = re.compile(r".*[。.!?,;，；]")
GOES_ON = "\x01"  # stands for any further letter of a longer word


def at_limit(chars: int, size: int, kind: str | None) -> bool:
    """Whether a content of so many characters and bytes is as long as its type's stated limit."""
    m = STATED.search(kind or "")
    return bool(m) and (chars == int(m[1]) or int(m[1]) - 3 < size <= int(m[1]) + 2)


def final_token(line: str) -> str:
    """The last word of a line, digits as 0; in scripts without spaces its last two characters."""
    if HAN.match(line[-1:]):
        return DIGITS.sub("0", line[-2:])
    words = WORD.findall(line)
    return words[-1] if words and line.endswith(words[-1]) else ""


def ending(story: list[str]) -> tuple[str, str, bool, int]:
    """(state, final token, running, length) of the last of the story lines.

    state: 'whole'; 'mark' for what a cut leaves; 'point' for a number's own point, which ends a sentence unless the text
    is at its limit; 'item' for a list item without end mark, and 'open' for any other line. running tells a sentence
    among others or within brackets, length is that of an open line.
    """
    last = story[-1] if story else ""
    if not last or END_LINE.match(last):
        return "whole", "", False, 0
    if BROKEN.search(last):
        return "mark", "", False, 0
    if ELLIPSIS.search(last):
        return ("whole" if RHETORICAL.match(ELLIPSIS.sub("", last).rstrip()) else "mark"), "", False, 0
    if ENDED.search(last):
        return ("point" if re.search(r"\d\.$", last) else "whole"), "", False, 0
    if last.startswith("(") and last.endswith(")") and last.count("(") == last.count(")"):
        return "whole", "", False, 0
    if last.startswith("•"):
        return "item", "" if re.search(r"[\d%)]$", last) else final_token(last), False, 0
    running = last.count("(") > last.count(")") or bool(re.search(r"[、，,;；:：–—-]$", last)) or bool(RUNNING.search(last))
    return "open", final_token(last), running, len(last)


def _facts(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("state", "token", "running", "length", "stated", "print")}
    for form, gone, chars, size, kind in zip(cols["form"], cols["out"], cols["chars"], cols["bytes"], cols["kind"]):
        for k, v in zip(out, (*ending(story_lines(form, gone)), at_limit(chars, size, kind), signed(xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass"))))):
            out[k].append(v)
    return {**out, **{k: cols[k] for k in ("id", "source", "kind", "chars", "bytes")}}


def words_of(text: str) -> set[str]:
    """Words of complete places; of scripts without spaces each two characters before a mark or a line's end, and with GOES_ON those that another character follows."""
    out = set(WORD.findall(text))
    cp = np.frombuffer(DIGITS.sub("0", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) > 2:
        han = ((cp >= 0x3040) & (cp < 0x3100)) | ((cp >= 0x3400) & (cp < 0xA000))
        two = np.flatnonzero(han[1:-1] & (cp[:-2] != 10)) + 1
        code = cp[two - 1].astype(np.uint64) << np.uint64(21) | cp[two]
        on = han[two + 1]
        plain = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[two + 1]
        ends = ~on & ~((plain < 128) & np.array([chr(c).isalnum() for c in range(128)])[np.minimum(plain, 127)])
        for mask, tail in ((on, GOES_ON), (ends, "")):
            for c in np.unique(code[mask]).tolist():
                out.add(chr(c >> 21) + chr(c & 0x1FFFFF) + tail)
    return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): words of all but the last line of each body and of what is closed in the last; and, with no word, n-long unpunctuated lines that are not last."""
    for b in batches:
        inner: list[str] = []
        lengths: list[int] = []
        for form, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            story = story_lines(form, gone)
            inner += story[:-1]
            if story and (m := CLOSED.match(story[-1])):
                inner.append(m[0])
            lengths += [min(len(x), LONGEST_LINE) for x in story[:-1] if not ENDED.search(x) and not ELLIPSIS.search(x) and not END_LINE.match(x)]
        words: set[str] = set()
        for at in range(0, len(inner), 20_000):
            words |= words_of("\n".join(inner[at : at + 20_000]) + "\n")
        yield pa.RecordBatch.from_arrays([pa.array([*words, *[None] * len(lengths)], pa.string()), pa.array([*[0] * len(words), *lengths], pa.int64())], names=["word", "n"])


class Trie:
    """A prefix tree of words."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = True

    def known(self, w: str) -> tuple[bool, bool]:
        """Whether w is a word, and whether it is a proper prefix of one."""
        node = self.root
        for c in w:
            node = node.get(c)
            if node is None:
                return False, False
        return "" in node, any(c for c in node)


def _look_up(key, tokens, words):
    import pandas as pd

    trie = Trie(words["word"])
    known = [trie.known(t) for t in tokens["token"]]
    return pd.DataFrame({"token": tokens["token"], "half": [part and not k for k, part in known]})


def longest_complete(lengths: dict[int, int]) -> int:
    """The length up to which an unpunctuated line is taken for a complete one, by the corpus's own lines; 80 where there are too few to tell."""
    total = sum(lengths.values())
    if total * RARE_TAIL < 1:
        return 80
    beyond = 0
    for n in sorted(lengths, reverse=True):
        beyond += lengths[n]
        if beyond > total * RARE_TAIL:
            return n
    return 80


def limits(facts: DataFrame, measure: str) -> DataFrame:
    """(source, kind, longest): the length of a source's longest texts of one kind, where enough different ones end there."""
    n = facts.groupBy("source", "kind", measure).agg(F.count_distinct("print").alias("n"))
    return n.groupBy("source", "kind").agg(F.max(F.struct(measure, "n")).alias("m")).filter(F.col("m.n") >= LIMIT_TEXTS).select("source", "kind", F.col(f"m.{measure}").alias(f"most_{measure}"))


def judged(df: DataFrame, id_col: str, text_col: str, source_col: str, kind_col: str, host_col: str | None = None) -> DataFrame:
    """(id, source, reason) for each row with text; reason is null for a whole text, else 'mark', 'length', 'trie' or 'sentence'.

    Null and empty texts give no row. Ids must be unique. With a host column, furniture that only repetition tells is
    left out as well.
    """
    pages = story_table(df, id_col, text_col, host_col, {"source": F.col(source_col), "kind": F.col(kind_col)})
    schema = "id long, source string, kind string, state string, token string, running boolean, length int, stated boolean, chars long, bytes long, print long"
    facts = stored(arrow_map(pages, schema, _facts))

    vocabulary = stored(pages.select("form", "out").mapInArrow(_vocabulary, "word string, n long").groupBy("word", "n").agg(F.count(F.lit(1)).alias("c")))
    most = longest_complete({r["n"]: r["c"] for r in vocabulary.filter("word is null").select("n", "c").collect()})  # at most LONGEST_LINE rows
    words = vocabulary.filter("word is not null").select("word", F.substring("word", 1, 2).alias("head"))
    asked = facts.filter("token <> ''").select("token").distinct().select("token", F.substring("token", 1, 2).alias("head"))
    # tokens, not rows, meet the words: a common ending is looked up once
    near = words.join(asked.select("head").distinct(), "head", "left_semi")
    looked = stored(asked.groupBy("head").cogroup(near.groupBy("head")).applyInPandas(_look_up, "token string, half boolean").filter("half").select("token", F.lit(True).alias("half")))

    ends = facts
    for m in ("chars", "bytes"):
        lim = stored(limits(facts, m).withColumn("at", F.struct("source", "kind")).drop("source", "kind"))
        ends = sized_join(ends.withColumn("at", F.struct("source", "kind")), lim, ["at"], F.col("id"), "left").drop("at")
    ends = sized_join(ends, looked, ["token"], F.col("id"), "left")
    learned = F.coalesce(F.col("chars") == F.col("most_chars"), F.lit(False)) | F.coalesce(F.col("bytes") == F.col("most_bytes"), F.lit(False))
    line = F.col("state") == "open"
    reason = (
        F.when(F.col("state") == "mark", "mark").when(F.col("state") == "whole", None).when(F.col("stated") | (line | (F.col("state") == "point")) & learned, "length")
        .when(F.col("half"), "trie").when(line & F.col("running"), "sentence").when(line & (F.col("length") > most), "length")
    )
    return ends.select("id", "source", reason.alias("reason"))


def truncated(df: DataFrame, id_col: str = "article_id", text_col: str = "content", source_col: str = "source", kind_col: str = "content_type", host_col: str | None = None) -> DataFrame:
    """(article_id) of each text whose main body breaks off."""
    return judged(df, id_col, text_col, source_col, kind_col, host_col).filter("reason is not null").select(F.col("id").alias("article_id"))


def share_by_source(df: DataFrame, id_col: str = "article_id", text_col: str = "content", source_col: str = "source", kind_col: str = "content_type", host_col: str | None = None) -> DataFrame:
    """(source, records, cut_records, cut_share) over rows with text; a null source is a group of its own."""
    j = judged(df, id_col, text_col, source_col, kind_col, host_col)
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("reason").alias("cut_records")).withColumn("cut_share", F.round(F.col("cut_records") / F.col("records"), 6))


def reasons(df: DataFrame, id_col: str = "article_id", text_col: str = "content", source_col: str = "source", kind_col: str = "content_type", host_col: str | None = None) -> DataFrame:
    """(reason, records): cut texts by the evidence that told them, and whole ones."""
    return judged(df, id_col, text_col, source_col, kind_col, host_col).groupBy(F.coalesce("reason", F.lit("whole")).alias("reason")).agg(F.count(F.lit(1)).alias("records"))
