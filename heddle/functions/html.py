"""Text, dates and links out of HTML pages, with the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "nav", "footer", "aside", "header", "noscript", "form"}
VOID = {"br", "img", "meta", "link", "hr", "input", "source", "area", "col", "embed", "wbr"}
# Where pages state titles and dates.
TITLE_META = ("og:title", "twitter:title", "title")
DATE_META = ("article:published_time", "og:published_time", "pubdate", "publishdate", "date", "datepublished", "publish_time")
BODY_CLASSES = re.compile(r"(^|[\s_-])(article|content|post|entry|main|story)([\s_-]|$)", re.I)


class Page(HTMLParser):
    """One pass over a page: metas, titles, headings, candidate bodies, paragraphs, links and JSON-LD blocks."""

    def __init__(self, html: str, base: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.metas: dict[str, str] = {}
        self.times: list[str] = []
        self.title = self.h1 = ""
        self.paragraphs: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.ld: list[str] = []
        self.bodies: list[str] = []
        self._base = base
        self._skip = 0
        self._stack: list[tuple[str, list[str] | None]] = []
        self._in: dict[str, list[str] | None] = {"title": None, "h1": None, "p": None, "ld": None}
        self._href: tuple[str, list[str]] | None = None
        try:
            self.feed(html)
            self.close()
        except Exception:  # a broken page yields what was read
            pass
        for tag, buf in self._stack:
            if buf:
                self.bodies.append(_join(buf))

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if key and a.get("content") and key not in self.metas:
                self.metas[key] = a["content"].strip()
        if tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"].strip())
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self._in["ld"] = []
        if tag == "a" and a.get("href"):
            self._href = (urljoin(self._base, a["href"]), [])
        if tag in VOID:
            return
        if tag in SKIPPED:
            self._skip += 1
        if tag in ("title", "h1", "p"):
            self._in[tag] = []
        body = tag in ("article", "main") or (tag in ("div", "section") and BODY_CLASSES.search(a.get("class", "") + " " + a.get("id", "")))
        self._stack.append((tag, [] if body and not self._skip else None))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._in["ld"] is not None:
            self.ld.append("".join(self._in["ld"]))
            self._in["ld"] = None
        if tag in SKIPPED and self._skip:
            self._skip -= 1
        for key in ("title", "h1", "p"):
            if tag == key and self._in[key] is not None:
                text = _join(self._in[key])
                self._in[key] = None
                if key == "p":
                    if text and not self._skip:
                        self.paragraphs.append(text)
                elif text and not getattr(self, key):
                    setattr(self, key, text)
        if tag == "a" and self._href:
            self.links.append((self._href[0], _join(self._href[1])))
            self._href = None
        while self._stack:
            t, buf = self._stack.pop()
            if buf:
                self.bodies.append(_join(buf))
                for _, outer in reversed(self._stack):
                    if outer is not None:
                        outer += buf
                        break
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self._in["ld"] is not None:
            self._in["ld"].append(data)
            return
        if self._href:
            self._href[1].append(data)
        for key in ("title", "h1", "p"):
            if self._in[key] is not None:
                self._in[key].append(data)
        if not self._skip:
            for _, buf in reversed(self._stack):
                if buf is not None:
                    buf.append(data)
                    break


def _join(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def title_of(p: Page) -> str | None:
    """og:title, other title metas, the first h1, the title element."""
    for k in TITLE_META:
        if p.metas.get(k):
            return p.metas[k]
    return p.h1 or p.title or None


def date_of(p: Page, url: str) -> str | None:
    """Date metas, JSON-LD, time elements, a date in the URL; as yyyy-mm-dd."""
    for x in [*(p.metas[k] for k in DATE_META if k in p.metas), *(str(o.get("datePublished", "")) for o in ld_objects(p)), *p.times, url or ""]:
        m = re.search(r"(20\d\d|19\d\d)[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})", x or "")
        if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31:
            return f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"
    return None


def ld_objects(p: Page) -> list[dict]:
    """JSON-LD objects of a page, @graph flattened."""
    out, todo = [], []
    for block in p.ld:
        try:
            todo.append(json.loads(block))
        except ValueError:
            continue
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            if isinstance(x.get("@graph"), list):
                todo = x["@graph"] + todo
            if x.get("@type"):
                out.append(x)
    return out


def content_of(p: Page, least: int = 80, least_paragraph: int = 15) -> str:
    """The longest candidate body of at least `least` characters, else the paragraphs joined."""
    good = [b for b in p.bodies if len(b) >= least]
    return max(good, key=len) if good else "\n".join(x for x in p.paragraphs if len(x) >= least_paragraph)


def pages(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, title, day, body, headline, publisher): null pages give nulls."""
    schema = "url string, title string, day string, body string, headline string, publisher string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h is None:
                    rows.append((u, None, None, None, None, None))
                    continue
                p = Page(h, u or "")
                ld = next(iter(ld_objects(p)), {})
                pub = ld.get("publisher")
                rows.append((u, title_of(p), date_of(p, u or ""), content_of(p), ld.get("headline"), pub.get("name") if isinstance(pub, dict) else pub))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["url", "title", "day", "body", "headline", "publisher"])

    return df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema)


def links(df: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, link, text) of every anchor, links made absolute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, link, text) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if h for link, text in Page(h, u or "").links]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in cols], names=["url", "link", "text"])

    return df.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "url string, link string, text string")
