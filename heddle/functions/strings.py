"""String, URL and hash functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a reader.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "spm", "from", "share_token")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


# Every white-space character of Unicode, and marks without width.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"


def clean_text(c: Column) -> Column:
    """One line: control characters, short tags and marks without width go, white space collapses."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"<[^<>]{0,200}>", "")
    c = F.regexp_replace(c, f"[{NO_WIDTH}]", "")
    return F.regexp_replace(F.regexp_replace(c, f"[{SPACES}]+", " "), r"^ | $", "")


def clean_lines(c: Column) -> Column:
    """Keeps line breaks: spaces within lines collapse, at most one blank line stays between lines."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t\xa0\u3000]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^[\n ]+|[\n ]+$", "")


def tags_to_space(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^<>]{0,200}>", " "), f"[{SPACES}]+", " "), r"^ | $", "")


def match_title(c: Column) -> Column:
    """Lower case, ideographs, kana and ASCII letters and digits only."""
    return F.lower(F.regexp_replace(c, "[^0-9A-Za-z\u3040-\u30ff\u4e00-\u9fff]", ""))


def fingerprint_text(c: Column) -> Column:
    """Lower case, letters and digits of any script only."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def short_id(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def host(url: Column) -> Column:
    """Lower-case host without user, port and a leading www.; null unless http or https."""
    h = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"^www\.", ""), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; tracking parameters, fragment, doubled and final slashes gone. Null unless http(s)."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", k)
    path = F.regexp_replace(F.regexp_replace(part(3), r"/{2,}", "/"), r"/+$", "")
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    query = F.array_join(kept, "&")
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.lower(part(1)).isin("http", "https"), out)


def source_name(source: Column, url: Column, path: Column) -> Column:
    """The source, else the URL's host, else 'corpus:' and the first 24 characters of the path's first segment."""
    return F.coalesce(blank_to_null(source), host(url), F.concat(F.lit("corpus:"), F.substring(F.split(path, "/")[0], 1, 24)))


def made_title(text: Column) -> Column:
    """The first sentence, or the first 80 characters if it has fewer than 6; at most 120 characters."""
    first = F.trim(F.regexp_extract(text, r"^[^。！？!?\n]*[。！？!?]?", 0))
    return F.substring(F.when(F.length(first) < 6, F.substring(text, 1, 80)).otherwise(first), 1, 120)


def record_key(id_: Column, url: Column, title: Column, date: Column, content: Column) -> Column:
    """Id, else URL, else title with date, else the content's hash; prefixed by kind."""
    return F.coalesce(
        F.concat(F.lit("id:"), blank_to_null(id_)),
        F.concat(F.lit("url:"), blank_to_null(url)),
        F.concat(F.lit("td:"), blank_to_null(title), F.lit("|"), date.cast("string")),
        F.concat(F.lit("c:"), F.md5(F.coalesce(content, F.lit("")))),
    )


def unwrap_base64url(c: Column) -> Column:
    """Decodes base64url text; null where it is not."""
    b = F.translate(c, "-_", "+/")
    b = F.concat(b, F.repeat(F.lit("="), F.pmod(-F.length(b), F.lit(4))))
    return F.decode(F.try_to_binary(b, F.lit("base64")), "UTF-8")


def nfkc(c: Column) -> Column:
    """Compatibility form with HTML entities resolved and the byte order mark gone; Spark has no built-in for it, so it runs on Arrow batches."""
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", html.unescape(x)).replace("﻿", ""), na_action="ignore")

    return form(c)
