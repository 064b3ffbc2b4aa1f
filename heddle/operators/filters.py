"""Row filters and the attribution of drops to the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_share(c: Column, char_class: str, head: int | None = None) -> Column:
    """Share of a text's first characters that are in a class such as \\p{IsHan}; null for an empty text."""
    t = F.substring(c, 1, head) if head else c
    return F.try_divide(F.length(F.regexp_replace(t, f"[^{char_class}]", "")).cast("double"), F.length(t).cast("double"))


def foreign(c: Column, char_class: str = r"\p{IsHan}", least: float = 0.15, head: int = 800, longer: int = 100) -> Column:
    """A text longer than `longer` with too small a share of the class."""
    return (F.length(c) > longer) & (char_share(c, char_class, head) < least)


def garbled(c: Column, runs: str = "Ã.|â€|ï¼|å|æ|ç", least: int = 3, head: int = 2000) -> Column:
    """At least `least` runs of wrongly decoded characters in the head."""
    return F.regexp_count(F.substring(c, 1, head), F.lit(runs)) >= least


def corrupt(c: Column) -> Column:
    """Two replacement characters, or more question marks than eight and a fifth of the text."""
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    lost = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return (lost >= 2) | (marks > F.greatest(F.lit(8), F.floor(F.length(c) / 5)))


def long_enough(c: Column, n: int) -> Column:
    return F.length(c) >= n


def relevant(c: Column, pattern: str, head: int = 3000) -> Column:
    return F.substring(c, 1, head).rlike(pattern)


def drowned(c: Column, own: str, other: str) -> Column:
    """Two or more hits of the other signal, and more of them than of one's own."""
    a, b = F.regexp_count(c, F.lit(own)), F.regexp_count(c, F.lit(other))
    return (b >= 2) & (b > a)


def keyword_hits(c: Column, words: list[str]) -> Column:
    """Words of a list that occur in a text, case aside, in the list's order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, F.lower(w)))


def core_or_context(c: Column, core: list[str], tech: list[str], context: list[str]) -> Column:
    """Core words, and technical words where a context word stands too; sorted, each once."""
    t = F.when(F.size(keyword_hits(c, context)) > 0, keyword_hits(c, tech)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(keyword_hits(c, core), t)))


def group_hits(c: Column, groups: list[dict]) -> Column:
    """Hits of keyword groups with all, any and exclude lists; a group counts only if its rules hold. First seen first."""
    parts = []
    for g in groups:
        all_, any_, ex = (keyword_hits(c, g.get(k) or [""]) if g.get(k) else F.array().cast("array<string>") for k in ("all", "any", "exclude"))
        ok = (F.size(all_) == len(g.get("all") or [])) & ((F.size(any_) > 0) if g.get("any") else F.lit(True)) & (F.size(ex) == 0)
        parts.append(F.when(ok, F.concat(all_, any_)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def relevance(title: Column, body: Column, strong: list[str], general: list[str], compute: list[str], infra: list[str], low: list[str], short: int = 120) -> Column:
    """Additive score of hits: strong words in the title weigh most, short texts lose, low-quality marks sink a record."""
    both = F.concat_ws(" ", title, body)
    n = lambda c, w: F.size(keyword_hits(c, w))
    return (
        n(title, strong) * 10 + n(both, strong) * 5 + n(both, general) * 2 + n(both, compute) * 3 + n(both, infra)
        + F.when(n(title, general) > 0, 8).otherwise(0) + F.when(n(title, compute) > 0, 6).otherwise(0)
        - F.when(F.length(body) < short, 8).otherwise(0) - F.when(n(both, low) > 0, 100).otherwise(0)
    )


def missing_fields(df: DataFrame, fields: list[str]) -> Column:
    """Names of the fields that are null or blank."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that drops a row, null if none does. A rule that is null doesn't drop."""
    out = None
    for name, bad in rules:
        out = F.when(F.coalesce(bad, F.lit(False)), name) if out is None else out.when(F.coalesce(bad, F.lit(False)), name)
    return out


def sane(x: Column, limit: float) -> Column:
    """The value if its size is at most the limit, else null."""
    return F.when(F.abs(x) <= limit, x)
