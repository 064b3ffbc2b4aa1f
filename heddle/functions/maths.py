"""Arithmetic and scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds a value; null stays null."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def balance(a: Column, b: Column, eps: float = EPS) -> Column:
    return (a - b) / (a + b + F.lit(eps))


def balance_or_null(a: Column, b: Column) -> Column:
    return F.try_divide((a - b).cast("double"), F.nullif((a + b).cast("double"), F.lit(0.0)))


def density(hits: Column, tokens: Column) -> Column:
    """Hits against 2 % of the tokens plus 3, at most 1."""
    return F.least(F.lit(1.0), hits / (tokens * 0.02 + 3))


def three_way(x: Column, t: float) -> Column:
    return F.when(x > t, 1).when(x < -t, -1).otherwise(0)


def first_argmax(names: list[str], scores: list[Column], none: Column | None = None) -> Column:
    """Index of the largest score, ties to the first; -1 where all are zero or below."""
    top = F.greatest(*scores)
    out = F.lit(-1)
    for i in range(len(scores) - 1, -1, -1):
        out = F.when(scores[i] == top, i).otherwise(out)
    return F.when(top > 0, out).otherwise(-1) if none is None else F.when(none, -1).otherwise(out)


def lexical_score(rel: Column, intensity: Column, orient: Column, tone: Column) -> Column:
    return rel * F.log1p(F.greatest(intensity, F.lit(0.0))) * orient * tone


def composed_score(rel: Column, intensity: Column, g: Column, c: Column, pos: Column, neg: Column, sub: Column, comp: Column, kappa: float = 0.5) -> Column:
    return rel * F.log1p(intensity) * (g - c) * (pos - neg) * (1 + kappa * (sub - comp))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(xs: Column) -> Column:
    """Place of the largest element, from 0; ties to the first."""
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def largest_quantity(text: Column, units: dict[str, float], words: list[str]) -> Column:
    """log10(1 + the largest number scaled by its unit) plus half a point for each intensity word present."""
    pat = r"(\d+(?:\.\d+)?)\s*(" + "|".join(sorted(units, key=len, reverse=True)) + ")?"
    nums, us = F.regexp_extract_all(text, F.lit(pat), F.lit(1)), F.regexp_extract_all(text, F.lit(pat), F.lit(2))
    scale = F.create_map(*[F.lit(v) for kv in units.items() for v in kv])
    vals = F.zip_with(nums, us, lambda n, u: n.try_cast("double") * F.coalesce(F.try_element_at(scale, u), F.lit(1.0)))
    words_n = sum((F.when(text.contains(w), 0.5).otherwise(0.0) for w in words), F.lit(0.0))
    return F.log10(F.coalesce(F.array_max(vals), F.lit(0.0)) + 1) + words_n


def standard_error(coef: Column, t: Column) -> Column:
    return F.try_divide(F.abs(coef), F.abs(t))
