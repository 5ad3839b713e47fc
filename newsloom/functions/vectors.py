"""Vector and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is zero."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def inner_product(a: Column, b: Column) -> Column:
    return _dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def clamp01(x: Column, default: Column | None = None) -> Column:
    """A number within 0 and 1; the default (0.0) for what is none."""
    number = x.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(F.lit(0.0) if default is None else default)


def recency(days: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + days / F.lit(30.0))


def scaled(x: Column, low: float, high: float, reverse: bool = False, compat: bool = True) -> Column:
    """Min-max scaling clamped to 0..1. compat keeps the reverse scale's rule, which rewards high values."""
    if reverse and compat:
        x, low, high = F.lit(low + high) - x, low, high
    elif reverse:
        low, high = max(low, high), min(low, high)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.lit(float(high - low))))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return tokens_in / F.lit(1e6) * price_in + tokens_out / F.lit(1e6) * price_out


def should_rerank(query: Column, top_scores: Column) -> Column:
    """Questions of over five words, or whose top three scores spread by under 0.002 (population deviation)."""
    top = F.slice(top_scores, 1, 3)
    n = F.size(top).cast("double")
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(F.transform(top, lambda x: F.pow(x - mean, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / n)
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return (words > 5) | F.coalesce(spread < 0.002, F.lit(False))
