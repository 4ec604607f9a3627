"""Column builders for numbers: similarity, confidence, bonuses and rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, EXPLORATORY = 0.60, 0.35
# Star tiers and their bounds.
STAR_TIERS = [("star-lt100", 0, 99), ("star-100-999", 100, 999), ("star-1k-9k", 1_000, 9_999), ("star-10k-49k", 10_000, 49_999), ("star-50k-plus", 50_000, 10**12)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero; vectors of different lengths are an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.concat_ws(" ", F.lit("vector lengths differ:"), F.size(a), F.size(b)))).otherwise(dot(a, b))
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(checked / both)


def normalised(a: Column) -> Column:
    """a over its norm; zero vectors stay zero."""
    # The norm is bound in an array, or it would be summed for each component.
    whole = F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n)))
    return F.get(whole, 0)


def confidence(score: Column, threshold: float = EXPLORATORY) -> Column:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("the exploratory threshold is a number from 0 to 1")
    return F.when(score >= HIGH, "high_confidence").when(score >= threshold, "exploratory").otherwise("abstain")


def number(value: Column) -> Column:
    """A number from text with thousands commas, or null."""
    return F.try_cast(F.replace(F.trim(value.cast("string")), F.lit(","), F.lit("")), "double") if hasattr(F, "try_cast") else F.replace(F.trim(value.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def popularity(stars: Column) -> Column:
    return F.when(F.coalesce(stars, F.lit(0.0)) > 0, F.least(F.lit(0.015), F.log10(stars + 1.0) * 0.0025)).otherwise(0.0)


def state_penalty(archived: Column, disabled: Column) -> Column:
    return F.when(archived.eqNullSafe(True), 0.08).otherwise(0.0) + F.when(disabled.eqNullSafe(True), 0.12).otherwise(0.0)


def rounded(value: Column, places: int = 6) -> Column:
    """A double to so many places (8 at most) by its exact binary value, ties to even, as the nearest double: what Python's round gives.

    Spark's own functions round the shortest decimal that names the double. Here
    the product with 10^places is taken with its error (halves of 26 and 27 bits
    multiply exactly), so the comparison of the fraction with a half is exact.
    """
    if not 0 <= places <= 8:
        raise ValueError("places are 0 to 8")
    x, scale = F.abs(value.cast("double")), 10.0**places
    whole = F.when(x < 2.0 ** (51 - math.ceil(places * math.log2(10))), F.lit(0.0)).otherwise(F.floor(x).cast("double"))
    part = x - whole  # exact: what is left of large values has few bits
    split = part * F.lit(134217729.0)
    high = split - (split - part)
    product = part * F.lit(scale)
    error = (high * F.lit(scale) - product) + (part - high) * F.lit(scale)
    below = F.floor(product).cast("double")
    over = ((product - below) - F.lit(0.5)) + error
    up = (over > 0) | ((over == 0) & (F.pmod(below, F.lit(2.0)) == 1.0))
    out = whole + F.when(up, below + 1.0).otherwise(below) / F.lit(scale)
    return F.when(F.isnan(x) | (x >= 2.0**52), value.cast("double")).otherwise(F.when(F.signum(value.cast("double")) < 0, -out).otherwise(F.when(x == 0, value.cast("double")).otherwise(out)))


def ratio(a: Column, b: Column) -> Column:
    """a / b to 6 places, as Python rounds; 0 where b is 0 or either is null."""
    return rounded(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)))


def star_tier(stars: Column) -> Column:
    out = None
    for name, low, high in STAR_TIERS:
        hit = stars.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("star-unknown")
