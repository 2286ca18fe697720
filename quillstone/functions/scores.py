"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def confidence(c: Column) -> Column:
    """A number clamped to [0, 1] and rounded to six places; null and NaN are null."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6))


def min_max(c: Column, *by: str) -> Column:
    """Scaled to [0, 1] within ``by``; 0 for all if all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(F.abs(high - low) <= 1e-15, 0.0).otherwise((c - low) / (high - low))


def blend(weight: float | Column, a: Column, b: Column) -> Column:
    """``weight`` of a and the rest of b."""
    return weight * a + (1 - weight) * b


def support_bucket(c: Column, tail_max: int = 5, head_min: int = 21) -> Column:
    return F.when(c <= tail_max, "tail").when(c >= head_min, "head").otherwise("mid")


def hit_bucket(rank: Column) -> Column:
    """Where the first hit stands; null is a miss."""
    return (
        F.when(rank.isNull(), "miss").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= 5, "4-5")
        .when(rank <= 10, "6-10").when(rank <= 20, "11-20").otherwise(">20")
    )


def token_budget(requested: Column, candidates: Column, attempt: Column) -> Column:
    """Completion tokens for a reranking call: at least 1000 and 70 a candidate, a quarter more each attempt, at most 6000."""
    base = F.greatest(requested, 1000 + 70 * candidates).cast("double")
    return F.least(F.lit(6000), F.ceil(base * F.pow(F.lit(1.25), attempt)).cast("int"))


def split_target(support: Column, part: int, whole: int, least: int = 2) -> Column:
    """Wanted count of a label on the smaller side: half-even rounding, at least 1 and not all, 0 for rare labels."""
    want = F.bround(support * part / F.lit(whole), 0).cast("int")
    return F.when(support >= least, F.greatest(F.lit(1), F.least(support.cast("int") - 1, want))).otherwise(0)


def within(c: Column, low: float, high: float, open_end: bool = False) -> Column:
    """A number of the range, or null; NaN and infinity are in no range."""
    ok = c.isNotNull() & ~F.isnan(c) & (c >= low) & ((c < high) if open_end else (c <= high)) & (F.abs(c) < float("inf"))
    return F.when(ok, c)
