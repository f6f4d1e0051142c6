"""Numeric functions: probabilities, scores, budgets, intensities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Stable logistic function; the input is clipped to +-40."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x.cast("double")))))


def clean_probability(p: Column) -> Column:
    """NaN, infinities and null as 0 (positive infinity as 1), then clipped to [0, 1]."""
    return F.when(p.isNull() | F.isnan(p), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def fused_score(model: Column, area: Column, box_area: Column, outside: Column, raw_area: Column, multiclass: Column, bonus: float = 0.05, spill: float = 0.5) -> Column:
    """Model score, plus a bonus for the part of the box that is filled, minus a charge for the part that spills.

    For binary data bonus and charge are at least 0.10 and 0.80.
    """
    plus = F.when(multiclass, F.lit(bonus)).otherwise(F.lit(max(bonus, 0.10)))
    minus = F.when(multiclass, F.lit(spill)).otherwise(F.lit(max(spill, 0.80)))
    filled = F.least(F.lit(1.0), area / F.greatest(box_area, F.lit(1.0)))
    return model + plus * filled - minus * (outside / F.greatest(raw_area, F.lit(1.0)))


def quota_2d(n: Column) -> Column:
    """Images to annotate in a round: one in a hundred, rounded up, 1 to 5."""
    return F.least(F.greatest(F.lit(1), F.ceil(n / 100.0)), F.lit(5), n).cast("bigint")


def cap_2d(n: Column) -> Column:
    """Images that may be annotated in all: 5 %, rounded up, at most five rounds."""
    return F.least(F.greatest(F.lit(1), F.ceil(n * 5 / 100.0)), 5 * quota_2d(n)).cast("bigint")


def quota_3d(n: Column) -> Column:
    """Cases to annotate in a round: 1 %, rounded up, at least 5, within the cases there are."""
    return F.least(F.greatest(F.ceil(n / 100.0), F.lit(5)), n).cast("bigint")


def cap_3d(n: Column) -> Column:
    """Cases that may be annotated in all: 5 %, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(n * 5 / 100.0)).cast("bigint")


def nearest_budget(n: Column, percent: int = 5) -> Column:
    """A percentage of n to the nearest integer, halves up, at least one; null for n <= 0."""
    return F.when(n > 0, F.greatest(F.lit(1), F.floor((n * percent + 50) / 100.0))).cast("bigint")


def safe_double(s: Column, default: float) -> Column:
    """A number from text, or the default."""
    return F.coalesce(s.try_cast("double"), F.lit(default))


def window_scale(v: Column, low: float, high: float) -> Column:
    """Clipped to [low, high] and scaled to [0, 1]."""
    return (F.greatest(F.lit(low), F.least(F.lit(high), v)) - low) / (high - low)
