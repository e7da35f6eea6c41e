"""Scalar column expressions. Each takes and returns Columns and stays inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DAYS_PER_YEAR = 365.25


def number(text: Column) -> Column:
    """Text to double; empty text, sentinels such as "below limit" and NaN become NULL."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def finite(value: Column) -> Column:
    """NaN to NULL, so that comparisons and sums treat it as missing."""
    return F.when(~F.isnan(value), value)


def parsed_date(text: Column, pattern: str) -> Column:
    """Text to date; text that does not match becomes NULL."""
    return F.try_to_date(text, pattern)


def truth(condition: Column) -> Column:
    """A comparison with a missing operand counts as false."""
    return F.coalesce(condition, F.lit(False))


def reaches(value: Column, threshold: float) -> Column:
    """Inclusive exceedance as 0/1; NULL stays NULL."""
    return (value >= F.lit(threshold)).cast("int")


def reaches_or_zero(value: Column, threshold: float) -> Column:
    """Inclusive exceedance where a missing value counts as "not reached"."""
    return F.coalesce(reaches(value, threshold), F.lit(0))


def ordinal_stage(value: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds the value reaches; a missing value reaches none."""
    stage = F.lit(0)
    for threshold in thresholds:
        stage = stage + reaches_or_zero(value, threshold)
    return stage


def stage_from_probabilities(p_low: Column, p_high: Column, tau: float = 0.5) -> Column:
    """Ordinal stage from two cumulative probabilities, the higher one capped by the lower."""
    return (p_low >= tau).cast("int") + (capped(p_high, p_low) >= tau).cast("int")


def capped(value: Column, limit: Column) -> Column:
    """The smaller of both; NULL if either is NULL."""
    return F.when(value.isNotNull() & limit.isNotNull(), F.least(value, limit))


def floored(value: Column, limit: float = 0) -> Column:
    """The larger of value and limit; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(limit)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def risk_level(health: Column, critical_below: Column | float = 0.80, warning_below: float = 0.90) -> Column:
    return (
        F.when(health < critical_below, "critical")
        .when(health < warning_below, "warning")
        .when(health.isNotNull(), "normal")
    )


def event_status(actual: Column, predicted: Column) -> Column:
    return (
        F.when(actual & predicted, "true_positive")
        .when(actual, "false_negative")
        .when(predicted, "false_positive")
        .otherwise("true_negative")
    )


def calendar(day: Column, season_months: Sequence[int] = (5, 6, 7, 8, 9, 10)) -> dict[str, Column]:
    """Calendar features of the row's own date."""
    angle = F.lit(2.0) * F.pi() * F.dayofyear(day) / F.lit(DAYS_PER_YEAR)
    return {
        "month": F.month(day),
        "weekofyear": F.weekofyear(day),
        "doy_sin": F.sin(angle),
        "doy_cos": F.cos(angle),
        "is_season": F.month(day).isin(*season_months).cast("int"),
    }


def log_bucket(value: Column, width: float) -> Column:
    """Histogram bin of log10(value + 1)."""
    return F.floor(F.log10(value + 1) / F.lit(width)).cast("int")


def absolute_percentage(actual: Column, predicted: Column, zero_counts: bool) -> Column:
    """Symmetric percentage error as a fraction.

    ``zero_counts`` decides what 0/0 is: an error of 0 that enters the mean, or a row that is left out.
    """
    scale = F.abs(actual) + F.abs(predicted)
    error = F.lit(2.0) * F.abs(predicted - actual) / F.nullif(scale, F.lit(0.0))
    return F.when(scale == 0, F.lit(0.0)).otherwise(error) if zero_counts else error


def repaired_quantiles(q10: Column, q50: Column, q90: Column) -> dict[str, Column]:
    """Non-negative quantiles with q10 <= q50 <= q90; missing outer quantiles stay missing."""
    low, mid, high = floored(q10), floored(q50), floored(q90)
    return {
        "q10": capped(low, mid),
        "q50": mid,
        "q90": F.when(high.isNotNull() & mid.isNotNull(), F.greatest(high, mid)),
    }


def file_date(name: Column) -> Column:
    """Date from a file name that carries ``_MM_DD_YY``; NULL without one."""
    parts = [F.regexp_extract(name, r"^.*_(\d{1,2})_(\d{1,2})_(\d{2})(?:\D|$)", i) for i in (1, 2, 3)]
    month, day, year = (F.lpad(p, 2, "0") for p in parts)
    return F.when(parts[0] != "", F.try_to_date(F.concat(F.lit("20"), year, month, day), "yyyyMMdd"))


def status_text(status: Column) -> Column:
    return F.replace(status, F.lit("_"), F.lit(" "))
