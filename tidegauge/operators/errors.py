"""Forecast errors, leaderboards and interval quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import absolute_percentage, floored, repaired_quantiles


def error_columns(actual: str, predicted: str, prefix: str = "", percent: bool = True) -> list[Column]:
    """MAE, RMSE and sMAPE. ``percent`` scales by 100 and leaves 0/0 out; otherwise 0/0 counts as no error."""
    miss = F.col(predicted) - F.col(actual)
    share = absolute_percentage(F.col(actual), F.col(predicted), zero_counts=not percent)
    return [
        F.avg(F.abs(miss)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(miss * miss)).alias(f"{prefix}rmse"),
        (F.avg(share) * (100.0 if percent else 1.0)).alias(f"{prefix}smape"),
    ]


def scenario_errors(forecasts: DataFrame, keys: Sequence[str], percent: bool = True) -> DataFrame:
    """One row of capacity and health errors per scenario and model."""
    return forecasts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *error_columns("y_true_capacity", "y_pred_capacity", "capacity_", percent),
        *error_columns("y_true_soh", "y_pred_soh", "soh_", percent),
    )


def leaderboard(errors: DataFrame, keys: Sequence[str], scenario: Sequence[str] = ("cell_id", "scenario_id")) -> DataFrame:
    """Mean and spread of scenario errors per model."""
    return errors.groupBy(*keys).agg(
        F.countDistinct(*scenario).alias("scenario_count"),
        F.avg("capacity_mae").alias("capacity_mae_mean"), F.stddev_samp("capacity_mae").alias("capacity_mae_std"),
        F.avg("capacity_rmse").alias("capacity_rmse_mean"), F.avg("capacity_smape").alias("capacity_smape_mean"),
        F.avg("soh_mae").alias("soh_mae_mean"),
    )


def errors_by(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Capacity error by horizon, lead or any other column."""
    miss = F.abs(F.col("y_pred_capacity") - F.col("y_true_capacity"))
    return forecasts.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(miss).alias("capacity_mae"))


def with_intervals(forecasts: DataFrame, low: Column, high: Column) -> DataFrame:
    """Attach repaired capacity and health quantiles; point models leave the outer ones NULL."""
    capacity = repaired_quantiles(low, F.col("y_pred_capacity"), high)
    named = forecasts.select("*", *[column.alias(f"y_pred_capacity_{q}") for q, column in capacity.items()])
    return named.select("*", *[
        floored(F.col(f"y_pred_capacity_{q}") / F.nullif(F.col("initial_capacity"), F.lit(0.0)), 0.0).alias(f"y_pred_soh_{q}")
        for q in capacity
    ])


def interval_quality(forecasts: DataFrame, keys: Sequence[str], actual: str = "y_true_capacity",
                     low: str = "y_pred_capacity_q10", high: str = "y_pred_capacity_q90") -> DataFrame:
    """Coverage (bounds included), mean width and misses on either side, over rows that have an interval."""
    covered = F.col(actual).between(F.col(low), F.col(high))
    return forecasts.filter(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(covered.cast("int")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
        F.avg((F.col(actual) < F.col(low)).cast("int")).alias("below_share"),
        F.avg((F.col(actual) > F.col(high)).cast("int")).alias("above_share"),
    )


def target_variants(
    series: DataFrame, columns: dict[str, str], keep: Sequence[str], beside: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Long table of target variants of the same series; ``beside`` names further columns, and where each target has its own."""
    cells = F.array(*[
        F.struct(F.lit(name).alias("target_name"), F.col(c).alias("target"), *[F.col(own[name]).alias(n) for n, own in (beside or {}).items()])
        for name, c in columns.items()
    ])
    return series.select(*keep, F.explode(cells).alias("v")).select(*keep, "v.*")
