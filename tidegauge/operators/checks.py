"""Contracts a table must keep. Each returns the offending rows; no rows means it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.sources.sinks import difference


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def gaps_in_numbering(df: DataFrame, key: str, number: str) -> DataFrame:
    """Keys whose numbers are not exactly first..last without a hole or repeat."""
    spans = df.groupBy(key).agg(
        F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"),
    )
    return spans.filter(F.col("last") - F.col("first") + 1 != F.col("n"))


def uncovered(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(present, list(keys), "left_anti")


def differing_truth(forecasts: DataFrame, keys: Sequence[str], truth: str) -> DataFrame:
    """Steps on which models were scored against different values."""
    return forecasts.groupBy(*keys).agg(
        F.min(truth).alias("low"), F.max(truth).alias("high"), F.count(truth).alias("n")
    ).filter(F.col("low") != F.col("high"))


def wrong_row_counts(forecasts: DataFrame, scenarios: DataFrame, keys: Sequence[str], model: str,
                     models: Sequence[str] | None = None) -> DataFrame:
    """Scenario and model pairs whose rows do not match the horizon, pairs without any rows among them.

    Every scenario is expected of every one of ``models``; without the list, of every model in ``forecasts`` (their names
    are few and are listed first).
    """
    if models is None:
        models = sorted(row[0] for row in forecasts.select(model).distinct().collect() if row[0] is not None)
    frame = scenarios.select(*keys, "horizon").distinct().withColumn(model, F.explode(F.array(*[F.lit(m) for m in models])))
    counted = forecasts.groupBy(*keys, model).agg(F.count("*").alias("_found"))
    return frame.join(counted, [*keys, model], "left").withColumn("found", F.coalesce("_found", F.lit(0))).drop("_found").filter(
        F.col("found") != F.col("horizon"))


def broken_quantiles(forecasts: DataFrame, low: str, mid: str, high: str) -> DataFrame:
    """Rows with crossed or negative quantiles; missing ones cannot break the order."""
    order = (F.col(low) > F.col(mid)) | (F.col(mid) > F.col(high))
    negative = (F.col(low) < 0) | (F.col(mid) < 0) | (F.col(high) < 0)
    return forecasts.filter(F.coalesce(order, F.lit(False)) | F.coalesce(negative, F.lit(False)))


def leaked_rows(before: DataFrame, after: DataFrame, day: str, cutoff) -> DataFrame:
    """Feature rows up to ``cutoff`` that changed although only later measurements were altered."""
    return difference(before.filter(F.col(day) <= cutoff), after.filter(F.col(day) <= cutoff))
