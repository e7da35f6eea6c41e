"""Preprocessing fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import row_numbers


def fit_scaler(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """One row with the fill value and scale of every column.

    Gaps are filled with the mean, which adds nothing to the spread but counts as a row. A column without
    any value is filled with 0, and a column without spread is divided by 1.
    """
    stats = [
        F.struct(
            F.coalesce(F.avg(c), F.lit(0.0)).alias("fill"),
            F.coalesce(F.nullif(F.stddev_pop(c) * F.sqrt(F.count(c) / F.count("*")), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        ).alias(c)
        for c in numeric
    ]
    return train.agg(*stats)


def apply_scaler(df: DataFrame, fitted: DataFrame, numeric: Sequence[str]) -> DataFrame:
    stats = fitted.select(F.struct(*numeric)).scalar()
    with_stats = df.withColumn("_fit", stats)
    return with_stats.select(
        *[c for c in df.columns if c not in numeric],
        *[
            ((F.coalesce(F.col(c).cast("double"), F.col(f"_fit.{c}.fill")) - F.col(f"_fit.{c}.fill"))
             / F.col(f"_fit.{c}.scale")).alias(c)
            for c in numeric
        ],
    )


def fit_codes(train: DataFrame, column: str) -> DataFrame:
    """Codes 1..k of the categories seen in training, in value order."""
    seen = train.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("category")).distinct()
    return row_numbers(seen, [], ["category"], "code")


def apply_codes(df: DataFrame, codes: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Unseen and missing categories get code 0."""
    named = codes.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    joined = df.join(named, F.col(column).cast("string") == F.col("_category"), "left")
    return joined.withColumn(name or f"{column}_code", F.coalesce("_code", F.lit(0))).drop("_category", "_code")


def ranked_contributions(df: DataFrame, contributions: Sequence[str], k: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, the k largest."""
    means = df.agg(*[F.avg(F.abs(c)).alias(c) for c in contributions])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs")) for c in contributions]
    return means.select(F.explode(F.array(*cells)).alias("f")).select("f.*").orderBy(F.desc("mean_abs"), "feature").limit(k)


def top_features(contributions: Sequence[str], n: int = 3) -> Column:
    """Text with a row's n strongest features and the sign of each, built inside the row."""
    named = [
        F.struct((-F.abs(F.col(c))).alias("weight"), F.lit(i).alias("place"), F.lit(c).alias("feature"),
                 F.when(F.col(c) > 0, "+").otherwise("-").alias("sign"))
        for i, c in enumerate(contributions)
    ]
    strongest = F.slice(F.array_sort(F.array(*named)), 1, n)
    return F.array_join(F.transform(strongest, lambda f: F.concat(f["feature"], F.lit("("), f["sign"], F.lit(")"))), ", ")


def risk_table(scored: DataFrame, keys: Sequence[str], probability: str, contributions: Sequence[str], k: int = 15) -> DataFrame:
    """The k rows most at risk with their strongest features; ties by key."""
    first = scored.orderBy(F.desc(probability), *keys).limit(k)
    return first.select(*keys, F.bround(probability, 3).alias("prob"), top_features(contributions).alias("top_features"))


def stable_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows, the same ones on every run: those with the least digest of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.orderBy(digest, *keys).limit(n)
