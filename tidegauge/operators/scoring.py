"""Scores of imbalanced classifiers and ordinal stages, from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import ratio
from tidegauge.operators.ordered import running_totals


def score_curve(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Cumulative counts from the highest score down, one row per distinct score; a missing score is 0."""
    graded = df.select(*keys, F.col(label).cast("long").alias("y"), F.coalesce(F.col(score), F.lit(0.0)).alias("score"))
    counts = graded.groupBy(*keys, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    sums = {"pos_through": F.col("pos"), "n_through": F.col("n")}
    return running_totals(counts, keys, [F.desc("score")], sums, totals=True)


def evaluate(df: DataFrame, keys: Sequence[str], label: str, score: str, precision_floor: float = 0.5) -> DataFrame:
    """Average precision, ROC area and best recall at a precision floor; NULL where only one class is present."""
    curve = score_curve(df, keys, label, score)
    precise = F.col("pos_through") / F.col("n_through") >= precision_floor
    sums = curve.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sum(F.col("pos") * F.col("pos_through") / F.col("n_through")).alias("_ap"),
        F.sum((F.col("n") - F.col("pos")) * (F.col("pos_through") - F.col("pos") / 2)).alias("_auc"),
        F.max(F.when(precise, F.col("pos_through"))).alias("_best"),
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return sums.select(
        *keys, "n", "pos",
        F.when(both, F.col("_ap") / F.col("pos")).alias("pr_auc"),
        F.when(both, F.col("_auc") / (F.col("pos") * (F.col("n") - F.col("pos")).cast("double"))).alias("roc_auc"),
        F.when(both, F.coalesce(F.col("_best") / F.col("pos"), F.lit(0.0))).alias("recall_at_p50"),
    )


def precision_recall_points(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    return score_curve(df, keys, label, score).select(
        *keys, "score", (F.col("pos_through") / F.col("n_through")).alias("precision"),
        ratio(F.col("pos_through"), F.col("pos_through_total")).alias("recall"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, stages: int = 3) -> DataFrame:
    """Full confusion matrix: one row per true stage, a column per predicted stage, zeros included."""
    counts = df.agg(*[
        F.count_if((F.col(actual) == i) & (F.col(predicted) == j)).alias(f"_{i}_{j}")
        for i in range(stages) for j in range(stages)
    ])
    rows = [
        F.struct(F.lit(i).alias("stage"), *[F.col(f"_{i}_{j}").alias(f"predicted_{j}") for j in range(stages)])
        for i in range(stages)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def evaluate_stages(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, stages: int = 3) -> DataFrame:
    """Accuracy, macro F1, quadratic weighted kappa and recall per stage; 0/0 scores 0.

    Kappa is NULL where only one true stage occurs.
    """
    every = range(stages)
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct(actual).alias("_classes"),
        *[F.count_if((F.col(actual) == i) & (F.col(predicted) == j)).alias(f"_{i}_{j}") for i in every for j in every],
    )

    def cell(i: int, j: int):
        return F.col(f"_{i}_{j}").cast("double")

    def total(cells):
        return sum(cells, F.lit(0.0))

    row = [total(cell(i, j) for j in every) for i in every]
    column = [total(cell(i, j) for i in every) for j in every]
    f1 = [F.coalesce(ratio(2 * cell(i, i), row[i] + column[i]), F.lit(0.0)) for i in every]
    observed = total((i - j) ** 2 * cell(i, j) for i in every for j in every)
    expected = total((i - j) ** 2 * row[i] * column[j] for i in every for j in every) / F.col("n")
    return counted.select(
        *keys, "n",
        (total(cell(i, i) for i in every) / F.col("n")).alias("accuracy"),
        (total(f1) / stages).alias("macro_f1"),
        F.when(F.col("_classes") > 1, 1 - ratio(observed, expected)).alias("qwk"),
        *[F.coalesce(ratio(cell(i, i), row[i]), F.lit(0.0)).alias(f"recall_{i}") for i in every],
    )


def method_means(fold_metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean metrics over folds per method."""
    return fold_metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in ("pr_auc", "recall_at_p50", "roc_auc")])


def metric_lift(means: DataFrame, column: str, base: str, other: str) -> DataFrame:
    """Difference of two rows of a metric table: ``other`` minus ``base``."""
    metrics = ("pr_auc", "recall_at_p50", "roc_auc")

    def of(which: str, metric: str):
        return F.max(F.when(F.col(column) == which, F.col(metric)))

    return means.agg(*[(of(other, m) - of(base, m)).alias(f"{m}_lift") for m in metrics])


def fold_pivot(fold_metrics: DataFrame, fold: str, method: str, methods: Sequence[str], metric: str) -> DataFrame:
    return fold_metrics.groupBy(fold).pivot(method, list(methods)).agg(F.first(metric))
