"""Sinks, and the check that two of them hold the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_both(df: DataFrame, csv_path: str, parquet_path: str, mode: str = "errorifexists") -> None:
    """Write the same table as CSV and as Parquet."""
    df.write.mode(mode).option("header", True).csv(csv_path)
    df.write.mode(mode).parquet(parquet_path)


def read_both(spark: SparkSession, csv_path: str, parquet_path: str) -> tuple[DataFrame, DataFrame]:
    """Read both copies back; the CSV copy takes the Parquet copy's types."""
    parquet = spark.read.parquet(parquet_path)
    return spark.read.schema(parquet.schema).option("header", True).csv(csv_path), parquet


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the surplus; no rows means equal content.

    NULLs compare equal. One aggregation replaces two set differences, and equal rows meet before the shuffle.
    """
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    signed = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    return signed.groupBy(*left.columns).agg(F.sum("_side").alias("surplus")).filter("surplus <> 0")


def write_table(df: DataFrame, path: str, file_format: str = "parquet",
                partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.format(file_format).mode(mode)
    if file_format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_card(spark: SparkSession, path: str, facts: Mapping[str, object], aggregates: DataFrame) -> None:
    """A model card: fixed facts beside one row of aggregates over the training table, as JSON."""
    card = aggregates.select("*", *[
        (F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)).alias(name)
        for name, value in facts.items()
    ])
    card.coalesce(1).write.mode("overwrite").json(path)


def read_card(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
