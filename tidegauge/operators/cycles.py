"""From raw cycler rows to one row per cycle, with quality flags and duplicate files removed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.columns import truth
from tidegauge.operators.ordered import over_series, row_numbers


@dataclass(frozen=True)
class Channels:
    """Column names of the raw rows."""

    file: str
    cycle: str
    step: str
    current: str
    voltage: str
    test_time: str
    step_time: str
    charge: str
    discharge: str


# Fixed values of the test protocol.
CURRENT_THRESHOLD = 0.1
CUTOFF_VOLTAGE = 2.8
CAPACITY_MAX = 2.0
DURATION_RATIO_MIN = 0.75
DURATION_WINDOW = 10
DURATION_MIN_ROWS = 3


def cycle_summary(rows: DataFrame, c: Channels, current_threshold: float = CURRENT_THRESHOLD) -> DataFrame:
    """Counts, extremes and means per cycle with the duration and mean current of both phases.

    The step clock restarts at each step, so a phase lasts the sum of its steps' longest times. Sums and
    extremes per step already carry everything the cycle needs: one scan, and both shuffles move aggregates.
    """
    phases = {
        "charge": F.col(c.current) > current_threshold,
        "discharge": F.col(c.current) < -current_threshold,
    }
    per_step = rows.groupBy(c.file, c.cycle, c.step).agg(
        F.count("*").alias("n"),
        F.min(c.test_time).alias("t_min"), F.max(c.test_time).alias("t_max"),
        F.sum(c.voltage).alias("v_sum"), F.count(c.voltage).alias("v_n"),
        F.min(c.voltage).alias("v_min"), F.max(c.voltage).alias("v_max"),
        F.sum(c.current).alias("i_sum"), F.count(c.current).alias("i_n"),
        F.max(c.charge).alias("charge_max"), F.max(c.discharge).alias("discharge_max"),
        *[
            part for name, active in phases.items() for part in (
                F.max(F.when(active, F.col(c.step_time))).alias(f"{name}_time"),
                F.sum(F.when(active, F.col(c.current))).alias(f"{name}_sum"),
                F.count(F.when(active, F.col(c.current))).alias(f"{name}_n"),
            )
        ],
    )

    def mean(total: str, count: str) -> Column:
        return F.sum(total) / F.nullif(F.sum(count), F.lit(0))

    return per_step.groupBy(F.col(c.file).alias("source_file"), F.col(c.cycle).alias("local_cycle")).agg(
        F.sum("n").alias("row_count"),
        F.min("t_min").alias("test_time_min"), F.max("t_max").alias("test_time_max"),
        mean("v_sum", "v_n").alias("voltage_mean"),
        F.min("v_min").alias("voltage_min"), F.max("v_max").alias("voltage_max"),
        mean("i_sum", "i_n").alias("current_mean"),
        F.max("charge_max").alias("charge_capacity_max"), F.max("discharge_max").alias("discharge_capacity_max"),
        *[
            part for name in phases for part in (
                F.sum(f"{name}_time").alias(f"{name}_duration_sec"),
                mean(f"{name}_sum", f"{name}_n").alias(f"{name}_current_mean"),
            )
        ],
    )


def own_amount(cycles: DataFrame, keys: Sequence[str], order: str, counter: str, name: str = "capacity_ah",
               max_rows: int | None = None) -> DataFrame:
    """A running counter turned into each row's own amount; the first row of a file keeps the counter."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {name: F.coalesce(F.col(counter) - F.lag(counter).over(w), F.col(counter))}

    return over_series(cycles, keys, [order], build, back=1, max_rows=max_rows)


def cell_texts(columns: Sequence[str]) -> Column:
    """A row's cells as one text in which missing cells and the borders of cells show: NULL is '-', else length:text."""
    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[cell(c) for c in columns])


def fingerprints(rows: DataFrame, file: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Content fingerprint per file: row count and two sums over 60 bits each of the rows' MD5.

    The position is digested with the row, so equal rows in another order give another fingerprint while the
    sums themselves combine in any order, on the map side. Missing cells are marked, so rows whose NULLs trade places
    differ. The file name stays outside.
    """
    digest = F.md5(cell_texts([order, *columns]).cast("binary"))

    def total(first: int) -> Column:
        return F.sum(F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(38,0)"))

    return rows.groupBy(file).agg(F.count("*").alias("rows"), total(1).alias("hash_sum"), total(16).alias("hash_rest"))


def duplicate_files(prints: DataFrame, file: str, order: str | None = None) -> DataFrame:
    """Files whose content an earlier file already has, with that file.

    ``order`` is the column that says which file came first (its place, or a date); files of one place, and all without
    ``order``, go by name.
    """
    content = ["rows", "hash_sum", "hash_rest"]
    place = F.struct(F.col(order).isNull(), order, file) if order else F.struct(file)
    owners = prints.groupBy(*content).agg(F.min_by(file, place).alias("duplicate_of"), F.count("*").alias("_copies"))
    repeated = owners.filter("_copies > 1").drop("_copies")
    return prints.join(repeated, content).filter(F.col(file) != F.col("duplicate_of")).select(
        F.col(file).alias("duplicate_file"), "duplicate_of"
    )


def across_files(cycles: DataFrame, cell: str, file: str, file_order: str, local: str, name: str = "cycle") -> DataFrame:
    """Number a cell's cycles 1..n through its files: by ``file_order``, then by ``local`` inside a file.

    Cycles are ranked inside their file only; the few files of a cell are then shifted by the cycles of the files
    before them. A file has one ``file_order``; files of one place go by name.
    """
    inside = over_series(cycles, [cell, file], [local], lambda w: {"_place": F.row_number().over(w)})
    sizes = cycles.groupBy(cell, file).agg(F.min(file_order).alias("_order"), F.count("*").alias("_n"))
    before = Window.partitionBy(cell).orderBy(F.col("_order").asc_nulls_last(), file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(cell, file, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return inside.join(offsets, [cell, file]).withColumn(name, (F.col("_offset") + F.col("_place")).cast("int")).drop("_place", "_offset")


def number_cycles(cycles: DataFrame, cell: str, order: Sequence[str], name: str = "cycle",
                  max_rows: int | None = None) -> DataFrame:
    """Gap-free numbering 1..n per cell over (file order, local cycle)."""
    if max_rows is None:
        return over_series(cycles, [cell], order, lambda w: {name: F.row_number().over(w)})
    return row_numbers(cycles, [cell], order, name)


def duration_baselines(cycles: DataFrame, cell: str, order: str, columns: Sequence[str],
                       window: int = DURATION_WINDOW, min_rows: int = DURATION_MIN_ROWS,
                       max_rows: int | None = None) -> DataFrame:
    """Median of the previous rows and the row's ratio to it."""

    def build(w: WindowSpec) -> dict[str, Column]:
        past = w.rowsBetween(-window, -1)
        return {
            f"{c}_median": F.when(F.count(c).over(past) >= min_rows, F.percentile(c, F.lit(0.5)).over(past))
            for c in columns
        }

    wide = over_series(cycles, [cell], [order], build, back=window, max_rows=max_rows)
    return wide.select("*", *[
        (F.col(c) / F.nullif(F.col(f"{c}_median"), F.lit(0.0))).alias(f"{c}_ratio") for c in columns
    ])


def quality_flags(
    cycles: DataFrame, charge: str = "charge_duration_sec", discharge: str = "discharge_duration_sec",
    cutoff: float = CUTOFF_VOLTAGE, capacity_max: float = CAPACITY_MAX, ratio_min: float = DURATION_RATIO_MIN,
) -> DataFrame:
    """Quality flags and cycle type; comparisons with a missing value are false."""
    reached = truth(F.col("voltage_min") <= cutoff)
    valid = truth((F.col("capacity_ah") > 0) & (F.col("capacity_ah") <= capacity_max)) & F.col(discharge).isNotNull()
    short_charge = (F.col("local_cycle") > 1) & truth(F.col(f"{charge}_ratio") < ratio_min)
    short_discharge = truth(F.col(f"{discharge}_ratio") < ratio_min)
    flagged = cycles.select("*", reached.alias("reached_discharge_cutoff"), valid.alias("has_valid_measurement"))
    anomaly = F.col("has_valid_measurement") & (~F.col("reached_discharge_cutoff") | short_charge | short_discharge)
    return flagged.withColumn("is_protocol_anomaly", anomaly).withColumn(
        "cycle_type",
        F.when(~F.col("has_valid_measurement"), "invalid")
        .when(F.col("is_protocol_anomaly"), "nonstandard_cycle")
        .otherwise("standard_full_cycle"),
    ).withColumn("is_modeling_cycle", F.col("cycle_type") == "standard_full_cycle")


def type_counts(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows per listed value in list order, zero where none; values outside the list are not shown."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(order)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(order)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def processing_summary(cycles: DataFrame, duplicates: DataFrame, file: str = "source_file") -> DataFrame:
    """Files seen, processed and skipped, and the cycles they gave by type."""
    by_type = {t: F.count_if(F.col("cycle_type") == t).alias(f"{t}_count")
               for t in ("invalid", "nonstandard_cycle", "standard_full_cycle")}
    per_file = cycles.groupBy(file).agg(F.count("*").alias("n"), *by_type.values())
    skipped = duplicates.agg(F.count("*")).scalar()
    return per_file.agg(
        F.count("*").alias("processed_files"), F.sum("n").alias("cycle_rows"),
        *[F.sum(f"{t}_count").alias(f"{t}_count") for t in by_type],
    ).withColumn("duplicate_files", skipped).withColumn("raw_files", F.col("processed_files") + F.col("duplicate_files"))
