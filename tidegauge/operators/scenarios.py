"""Rolling-origin backtests: which rows a forecast may see and which it must predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.ordered import over_series, row_numbers
from tidegauge.session import shuffled

MIN_TRAIN_ROWS = 180
HORIZONS = (10, 20, 30)
ORIGIN_COUNT = 4


def with_positions(series: DataFrame, cell: str = "cell_id", cycle: str = "cycle", name: str = "pos",
                   max_rows: int | None = None) -> DataFrame:
    """0-based row position per cell, the clock that origins and horizons count in."""
    if max_rows is None:
        return over_series(series, [cell], [cycle], lambda w: {name: F.row_number().over(w) - 1})
    return row_numbers(series, [cell], [cycle], name).withColumn(name, (F.col(name) - 1).cast("int"))


def rolling_scenarios(
    series: DataFrame, cell: str = "cell_id", cycle: str = "cycle", capacity: str = "capacity_ah",
    min_train: int = MIN_TRAIN_ROWS, horizons: Sequence[int] = HORIZONS, origins: int = ORIGIN_COUNT,
) -> DataFrame:
    """Scenarios of every cell that reaches its end of life.

    ``series`` holds modelling rows with ``pos``, ``soh``, ``eol_cycle``, ``eol_threshold`` and
    ``eol_confirmation_cycles``. Evenly spaced origins end before the end of life; further origins lie a
    fixed lead before it and forecast through its confirmation. Work per cell is a fixed number of scenarios.
    """
    at_eol = F.col(cycle) == F.col("eol_cycle")
    cells = series.groupBy(cell).agg(
        F.max(F.when(at_eol, F.col("pos"))).alias("eol_pos"),
        F.max("eol_cycle").alias("true_eol_cycle"),
        F.max("eol_confirmation_cycles").alias("confirm"),
        F.max("eol_threshold").alias("threshold"),
    ).filter("eol_pos is not null")
    first = min_train - 1
    last = F.col("eol_pos") - max(horizons) - 1
    spaced = F.transform(
        F.sequence(F.lit(0), F.lit(origins - 1)),
        lambda i: (F.lit(first) + F.floor(i * (last - first) / F.lit(max(origins - 1, 1)))).cast("int"),
    )
    usual = (
        cells.filter(last >= first)
        .select("*", F.posexplode(F.array_distinct(spaced)).alias("number", "origin_position"))
        .select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
        .withColumn("scenario_type", F.lit("pre_eol_rolling"))
        .withColumn("number", F.col("number") + 1)
        .withColumn("rul_lead_horizon", F.lit(None).cast("int"))
    )
    crossing = (
        cells.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("rul_lead_horizon"))
        .withColumn("origin_position", F.col("eol_pos") - F.col("rul_lead_horizon"))
        .filter(F.col("origin_position") >= first)
        .withColumn("horizon", F.col("rul_lead_horizon") + F.col("confirm") - 1)
        .withColumn("scenario_type", F.lit("eol_crossing"))
        .withColumn("number", F.lit(None).cast("int"))
    )
    plans = usual.unionByName(crossing, allowMissingColumns=True)

    spots = plans.select("*", F.explode(F.array(
        F.struct(F.lit("origin").alias("role"), F.col("origin_position").alias("at")),
        F.struct(F.lit("start").alias("role"), (F.col("origin_position") + 1).alias("at")),
        F.struct(F.lit("end").alias("role"), (F.col("origin_position") + F.col("horizon")).alias("at")),
    )).alias("spot"))
    rows = series.select(
        F.col(cell).alias("_cell"), F.col("pos").alias("_pos"), F.col(cycle).alias("_cycle"),
        F.col(capacity).alias("_capacity"), F.col("soh").alias("_soh"),
    )
    seen = spots.join(shuffled(rows), (F.col(cell) == F.col("_cell")) & (F.col("spot.at") == F.col("_pos")))
    key = [cell, "scenario_type", "number", "origin_position", "horizon", "rul_lead_horizon",
           "true_eol_cycle", "confirm", "threshold", "eol_pos"]

    def of(role: str, column: str):
        return F.max(F.when(F.col("spot.role") == role, F.col(column)))

    placed = seen.groupBy(*key).agg(
        of("origin", "_cycle").alias("forecast_origin"), of("origin", "_capacity").alias("origin_capacity_ah"),
        of("origin", "_soh").alias("origin_soh"), of("start", "_cycle").alias("test_start_cycle"),
        of("end", "_cycle").alias("test_end_cycle"), F.count("*").alias("_found"),
    ).filter("_found = 3")

    # the confirmation run is at most ``confirm`` rows per cell
    run = series.filter(
        F.col(cycle).between(F.col("eol_cycle"), F.col("eol_cycle") + F.col("eol_confirmation_cycles") - 1)
    ).groupBy(cell).agg(F.array_sort(F.collect_list("pos")).alias("_run"))
    end = F.col("origin_position") + F.col("horizon")
    inside = F.size(F.filter("_run", lambda p: (p > F.col("origin_position")) & (p <= end)))
    usual_id = F.format_string("pre_%02d_o%d_h%d", "number", "forecast_origin", "horizon")
    crossing_id = F.format_string("eol_o%d_lead%d_h%d", "forecast_origin", "rul_lead_horizon", "horizon")
    return placed.join(shuffled(run), cell).select(
        F.when(F.col("scenario_type") == "eol_crossing", crossing_id).otherwise(usual_id).alias("scenario_id"),
        "scenario_type", cell, "origin_position", "forecast_origin", "origin_capacity_ah", "origin_soh",
        (F.col("origin_soh") < F.col("threshold")).alias("origin_below_threshold"),
        "horizon", "rul_lead_horizon",
        (F.col("origin_position") + 1).alias("train_rows"), F.col("horizon").alias("test_rows"),
        "test_start_cycle", "test_end_cycle", "true_eol_cycle",
        F.greatest(F.col("true_eol_cycle") - F.col("forecast_origin"), F.lit(0)).alias("true_rul"),
        ((F.col("eol_pos") > F.col("origin_position")) & (F.col("eol_pos") <= end)).alias("includes_eol"),
        (inside == F.col("confirm")).alias("includes_eol_confirmation"),
    )


def test_rows(series: DataFrame, scenarios: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Rows to predict by cycle value: origin < cycle <= origin + horizon.

    The horizon is unrolled into exact cycles, so the range join is an equi-join on (cell, cycle) that
    neither replicates the series nor sends a long cell to one task.
    """
    steps = scenarios.select("*", F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("_ahead"))
    wanted = steps.withColumn(cycle, F.col("forecast_origin") + F.col("_ahead")).drop("_ahead")
    return wanted.join(series, [cell, cycle])


def training_rows(series: DataFrame, scenarios: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """Rows a scenario may learn from (cycle <= origin), once per distinct origin of a cell.

    A cell has a fixed handful of origins. They travel as one array per cell, so the series is scanned once
    and each row is emitted only for origins it precedes.
    """
    origins = scenarios.groupBy(cell).agg(F.array_sort(F.collect_set("forecast_origin")).alias("_origins"))
    visible = series.join(origins, cell)
    allowed = F.filter("_origins", lambda o: o >= F.col(cycle))
    return visible.withColumn("forecast_origin", F.explode(allowed)).drop("_origins")


def incomplete_scenarios(tests: DataFrame, scenarios: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Scenarios whose rows do not match the horizon; no rows means the contract holds."""
    counted = tests.groupBy(cell, "scenario_id").agg(F.count("*").alias("found"))
    return scenarios.join(counted, [cell, "scenario_id"], "left").select(
        cell, "scenario_id", "horizon", F.coalesce("found", F.lit(0)).alias("found")
    ).filter(F.col("found") != F.col("horizon"))


def ratio_split(series: DataFrame, cell: str, share: float, pos: str = "pos") -> DataFrame:
    """First ``share`` of each cell's rows as train, the rest as test."""
    sizes = series.groupBy(cell).agg(F.count("*").alias("_n"))
    role = F.when(F.col(pos) < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")
    return series.join(sizes, cell).withColumn("role", role).drop("_n")
