"""Health, end of life and remaining life of a cell, and how its capacity fades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.columns import floored, ratio
from tidegauge.operators.ordered import over_series

EOL_THRESHOLD = 0.80
CONFIRMATION_CYCLES = 5
INITIAL_WINDOW = 5
STAGES = ("pre_eol", "eol", "post_eol", "excluded")


def initial_capacity(series: DataFrame, cell: str, cycle: str, capacity: str, window: int = INITIAL_WINDOW) -> DataFrame:
    """Mean of each cell's first cycles; Spark limits every cell to ``window`` rows before the shuffle."""
    earliest = Window.partitionBy(cell).orderBy(cycle)
    first = series.withColumn("_rank", F.row_number().over(earliest)).filter(F.col("_rank") <= window)
    return first.groupBy(cell).agg(F.avg(capacity).alias("initial_capacity"))


def sustained_run(w: WindowSpec, below: Column, length: int) -> Column:
    """True where this row starts ``length`` rows in a row that are all below."""
    frame = w.rowsBetween(0, length - 1)
    return (F.count(below).over(frame) == length) & F.min(below).over(frame)


def sustained_eol(
    series: DataFrame, keys: list[str], cycle: str, health: str, threshold: Column | float = EOL_THRESHOLD,
    confirm: int = CONFIRMATION_CYCLES, name: str = "eol_cycle", max_rows: int | None = None,
) -> DataFrame:
    """First cycle of the first confirmed run below the threshold; NULL (censored) if there is none.

    One row per key. A missing health value never counts as below.
    """
    flagged = series.withColumn("_below", F.coalesce(F.col(health) < threshold, F.lit(False)))
    started = over_series(
        flagged, keys, [cycle], lambda w: {"_start": sustained_run(w, F.col("_below"), confirm)},
        ahead=confirm - 1, max_rows=max_rows,
    )
    return started.groupBy(*keys).agg(
        F.min(F.when(F.col("_start"), F.col(cycle))).alias(name),
        F.min(F.when(F.col("_below"), F.col(cycle))).alias("first_below_cycle"),
    )


def health_labels(
    cycles: DataFrame, cell: str = "cell_id", cycle: str = "cycle", capacity: str = "capacity_ah",
    modelling: str = "is_modeling_cycle", threshold: float = EOL_THRESHOLD, confirm: int = CONFIRMATION_CYCLES,
    window: int = INITIAL_WINDOW, max_rows: int | None = None,
) -> DataFrame:
    """Health, end-of-life cycle and remaining life of every cycle; excluded cycles carry NULL labels."""
    usable = cycles.filter(F.col(modelling))
    base = initial_capacity(usable, cell, cycle, capacity, window)
    with_base = cycles.join(base, cell, "left")
    healthy = with_base.withColumn("soh", F.when(F.col(modelling), ratio(F.col(capacity), F.col("initial_capacity"))))
    eol = sustained_eol(
        healthy.filter(F.col(modelling)).select(cell, cycle, "soh"), [cell], cycle, "soh", threshold, confirm,
        max_rows=max_rows,
    )
    rul = F.when(F.col(modelling), F.col("eol_cycle") - F.col(cycle))
    return healthy.join(eol, cell, "left").select(
        "*",
        F.lit(threshold).alias("eol_threshold"),
        F.lit(confirm).alias("eol_confirmation_cycles"),
        F.col("eol_cycle").isNull().alias("is_censored"),
        rul.alias("rul"),
        floored(rul).alias("rul_clipped"),
    )


def life_stages(labelled: DataFrame, cycle: str = "cycle", modelling: str = "is_modeling_cycle") -> DataFrame:
    """Stage of every cycle; on excluded cycles ``post_eol`` is NULL and the stage is "excluded"."""
    after = F.when(F.col(modelling), F.col(cycle) > F.col("eol_cycle"))
    stage = (
        F.when(F.col(modelling) & (F.col(cycle) < F.col("eol_cycle")), "pre_eol")
        .when(F.col(modelling) & (F.col(cycle) == F.col("eol_cycle")), "eol")
        .when(F.col(modelling) & (F.col(cycle) > F.col("eol_cycle")), "post_eol")
        .otherwise("excluded")
    )
    return labelled.select("*", after.alias("post_eol"), stage.alias("life_stage"))


def fade_summary(staged: DataFrame, cell: str = "cell_id", cycle: str = "cycle", capacity: str = "capacity_ah",
                 modelling: str = "is_modeling_cycle") -> DataFrame:
    """One row per cell: stage counts, first and last capacity, fade, ranges, and the slope before and after."""
    use = F.col(modelling)
    at = F.when(use, F.col(cycle))

    def slope(stage: str) -> Column:
        inside = F.col("life_stage") == stage
        return F.regr_slope(F.when(inside, F.col(capacity)), F.when(inside, F.col(cycle).cast("double")))

    summary = staged.groupBy(cell).agg(
        F.count("*").alias("row_count"),
        F.count_if(use).alias("modeling_cycle_count"),
        F.count_if(~use).alias("excluded_cycle_count"),
        *[F.count_if(F.col("life_stage") == s).alias(f"{s}_count") for s in ("pre_eol", "eol", "post_eol")],
        F.max("initial_capacity").alias("initial_capacity"),
        F.min_by(capacity, at).alias("first_capacity"),
        F.max_by(capacity, at).alias("last_capacity"),
        F.min("soh").alias("soh_min"), F.max("soh").alias("soh_max"),
        F.max("eol_cycle").alias("eol_cycle"),
        F.min("rul").alias("rul_min"), F.max("rul").alias("rul_max"),
        F.min("rul_clipped").alias("rul_clipped_min"), F.max("rul_clipped").alias("rul_clipped_max"),
        slope("pre_eol").alias("pre_eol_slope"), slope("post_eol").alias("post_eol_slope"),
    )
    return summary.select(
        "*",
        (F.col("last_capacity") - F.col("first_capacity")).alias("capacity_fade_ah"),
        ((ratio(F.col("last_capacity"), F.col("first_capacity")) - 1) * 100).alias("capacity_fade_percent"),
        ratio(F.abs("post_eol_slope"), F.abs("pre_eol_slope")).alias("post_to_pre_slope_ratio"),
    )


def event_band(labelled: DataFrame, before: int = 5, after: int = 10, cycle: str = "cycle") -> DataFrame:
    """Rows close to the end of life."""
    return labelled.filter(F.col(cycle).between(F.col("eol_cycle") - before, F.col("eol_cycle") + after))


def large_drops(series: DataFrame, cell: str, cycle: str, value: str, limit: float = -0.05,
                max_rows: int | None = None) -> DataFrame:
    """Change to the previous row and whether it is a large drop; the first row has no change and no drop."""
    changed = over_series(
        series, [cell], [cycle], lambda w: {"delta": F.col(value) - F.lag(value).over(w)}, back=1, max_rows=max_rows
    )
    return changed.withColumn("is_large_drop", F.coalesce(F.col("delta") < limit, F.lit(False)))


def status_row(labelled: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """One row per cell: last cycle, latest known health, threshold capacity and true end of life."""
    known = F.when(F.col("soh").isNotNull(), F.col(cycle))
    return labelled.groupBy(cell).agg(
        F.max(cycle).alias("last_cycle"),
        F.max_by("soh", known).alias("latest_soh"),
        F.max(F.col("initial_capacity") * F.col("eol_threshold")).alias("threshold_capacity"),
        F.max("eol_cycle").alias("eol_cycle"),
    )


def median_smoothed(series: DataFrame, cell: str, cycle: str, value: str, name: str, window: int = 7,
                    max_rows: int | None = None) -> DataFrame:
    """Trailing median that includes the current row."""
    return over_series(
        series, [cell], [cycle],
        lambda w: {name: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-(window - 1), 0))},
        back=window - 1, max_rows=max_rows,
    )
