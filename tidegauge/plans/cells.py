"""Cycle building, quality flags, health labels and fade analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.columns import risk_level
from tidegauge.operators import cycles as C
from tidegauge.operators import health as H
from tidegauge.operators.ordered import exponential_mean
from tidegauge.operators.forecast import scaled_position, supervised
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r

CHANNELS = C.Channels("cell_id", "day", "step", "current", "voltage", "test_time", "step_time", "charge", "discharge")


def _summary(spark, sf_dir):
    return C.cycle_summary(B.cycler_rows(spark, sf_dir), CHANNELS)


SQL_SUMMARY = B.SQL_ROWS + """,
phases AS (
  SELECT cell_id, day, step, max(step_time) FILTER (current > 0.1) AS charge_time,
         max(step_time) FILTER (current < -0.1) AS discharge_time FROM cycler GROUP BY 1, 2, 3),
durations AS (
  SELECT cell_id, day, sum(charge_time) AS charge_duration_sec, sum(discharge_time) AS discharge_duration_sec FROM phases GROUP BY 1, 2),
summary AS (
  SELECT cell_id AS source_file, day AS local_cycle, count(*) AS row_count, min(test_time) AS test_time_min, max(test_time) AS test_time_max,
         avg(voltage) AS voltage_mean, min(voltage) AS voltage_min, max(voltage) AS voltage_max, avg(current) AS current_mean,
         max(charge) AS charge_capacity_max, max(discharge) AS discharge_capacity_max,
         any_value(charge_duration_sec) AS charge_duration_sec, avg(current) FILTER (current > 0.1) AS charge_current_mean,
         any_value(discharge_duration_sec) AS discharge_duration_sec, avg(current) FILTER (current < -0.1) AS discharge_current_mean
  FROM cycler JOIN durations USING (cell_id, day) GROUP BY 1, 2)"""

SUMMARY_COLUMNS = ("source_file", "local_cycle", "row_count", "test_time_min", "test_time_max", "voltage_mean", "voltage_min",
                   "voltage_max", "current_mean", "charge_capacity_max", "discharge_capacity_max", "charge_duration_sec",
                   "charge_current_mean", "discharge_duration_sec", "discharge_current_mean")


def _round_sql(columns, exact=("source_file", "local_cycle", "row_count"), digits: int = 6) -> str:
    return ", ".join(c if c in exact else f"{r(c, digits)} AS {c}" for c in columns)


@query("cycle_summary", f"WITH {SQL_SUMMARY} SELECT {_round_sql(SUMMARY_COLUMNS)} FROM summary")
def cycle_summary(spark, sf_dir):
    return B.rounded(_summary(spark, sf_dir))


def _cycle_table(spark, sf_dir):
    amounts = C.own_amount(_summary(spark, sf_dir), ["source_file"], "local_cycle", "discharge_capacity_max")
    numbered = C.number_cycles(amounts, "source_file", ["local_cycle"])
    durations = ["charge_duration_sec", "discharge_duration_sec"]
    based = C.duration_baselines(numbered, "source_file", "cycle", durations)
    # the flag rules compare a file's own cycle number, here the running one
    return C.quality_flags(based.drop("local_cycle").withColumnRenamed("cycle", "local_cycle"))


SQL_CYCLE_TABLE = SQL_SUMMARY + """,
amounts AS (
  SELECT * EXCLUDE (local_cycle), local_cycle AS day, row_number() OVER w AS cycle,
         coalesce(discharge_capacity_max - lag(discharge_capacity_max) OVER w, discharge_capacity_max) AS capacity_ah
  FROM summary WINDOW w AS (PARTITION BY source_file ORDER BY local_cycle)),
based AS (
  SELECT *, CASE WHEN count(charge_duration_sec) OVER p >= 3 THEN median(charge_duration_sec) OVER p END AS charge_median,
         CASE WHEN count(discharge_duration_sec) OVER p >= 3 THEN median(discharge_duration_sec) OVER p END AS discharge_median
  FROM amounts WINDOW p AS (PARTITION BY source_file ORDER BY cycle ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
ratios AS (
  SELECT *, charge_duration_sec / nullif(charge_median, 0) AS charge_ratio, discharge_duration_sec / nullif(discharge_median, 0) AS discharge_ratio,
         coalesce(voltage_min <= 2.8, false) AS reached,
         coalesce(capacity_ah > 0 AND capacity_ah <= 2.0, false) AND discharge_duration_sec IS NOT NULL AS valid
  FROM based),
flagged AS (
  SELECT *, valid AND (NOT reached OR (cycle > 1 AND coalesce(charge_ratio < 0.75, false)) OR coalesce(discharge_ratio < 0.75, false)) AS anomaly
  FROM ratios),
typed AS (
  SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN anomaly THEN 'nonstandard_cycle' ELSE 'standard_full_cycle' END AS cycle_type FROM flagged)"""


@query("cycle_amounts_and_numbers", f"WITH {SQL_CYCLE_TABLE} SELECT source_file, day, CAST(cycle AS INT) AS cycle, {r('capacity_ah')} AS capacity_ah FROM amounts")
def cycle_amounts_and_numbers(spark, sf_dir):
    amounts = C.own_amount(_summary(spark, sf_dir), ["source_file"], "local_cycle", "discharge_capacity_max")
    numbered = C.number_cycles(amounts, "source_file", ["local_cycle"])
    return B.rounded(numbered.select("source_file", F.col("local_cycle").alias("day"), "cycle", "capacity_ah"))


@query("duration_baselines", f"""WITH {SQL_CYCLE_TABLE}
SELECT source_file, CAST(cycle AS INT) AS cycle, {r('charge_median', 5)} AS charge_duration_sec_median, {r('discharge_median', 5)} AS discharge_duration_sec_median,
       {r('charge_ratio', 5)} AS charge_duration_sec_ratio, {r('discharge_ratio', 5)} AS discharge_duration_sec_ratio FROM ratios""")
def duration_baselines(spark, sf_dir):
    table = _cycle_table(spark, sf_dir)
    return B.rounded(table.select(
        "source_file", F.col("local_cycle").alias("cycle"), "charge_duration_sec_median", "discharge_duration_sec_median",
        "charge_duration_sec_ratio", "discharge_duration_sec_ratio",
    ), 5)


@query("cycle_quality_flags", f"""WITH {SQL_CYCLE_TABLE}
SELECT source_file, CAST(cycle AS INT) AS cycle, reached AS reached_discharge_cutoff, valid AS has_valid_measurement,
       anomaly AS is_protocol_anomaly, cycle_type, cycle_type = 'standard_full_cycle' AS is_modeling_cycle FROM typed""")
def cycle_quality_flags(spark, sf_dir):
    return _cycle_table(spark, sf_dir).select(
        "source_file", F.col("local_cycle").alias("cycle"), "reached_discharge_cutoff", "has_valid_measurement",
        "is_protocol_anomaly", "cycle_type", "is_modeling_cycle",
    )


@query("cycle_type_counts", f"""WITH {SQL_CYCLE_TABLE}
SELECT CAST(place AS INT) AS place, k.cycle_type, count(t.cycle_type) AS n
FROM (VALUES (0, 'standard_full_cycle'), (1, 'nonstandard_cycle'), (2, 'invalid'), (3, 'unknown')) k(place, cycle_type)
LEFT JOIN typed t USING (cycle_type) GROUP BY 1, 2""")
def cycle_type_counts(spark, sf_dir):
    order = ("standard_full_cycle", "nonstandard_cycle", "invalid", "unknown")
    return C.type_counts(_cycle_table(spark, sf_dir), "cycle_type", order)


def _document_lines(spark, sf_dir):
    """Documents as files: one row per line, in order."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    return B.table(spark, sf_dir, "documents").select("doc_id", lines)


@query("duplicate_files", """SELECT doc_id AS duplicate_file, owner AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents) WHERE doc_id <> owner""")
def duplicate_files(spark, sf_dir):
    return C.duplicate_files(C.fingerprints(_document_lines(spark, sf_dir), "doc_id", "line_no", ["line"]), "doc_id")


def _cell_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


@query("duplicate_files_by_date", """SELECT doc_id AS duplicate_file, owner AS duplicate_of
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS owner FROM documents WHERE text IS NOT NULL) WHERE doc_id <> owner""")
def duplicate_files_by_date(spark, sf_dir):
    """Files that came in the reverse order of their names: the one that came first owns the content."""
    prints = C.fingerprints(_document_lines(spark, sf_dir), "doc_id", "line_no", ["line"]).withColumn("file_order", -F.col("doc_id"))
    return C.duplicate_files(prints, "doc_id", "file_order")


@query("content_fingerprints", f"""WITH {B.SQL_ROWS},
digests AS (
  SELECT cell_id, md5({' || '.join(_cell_sql(c) for c in ('test_time', 'step', 'charge_or_none', 'discharge_or_none'))}) AS d FROM (
    SELECT cell_id, test_time, step, CASE WHEN step % 2 = 0 THEN charge END AS charge_or_none,
           CASE WHEN step % 2 = 1 THEN charge END AS discharge_or_none FROM cycler))
SELECT cell_id, count(*) AS rows, CAST(sum(('0x' || substr(d, 1, 15))::BIGINT) AS VARCHAR) AS hash_sum,
       CAST(sum(('0x' || substr(d, 16, 15))::BIGINT) AS VARCHAR) AS hash_rest FROM digests GROUP BY 1""")
def content_fingerprints(spark, sf_dir):
    """Every row misses one of two cells; which one it is counts."""
    even = F.col("step") % 2 == 0
    rows = B.cycler_rows(spark, sf_dir).withColumns({"some": F.when(even, F.col("charge")), "other": F.when(~even, F.col("charge"))})
    prints = C.fingerprints(rows, "cell_id", "test_time", ["step", "some", "other"])
    return prints.select("cell_id", "rows", F.col("hash_sum").cast("string").alias("hash_sum"), F.col("hash_rest").cast("string").alias("hash_rest"))


@query("cycles_across_files", f"""WITH {SQL_SUMMARY},
placed AS (
  SELECT source_file AS cell_id, year(local_cycle) AS year, local_cycle AS day, charge_duration_sec,
         row_number() OVER (PARTITION BY source_file ORDER BY year(local_cycle), local_cycle) AS cycle FROM summary),
based AS (
  SELECT *, CASE WHEN count(charge_duration_sec) OVER p >= 3 THEN median(charge_duration_sec) OVER p END AS med
  FROM placed WINDOW p AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT cell_id, 'file_' || (9999 - year) AS source_file, day, CAST(cycle AS INT) AS cycle, {r('med', 5)} AS charge_duration_sec_median FROM based""")
def cycles_across_files(spark, sf_dir):
    """A cell's cycles come in one file a year, whose names sort backwards; numbers and medians run on from file to file."""
    year = F.year("local_cycle")
    cycles = _summary(spark, sf_dir).select(
        F.col("source_file").alias("cell_id"), F.concat(F.lit("file_"), 9999 - year).alias("source_file"), year.alias("file_order"),
        "local_cycle", "charge_duration_sec")
    numbered = C.across_files(cycles, "cell_id", "source_file", "file_order", "local_cycle")
    based = C.duration_baselines(numbered, "cell_id", "cycle", ["charge_duration_sec"])
    return B.rounded(based.select("cell_id", "source_file", F.col("local_cycle").alias("day"), "cycle", "charge_duration_sec_median"), 5)


@query("processing_summary", f"""WITH {SQL_CYCLE_TABLE},
extra AS (SELECT count(*) - count(DISTINCT text) AS d FROM documents)
SELECT count(DISTINCT source_file) AS processed_files, count(*) AS cycle_rows, count(*) FILTER (cycle_type = 'invalid') AS invalid_count,
       count(*) FILTER (cycle_type = 'nonstandard_cycle') AS nonstandard_cycle_count,
       count(*) FILTER (cycle_type = 'standard_full_cycle') AS standard_full_cycle_count,
       (SELECT d FROM extra) AS duplicate_files, count(DISTINCT source_file) + (SELECT d FROM extra) AS raw_files FROM typed""")
def processing_summary(spark, sf_dir):
    skipped = C.duplicate_files(C.fingerprints(_document_lines(spark, sf_dir), "doc_id", "line_no", ["line"]), "doc_id")
    return C.processing_summary(_cycle_table(spark, sf_dir), skipped)


# --- health ---

LABELS = "cell_id, cycle, capacity_ah, is_modeling_cycle, round(initial_capacity, 9) AS initial_capacity, round(soh, 9) AS soh, " \
         "eol_cycle, first_below_cycle, is_censored, rul, rul_clipped"


@query("health_labels", f"WITH {B.SQL_LABELLED} SELECT {LABELS} FROM labelled")
def health_labels(spark, sf_dir):
    return B.rounded(B.labelled_cycles(spark, sf_dir).select(
        "cell_id", "cycle", "capacity_ah", "is_modeling_cycle", "initial_capacity", "soh", "eol_cycle", "first_below_cycle",
        "is_censored", "rul", "rul_clipped",
    ), 9)


@query("life_stages", f"WITH {B.SQL_STAGED} SELECT cell_id, cycle, post_eol, life_stage FROM staged")
def life_stages(spark, sf_dir):
    return B.staged_cycles(spark, sf_dir).select("cell_id", "cycle", "post_eol", "life_stage")


@query("life_stage_counts", f"""WITH {B.SQL_STAGED}
SELECT CAST(place AS INT) AS place, k.life_stage, count(s.life_stage) AS n
FROM (VALUES (0, 'pre_eol'), (1, 'eol'), (2, 'post_eol'), (3, 'excluded')) k(place, life_stage) LEFT JOIN staged s USING (life_stage) GROUP BY 1, 2""")
def life_stage_counts(spark, sf_dir):
    return C.type_counts(B.staged_cycles(spark, sf_dir), "life_stage", H.STAGES)


FADE_SQL = f"""WITH {B.SQL_STAGED},
fade AS (
  SELECT cell_id, count(*) AS row_count, count(*) FILTER (is_modeling_cycle) AS modeling_cycle_count,
         count(*) FILTER (NOT is_modeling_cycle) AS excluded_cycle_count, count(*) FILTER (life_stage = 'pre_eol') AS pre_eol_count,
         count(*) FILTER (life_stage = 'eol') AS eol_count, count(*) FILTER (life_stage = 'post_eol') AS post_eol_count,
         max(initial_capacity) AS initial_capacity, arg_min(capacity_ah, cycle) FILTER (is_modeling_cycle) AS first_capacity,
         arg_max(capacity_ah, cycle) FILTER (is_modeling_cycle) AS last_capacity, min(soh) AS soh_min, max(soh) AS soh_max,
         max(eol_cycle) AS eol_cycle, min(rul) AS rul_min, max(rul) AS rul_max, min(rul_clipped) AS rul_clipped_min,
         max(rul_clipped) AS rul_clipped_max,
         CASE WHEN count(*) FILTER (life_stage = 'pre_eol') > 1 THEN regr_slope(capacity_ah, cycle) FILTER (life_stage = 'pre_eol') END AS pre_eol_slope,
         CASE WHEN count(*) FILTER (life_stage = 'post_eol') > 1 THEN regr_slope(capacity_ah, cycle) FILTER (life_stage = 'post_eol') END AS post_eol_slope
  FROM staged GROUP BY 1)
SELECT cell_id, row_count, modeling_cycle_count, excluded_cycle_count, pre_eol_count, eol_count, post_eol_count,
       {_round_sql(('initial_capacity', 'first_capacity', 'last_capacity', 'soh_min', 'soh_max'))}, eol_cycle, rul_min, rul_max,
       rul_clipped_min, rul_clipped_max, {_round_sql(('pre_eol_slope', 'post_eol_slope'))},
       {r('last_capacity - first_capacity')} AS capacity_fade_ah, {r('(last_capacity / first_capacity - 1) * 100')} AS capacity_fade_percent,
       {r('abs(post_eol_slope) / nullif(abs(pre_eol_slope), 0)', 4)} AS post_to_pre_slope_ratio FROM fade"""


@query("fade_summary", FADE_SQL)
def fade_summary(spark, sf_dir):
    fade = H.fade_summary(B.staged_cycles(spark, sf_dir))
    return B.rounded(fade.withColumn("post_to_pre_slope_ratio", F.round("post_to_pre_slope_ratio", 4)))


@query("event_band", f"WITH {B.SQL_LABELLED} SELECT cell_id, cycle, capacity_ah, rul FROM labelled WHERE cycle BETWEEN eol_cycle - 5 AND eol_cycle + 10")
def event_band(spark, sf_dir):
    return H.event_band(B.labelled_cycles(spark, sf_dir)).select("cell_id", "cycle", "capacity_ah", "rul")


@query("large_drops", f"""WITH {B.SQL_HEALTH_CYCLES},
changed AS (SELECT cell_id, cycle, capacity_ah - lag(capacity_ah) OVER (PARTITION BY cell_id ORDER BY cycle) AS delta FROM cycles)
SELECT cell_id, cycle, {r('delta')} AS delta, coalesce(delta < -0.15, false) AS is_large_drop FROM changed""")
def large_drops(spark, sf_dir):
    drops = H.large_drops(B.health_cycles(spark, sf_dir), "cell_id", "cycle", "capacity_ah", -0.15)
    return B.rounded(drops.select("cell_id", "cycle", "delta", "is_large_drop"))


@query("risk_levels", f"""WITH {B.SQL_LABELLED}
SELECT cell_id, cycle, CASE WHEN soh < 0.8 THEN 'critical' WHEN soh < 0.9 THEN 'warning' WHEN soh IS NOT NULL THEN 'normal' END AS risk FROM labelled""")
def risk_levels(spark, sf_dir):
    return B.labelled_cycles(spark, sf_dir).select("cell_id", "cycle", risk_level(F.col("soh")).alias("risk"))


@query("cell_status", f"""WITH {B.SQL_LABELLED}
SELECT cell_id, max(cycle) AS last_cycle, {r('arg_max(soh, cycle) FILTER (soh IS NOT NULL)')} AS latest_soh,
       {r('max(initial_capacity) * 0.8')} AS threshold_capacity, max(eol_cycle) AS eol_cycle FROM labelled GROUP BY 1""")
def cell_status(spark, sf_dir):
    return B.rounded(H.status_row(B.labelled_cycles(spark, sf_dir)))


@query("single_and_sustained_crossing", f"WITH {B.SQL_LABELLED} SELECT cell_id, eol_cycle, first_below_cycle FROM eol")
def single_and_sustained_crossing(spark, sf_dir):
    labelled = B.labelled_cycles(spark, sf_dir).filter("is_modeling_cycle")
    series = labelled.select("cell_id", "cycle", "soh")
    return H.sustained_eol(series, ["cell_id"], "cycle", "soh")


@query("exponential_mean", f"""WITH RECURSIVE {B.SQL_HEALTH_CYCLES},
smooth(cell_id, cycle, capacity_ah, ewm) AS (
  SELECT cell_id, cycle, capacity_ah, capacity_ah FROM cycles WHERE cycle = 1
  UNION ALL
  SELECT c.cell_id, c.cycle, c.capacity_ah, 0.2::DOUBLE * c.capacity_ah + 0.8::DOUBLE * s.ewm
  FROM smooth s JOIN cycles c ON c.cell_id = s.cell_id AND c.cycle = s.cycle + 1)
SELECT cell_id, cycle, {r('ewm')} AS ewm FROM smooth""")
def exponential_mean_query(spark, sf_dir):
    smooth = exponential_mean(B.health_cycles(spark, sf_dir), ["cell_id"], ["cycle"], "capacity_ah", "ewm", span=9)
    return B.rounded(smooth.select("cell_id", "cycle", "ewm"))


@query("exponential_mean_with_gaps", f"""WITH RECURSIVE {B.SQL_HEALTH_CYCLES},
smooth(cell_id, cycle, ewm, weight) AS (
  SELECT cell_id, cycle, CASE WHEN is_modeling_cycle THEN capacity_ah END, 1.0::DOUBLE FROM cycles WHERE cycle = 1
  UNION ALL
  SELECT c.cell_id, c.cycle,
         CASE WHEN NOT is_modeling_cycle THEN s.ewm WHEN s.ewm IS NULL THEN c.capacity_ah
              ELSE (0.8::DOUBLE * s.weight * s.ewm + 0.2::DOUBLE * c.capacity_ah) / (0.8::DOUBLE * s.weight + 0.2::DOUBLE) END,
         CASE WHEN is_modeling_cycle THEN 1.0::DOUBLE ELSE 0.8::DOUBLE * s.weight END
  FROM smooth s JOIN cycles c ON c.cell_id = s.cell_id AND c.cycle = s.cycle + 1)
SELECT cell_id, cycle, {r('ewm')} AS ewm FROM smooth""")
def exponential_mean_with_gaps(spark, sf_dir):
    """The capacity of excluded cycles counts as missing: their rows stay and weights go on decaying over them."""
    holed = B.health_cycles(spark, sf_dir).withColumn("known", F.when(F.col("is_modeling_cycle"), F.col("capacity_ah")))
    smooth = exponential_mean(holed, ["cell_id"], ["cycle"], "known", "ewm", span=9, max_rows=200)
    return B.rounded(smooth.select("cell_id", "cycle", "ewm"))


@query("trailing_median", f"""WITH {B.SQL_HEALTH_CYCLES}
SELECT cell_id, cycle, {r('median(capacity_ah) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS smooth FROM cycles""")
def trailing_median(spark, sf_dir):
    smooth = H.median_smoothed(B.health_cycles(spark, sf_dir), "cell_id", "cycle", "capacity_ah", "smooth")
    return B.rounded(smooth.select("cell_id", "cycle", "smooth"))


def _past(n: int) -> str:
    return f"(PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _digits_sql(*columns: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


@query("strict_window_features", f"""WITH {B.SQL_HEALTH_CYCLES},
wide AS (
  SELECT cell_id, cycle, lag(capacity_ah, 1) OVER w AS lag_1, lag(capacity_ah, 3) OVER w AS lag_3, lag(capacity_ah, 5) OVER w AS lag_5,
         CASE WHEN count(capacity_ah) OVER {_past(5)} = 5 THEN avg(capacity_ah) OVER {_past(5)} END AS rolling_mean_5,
         CASE WHEN count(capacity_ah) OVER {_past(10)} = 10 THEN avg(capacity_ah) OVER {_past(10)} END AS rolling_mean_10,
         CASE WHEN count(capacity_ah) OVER {_past(5)} = 5 THEN stddev_samp(capacity_ah) OVER {_past(5)} END AS rolling_std_5,
         CASE WHEN count(capacity_ah) OVER {_past(5)} = 5 THEN regr_slope(capacity_ah, cycle) OVER {_past(5)} END AS rolling_slope_5
  FROM cycles WINDOW w AS (PARTITION BY cell_id ORDER BY cycle))
SELECT cell_id, cycle, lag_1, lag_3, lag_5, {_digits_sql('rolling_mean_5', 'rolling_mean_10', 'rolling_std_5', 'rolling_slope_5')}
FROM wide WHERE rolling_mean_10 IS NOT NULL""")
def strict_window_features(spark, sf_dir):
    wide = supervised(B.health_cycles(spark, sf_dir), "cell_id", "capacity_ah", strict=True, pos="cycle")
    rolled = ["rolling_mean_5", "rolling_mean_10", "rolling_std_5", "rolling_slope_5"]
    return wide.select("cell_id", "cycle", "lag_1", "lag_3", "lag_5", *[F.round(c, 6).alias(c) for c in rolled])


@query("period_window_features", f"""WITH {B.SQL_HEALTH_CYCLES},
wide AS (
  SELECT cell_id, cycle, {', '.join(f"lag(capacity_ah, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 5, 10))},
         avg(capacity_ah) OVER {_past(5)} AS rolling_mean_5, avg(capacity_ah) OVER {_past(10)} AS rolling_mean_10,
         stddev_samp(capacity_ah) OVER {_past(10)} AS rolling_std_10,
         cycle / max(cycle) OVER (PARTITION BY cell_id) AS cycle_norm
  FROM cycles WINDOW w AS (PARTITION BY cell_id ORDER BY cycle))
SELECT cell_id, cycle, lag_1, lag_2, lag_3, lag_5, lag_10, {_digits_sql('rolling_mean_5', 'rolling_mean_10', 'rolling_std_10', 'cycle_norm')}
FROM wide WHERE lag_10 IS NOT NULL""")
def period_window_features(spark, sf_dir):
    cycles = scaled_position(B.health_cycles(spark, sf_dir), ["cell_id"])
    wide = supervised(cycles, "cell_id", "capacity_ah", strict=False, pos="cycle")
    rolled = ["rolling_mean_5", "rolling_mean_10", "rolling_std_10", "cycle_norm"]
    return wide.select("cell_id", "cycle", *[f"lag_{k}" for k in (1, 2, 3, 5, 10)], *[F.round(c, 6).alias(c) for c in rolled])
