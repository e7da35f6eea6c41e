"""Rolling-origin backtests: scenarios, baseline and learned forecasts, errors, decisions, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import checks as K
from tidegauge.operators import decisions as D
from tidegauge.operators import errors as E
from tidegauge.operators import forecast as M
from tidegauge.operators import health as H
from tidegauge.operators import scenarios as S
from tidegauge.operators.ordered import exponential_mean
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r
from tidegauge.session import settle, shuffled

SCENARIO_COLUMNS = (
    "scenario_id", "scenario_type", "cell_id", "origin_position", "forecast_origin", "origin_capacity_ah", "origin_soh",
    "origin_below_threshold", "horizon", "rul_lead_horizon", "train_rows", "test_rows", "test_start_cycle", "test_end_cycle",
    "true_eol_cycle", "true_rul", "includes_eol", "includes_eol_confirmation",
)


@query("rolling_scenarios", f"WITH {B.SQL_SCENARIOS} SELECT * REPLACE (round(origin_soh, 6) AS origin_soh) FROM scenarios")
def rolling_scenarios(spark, sf_dir):
    return B.rounded(B.scenarios_of(B.modelling_series(spark, sf_dir)).select(*SCENARIO_COLUMNS))


@query("scenario_test_rows", f"""WITH {B.SQL_SCENARIOS}
SELECT c.cell_id, c.scenario_id, s.cycle, s.capacity_ah FROM scenarios c
JOIN series s ON s.cell_id = c.cell_id AND s.cycle > c.forecast_origin AND s.cycle <= c.forecast_origin + c.horizon""")
def scenario_test_rows(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    rows = series.select("cell_id", "cycle", "capacity_ah")
    return S.test_rows(rows, B.scenarios_of(series)).select("cell_id", "scenario_id", "cycle", "capacity_ah")


@query("scenario_training_rows", f"""WITH {B.SQL_SCENARIOS}
SELECT s.cell_id, c.forecast_origin, count(*) AS n, max(s.cycle) AS last_cycle, {r('sum(s.capacity_ah)', 4)} AS total
FROM (SELECT DISTINCT cell_id, forecast_origin FROM scenarios) c
JOIN series s ON s.cell_id = c.cell_id AND s.cycle <= c.forecast_origin GROUP BY 1, 2""")
def scenario_training_rows(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    rows = series.select("cell_id", "cycle", "capacity_ah")
    return S.training_rows(rows, B.scenarios_of(series)).groupBy("cell_id", "forecast_origin").agg(
        F.count("*").alias("n"), F.max("cycle").alias("last_cycle"), F.round(F.sum("capacity_ah"), 4).alias("total")
    )


@query("incomplete_scenarios", f"""WITH {B.SQL_SCENARIOS},
found AS (SELECT c.cell_id, c.scenario_id, count(s.cycle) AS found FROM scenarios c
  LEFT JOIN series s ON s.cell_id = c.cell_id AND s.cycle > c.forecast_origin AND s.cycle <= c.forecast_origin + c.horizon GROUP BY 1, 2)
SELECT cell_id, scenario_id, horizon, found FROM scenarios JOIN found USING (cell_id, scenario_id) WHERE found <> horizon""")
def incomplete_scenarios(spark, sf_dir):
    """Excluded cycles inside a horizon counted by cycle leave it short; horizons counted by position are not."""
    series = B.modelling_series(spark, sf_dir)
    scenarios = B.scenarios_of(series)
    tests = S.test_rows(series.select("cell_id", "cycle"), scenarios)
    return S.incomplete_scenarios(tests, scenarios)


@query("origin_rows", f"WITH {B.SQL_SCENARIOS} SELECT DISTINCT cell_id, forecast_origin, origin_position, origin_capacity_ah FROM scenarios")
def origin_rows(spark, sf_dir):
    scenarios = B.scenarios_of(B.modelling_series(spark, sf_dir))
    return scenarios.select("cell_id", "forecast_origin", "origin_position", "origin_capacity_ah").distinct()


@query("ratio_splits", f"""WITH {B.SQL_SCENARIOS},
sizes AS (SELECT cell_id, count(*) AS n FROM series GROUP BY 1)
SELECT cell_id, cycle, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM series JOIN sizes USING (cell_id)""")
def ratio_splits(spark, sf_dir):
    return S.ratio_split(B.modelling_series(spark, sf_dir), "cell_id", 0.7).select("cell_id", "cycle", "role")


FORECAST_COLUMNS = ("cell_id", "scenario_id", "model_name", "step", "cycle")


@query("baseline_forecasts", f"""WITH {B.SQL_FORECASTS}
SELECT {', '.join(FORECAST_COLUMNS)}, y_true_capacity, {r('y_raw')} AS y_raw, {r('y_pred_capacity')} AS y_pred_capacity,
       {r('y_pred_soh', 5)} AS y_pred_soh FROM forecasts""")
def baseline_forecasts(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    return forecasts.select(
        *FORECAST_COLUMNS, "y_true_capacity", F.round("y_raw", 6).alias("y_raw"),
        F.round("y_pred_capacity", 6).alias("y_pred_capacity"), F.round("y_pred_soh", 5).alias("y_pred_soh"),
    )


KEYS = ("cell_id", "scenario_id", "scenario_type", "model_name")


def _errors(percent: bool, source: str = "forecasts", extra: str = "") -> str:
    def three(actual: str, predicted: str, prefix: str) -> str:
        share = f"2 * abs({predicted} - {actual}) / nullif(abs({actual}) + abs({predicted}), 0)"
        smape = f"avg({share}) * 100" if percent else f"avg(coalesce({share}, 0))"
        return (f"avg(abs({predicted} - {actual})) AS {prefix}mae, sqrt(avg(({predicted} - {actual}) ** 2)) AS {prefix}rmse, "
                f"{smape} AS {prefix}smape")

    return f"""scenario_errors AS (
  SELECT {', '.join(KEYS)}{extra}, count(*) AS n, {three('y_true_capacity', 'y_pred_capacity', 'capacity_')},
         {three('y_true_soh', 'y_pred_soh', 'soh_')} FROM {source} GROUP BY {', '.join(KEYS)}{extra})"""


METRICS = ("capacity_mae", "capacity_rmse", "capacity_smape", "soh_mae", "soh_rmse", "soh_smape")


def _metrics_sql() -> str:
    return ", ".join(f"{r(m, 7)} AS {m}" for m in METRICS)


@query("scenario_errors", f"WITH {B.SQL_FORECASTS}, {_errors(True)} SELECT {', '.join(KEYS)}, n, {_metrics_sql()} FROM scenario_errors")
def scenario_errors(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    return B.rounded(E.scenario_errors(forecasts, KEYS), 7)


@query("scenario_errors_fraction", f"WITH {B.SQL_FORECASTS}, {_errors(False)} SELECT {', '.join(KEYS)}, n, {_metrics_sql()} FROM scenario_errors")
def scenario_errors_fraction(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    return B.rounded(E.scenario_errors(forecasts, KEYS, percent=False), 7)


LEADER_SQL = f"""leaders AS (
  SELECT scenario_type, model_name, count(DISTINCT (cell_id, scenario_id)) AS scenario_count, avg(capacity_mae) AS capacity_mae_mean,
         stddev_samp(capacity_mae) AS capacity_mae_std, avg(capacity_rmse) AS capacity_rmse_mean, avg(capacity_smape) AS capacity_smape_mean,
         avg(soh_mae) AS soh_mae_mean FROM scenario_errors GROUP BY 1, 2)"""
LEADER_METRICS = ("capacity_mae_mean", "capacity_mae_std", "capacity_rmse_mean", "capacity_smape_mean", "soh_mae_mean")


@query("forecast_leaderboard", f"""WITH {B.SQL_FORECASTS}, {_errors(True)}, {LEADER_SQL}
SELECT scenario_type, model_name, scenario_count, {', '.join(f'{r(m)} AS {m}' for m in LEADER_METRICS)} FROM leaders""")
def forecast_leaderboard(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    errors = E.scenario_errors(forecasts, KEYS)
    return B.rounded(E.leaderboard(errors, ["scenario_type", "model_name"]))


@query("errors_by_horizon", f"""WITH {B.SQL_FORECASTS}
SELECT model_name, horizon, rul_lead_horizon, count(*) AS n, {r('avg(abs(y_pred_capacity - y_true_capacity))')} AS capacity_mae
FROM forecasts GROUP BY 1, 2, 3""")
def errors_by_horizon(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    return B.rounded(E.errors_by(forecasts, ["model_name", "horizon", "rul_lead_horizon"]))


QUANTILES = [f"y_pred_{t}_{q}" for t in ("capacity", "soh") for q in ("q10", "q50", "q90")]


@query("forecast_intervals", f"""WITH {B.SQL_INTERVALS}
SELECT {', '.join(FORECAST_COLUMNS)}, {', '.join(f'{r(q, 5)} AS {q}' for q in QUANTILES)} FROM intervals""")
def forecast_intervals(spark, sf_dir):
    intervals, _, _ = B.interval_table(spark, sf_dir)
    return intervals.select(*FORECAST_COLUMNS, *[F.round(q, 5).alias(q) for q in QUANTILES])


@query("interval_quality", f"""WITH {B.SQL_INTERVALS}
SELECT model_name, scenario_type, count(*) AS n,
       {r('avg(CAST(y_true_capacity BETWEEN y_pred_capacity_q10 AND y_pred_capacity_q90 AS INT))')} AS coverage,
       {r('avg(y_pred_capacity_q90 - y_pred_capacity_q10)')} AS mean_width,
       {r('avg(CAST(y_true_capacity < y_pred_capacity_q10 AS INT))')} AS below_share,
       {r('avg(CAST(y_true_capacity > y_pred_capacity_q90 AS INT))')} AS above_share
FROM intervals WHERE y_pred_capacity_q10 IS NOT NULL GROUP BY 1, 2""")
def interval_quality(spark, sf_dir):
    intervals, _, _ = B.interval_table(spark, sf_dir)
    return B.rounded(E.interval_quality(intervals, ["model_name", "scenario_type"]))


def _crossing_sql(name: str, health: str, strict: bool) -> str:
    guard = f"CASE WHEN bool_and({health} IS NOT NULL) THEN " if strict else ""
    return f"""{name} AS (
  SELECT cell_id, scenario_id, model_name, {guard}min(CASE WHEN starts THEN cycle END){' END' if strict else ''} AS {name}_cycle FROM (
    SELECT cell_id, scenario_id, model_name, cycle, {health},
           count(*) OVER f = 5 AND min(CAST(coalesce({health} < 0.8, false) AS INT)) OVER f = 1 AS starts
    FROM SOURCE WINDOW f AS (PARTITION BY cell_id, scenario_id, model_name ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  GROUP BY 1, 2, 3)"""


DECISION_SQL = B.SQL_FORECASTS + ",\n" + _crossing_sql("crossing", "y_pred_soh", False).replace("SOURCE", "forecasts") + """,
ends AS (SELECT cell_id, scenario_id, model_name, max(cycle) AS forecast_end_cycle FROM forecasts GROUP BY 1, 2, 3),
decisions AS (
  SELECT c.cell_id, c.scenario_id, s.scenario_type, c.model_name, s.forecast_origin, s.origin_soh,
         CASE WHEN s.origin_soh < 0.8 THEN 'critical' WHEN s.origin_soh < 0.9 THEN 'warning' ELSE 'normal' END AS origin_risk_level,
         s.origin_below_threshold, s.horizon, e.forecast_end_cycle, s.true_eol_cycle, s.true_rul, s.includes_eol AS true_event_in_horizon,
         crossing_cycle AS predicted_eol_cycle, crossing_cycle - s.forecast_origin AS predicted_rul, crossing_cycle IS NULL AS is_censored,
         CASE WHEN s.includes_eol AND crossing_cycle IS NOT NULL THEN 'true_positive' WHEN s.includes_eol THEN 'false_negative'
              WHEN crossing_cycle IS NOT NULL THEN 'false_positive' ELSE 'true_negative' END AS event_status,
         crossing_cycle - s.true_eol_cycle AS eol_cycle_error, crossing_cycle - s.forecast_origin - s.true_rul AS rul_error,
         abs(crossing_cycle - s.forecast_origin - s.true_rul) AS abs_rul_error
  FROM crossing c JOIN scenarios s USING (cell_id, scenario_id) JOIN ends e USING (cell_id, scenario_id, model_name))"""


@query("end_of_life_decisions", f"WITH {DECISION_SQL} SELECT * REPLACE (round(origin_soh, 6) AS origin_soh) FROM decisions")
def end_of_life_decisions(spark, sf_dir):
    forecasts, scenarios, _ = B.baseline_table(spark, sf_dir)
    return B.rounded(D.evaluate_decisions(forecasts, scenarios))


def _metric_sql(source: str) -> str:
    hit = "event_status = 'true_positive'"
    return f"""counted AS (
  SELECT model_name, count(*) FILTER ({hit}) AS true_positive, count(*) FILTER (event_status = 'false_negative') AS false_negative,
         count(*) FILTER (event_status = 'false_positive') AS false_positive, count(*) FILTER (event_status = 'true_negative') AS true_negative,
         avg(abs(rul_error)) FILTER ({hit}) AS rul_mae_detected, sqrt(avg(rul_error ** 2) FILTER ({hit})) AS rul_rmse_detected,
         avg(rul_error) FILTER ({hit}) AS rul_bias_detected, count(*) FILTER ({hit} AND rul_error < 0) AS early_warning_count,
         count(*) FILTER ({hit} AND rul_error > 0) AS late_warning_count, count(*) FILTER ({hit} AND rul_error = 0) AS exact_warning_count
  FROM {source} GROUP BY 1),
metrics AS (
  SELECT *, true_positive / nullif(true_positive + false_positive, 0) AS precision, true_positive / nullif(true_positive + false_negative, 0) AS eol_detection_rate,
         true_negative / nullif(true_negative + false_positive, 0) AS specificity, false_positive / nullif(true_negative + false_positive, 0) AS false_alarm_rate,
         true_positive AS rul_detected_count FROM counted)"""


RATES = ("rul_mae_detected", "rul_rmse_detected", "rul_bias_detected", "precision", "eol_detection_rate", "specificity", "false_alarm_rate")
ROUND_RATES = "* REPLACE (" + ", ".join(f"{r(m)} AS {m}" for m in RATES) + ")"


@query("decision_metrics", f"WITH {DECISION_SQL}, {_metric_sql('decisions')} SELECT {ROUND_RATES} FROM metrics")
def decision_metrics(spark, sf_dir):
    forecasts, scenarios, _ = B.baseline_table(spark, sf_dir)
    return B.rounded(D.decision_metrics(D.evaluate_decisions(forecasts, scenarios), ["model_name"]))


@query("decision_leaderboard", f"""WITH {DECISION_SQL}, {_metric_sql('decisions')}, {_errors(True)},
point AS (SELECT model_name, avg(capacity_mae) AS capacity_mae FROM scenario_errors GROUP BY 1)
SELECT model_name, {r('eol_detection_rate')} AS eol_detection_rate, {r('false_alarm_rate')} AS false_alarm_rate, {r('rul_mae_detected')} AS rul_mae_detected,
       {r('capacity_mae')} AS capacity_mae, CAST(row_number() OVER (ORDER BY eol_detection_rate DESC NULLS LAST, false_alarm_rate NULLS LAST,
         rul_mae_detected NULLS LAST, capacity_mae NULLS LAST, model_name) AS INT) AS rank
FROM point LEFT JOIN metrics USING (model_name)""")
def decision_leaderboard(spark, sf_dir):
    forecasts, scenarios, _ = B.baseline_table(spark, sf_dir)
    point = E.scenario_errors(forecasts, KEYS).groupBy("model_name").agg(F.avg("capacity_mae").alias("capacity_mae"))
    metrics = D.decision_metrics(D.evaluate_decisions(forecasts, scenarios), ["model_name"])
    table = D.ranked(point.join(metrics, "model_name", "left"), D.decision_order(with_capacity=True))
    return B.rounded(table.select("model_name", "eol_detection_rate", "false_alarm_rate", "rul_mae_detected", "capacity_mae", "rank"))


QUANTILE_SQL = B.SQL_INTERVALS + "".join(
    ",\n" + _crossing_sql(q, f"y_pred_soh_{q}", True).replace("SOURCE", "intervals") for q in ("q10", "q50", "q90")
) + """,
supported AS (SELECT cell_id, scenario_id, model_name, bool_or(y_pred_soh_q10 IS NOT NULL) AS supports_quantiles, max(cycle) AS forecast_end_cycle
  FROM intervals GROUP BY 1, 2, 3),
decisions AS (
  SELECT a.cell_id, a.scenario_id, s.scenario_type, a.model_name, s.forecast_origin, s.true_rul, s.includes_eol_confirmation AS true_event_in_horizon,
         supports_quantiles, q10_cycle AS predicted_eol_cycle_q10, q50_cycle AS predicted_eol_cycle_q50, q90_cycle AS predicted_eol_cycle_q90,
         q10_cycle - s.forecast_origin AS predicted_rul_q10, q50_cycle - s.forecast_origin AS predicted_rul_q50, q90_cycle - s.forecast_origin AS predicted_rul_q90,
         CASE WHEN s.includes_eol_confirmation AND q50_cycle IS NOT NULL THEN 'true_positive' WHEN s.includes_eol_confirmation THEN 'false_negative'
              WHEN q50_cycle IS NOT NULL THEN 'false_positive' ELSE 'true_negative' END AS event_status,
         CASE WHEN s.includes_eol_confirmation THEN q50_cycle - s.forecast_origin - s.true_rul END AS rul_error,
         q10_cycle IS NOT NULL AND q90_cycle IS NOT NULL AS rul_interval_available,
         CASE WHEN q10_cycle IS NOT NULL AND q90_cycle IS NOT NULL
              THEN s.true_rul BETWEEN q10_cycle - s.forecast_origin AND q90_cycle - s.forecast_origin END AS rul_interval_covers_true
  FROM q10 a JOIN q50 b USING (cell_id, scenario_id, model_name) JOIN q90 c USING (cell_id, scenario_id, model_name)
  JOIN supported t USING (cell_id, scenario_id, model_name) JOIN scenarios s USING (cell_id, scenario_id))"""


def _quantile_decisions(spark, sf_dir):
    intervals, scenarios, _ = B.interval_table(spark, sf_dir)
    return D.evaluate_decisions(
        intervals, scenarios, event="includes_eol_confirmation", errors_on_true_events_only=True, quantiles=True
    )


@query("quantile_decisions", f"WITH {QUANTILE_SQL} SELECT * FROM decisions")
def quantile_decisions(spark, sf_dir):
    return _quantile_decisions(spark, sf_dir).select(
        "cell_id", "scenario_id", "scenario_type", "model_name", "forecast_origin", "true_rul", "true_event_in_horizon", "supports_quantiles",
        *[f"predicted_eol_cycle_{q}" for q in ("q10", "q50", "q90")], *[f"predicted_rul_{q}" for q in ("q10", "q50", "q90")],
        "event_status", "rul_error", "rul_interval_available", "rul_interval_covers_true",
    )


@query("quantile_decision_metrics", f"""WITH {QUANTILE_SQL}, {_metric_sql('decisions')},
extra AS (SELECT model_name, """ + ", ".join(
    f"{r(f'avg(CAST(predicted_eol_cycle_{q} IS NOT NULL AS INT)) FILTER (true_event_in_horizon AND supports_quantiles)')} AS {q}_detection_rate"
    for q in ("q10", "q50", "q90")) + f""",
  count(*) FILTER (true_event_in_horizon AND rul_interval_available) AS rul_interval_count,
  {r('avg(CAST(rul_interval_covers_true AS INT)) FILTER (true_event_in_horizon AND rul_interval_available)')} AS rul_interval_coverage
  FROM decisions GROUP BY 1)
SELECT {ROUND_RATES} FROM metrics JOIN extra USING (model_name)""")
def quantile_decision_metrics(spark, sf_dir):
    return B.rounded(D.decision_metrics(_quantile_decisions(spark, sf_dir), ["model_name"], quantiles=True))


def _truth_check_sql() -> str:
    return f"""WITH {B.SQL_FORECASTS}
SELECT cell_id, scenario_id, step, min(y_true_capacity) AS low, max(y_true_capacity) AS high, count(*) AS n
FROM forecasts GROUP BY 1, 2, 3 HAVING low <> high"""


@query("models_share_truth", _truth_check_sql())
def models_share_truth(spark, sf_dir):
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    return K.differing_truth(forecasts, ["cell_id", "scenario_id", "step"], "y_true_capacity")


@query("forecast_row_contract", f"""WITH {B.SQL_FORECASTS},
found AS (SELECT cell_id, scenario_id, model_name, count(*) AS found FROM forecasts GROUP BY 1, 2, 3)
SELECT f.*, s.horizon FROM found f JOIN scenarios s USING (cell_id, scenario_id) WHERE found <> horizon""")
def forecast_row_contract(spark, sf_dir):
    forecasts, scenarios, _ = B.baseline_table(spark, sf_dir)
    return K.wrong_row_counts(forecasts, scenarios, ["cell_id", "scenario_id"], "model_name")


@query("missing_forecast_rows", f"""WITH {B.SQL_FORECASTS},
given AS (SELECT * FROM forecasts WHERE NOT (model_name = 'LinearTrend' AND scenario_id LIKE 'eol%lead10%') AND NOT (model_name = 'Persistence' AND step = 2 AND horizon = 20)),
frame AS (SELECT cell_id, scenario_id, horizon, model_name FROM scenarios, (SELECT DISTINCT model_name FROM forecasts)),
found AS (SELECT cell_id, scenario_id, model_name, count(*) AS n FROM given GROUP BY 1, 2, 3)
SELECT f.cell_id, f.scenario_id, f.horizon, f.model_name, coalesce(n, 0) AS found
FROM frame f LEFT JOIN found g ON g.cell_id = f.cell_id AND g.scenario_id = f.scenario_id AND g.model_name = f.model_name WHERE coalesce(n, 0) <> horizon""")
def missing_forecast_rows(spark, sf_dir):
    """The contract over forecasts of which some scenarios lack a step and some have no row of one model at all."""
    forecasts, scenarios, _ = B.baseline_table(spark, sf_dir)
    model = F.col("model_name")
    whole = (model == "LinearTrend") & F.col("scenario_id").like("eol%lead10%")
    part = (model == "Persistence") & (F.col("step") == 2) & (F.col("horizon") == 20)
    return K.wrong_row_counts(forecasts.filter(~whole & ~part), scenarios, ["cell_id", "scenario_id"], "model_name", M.BASELINES)


@query("differing_truth_found", f"""WITH {B.SQL_FORECASTS}
SELECT cell_id, scenario_id, step, min(t) AS low, max(t) AS high, count(*) AS n FROM (
  SELECT *, CASE WHEN model_name = 'MovingAverage' AND step = 3 THEN y_true_capacity + 1 ELSE y_true_capacity END AS t FROM forecasts)
GROUP BY 1, 2, 3 HAVING min(t) <> max(t)""")
def differing_truth_found(spark, sf_dir):
    """One model scored against another truth at one step: the contract names these steps."""
    forecasts, _, _ = B.baseline_table(spark, sf_dir)
    off = (F.col("model_name") == "MovingAverage") & (F.col("step") == 3)
    altered = forecasts.withColumn("y_true_capacity", F.when(off, F.col("y_true_capacity") + 1).otherwise(F.col("y_true_capacity")))
    return K.differing_truth(altered, ["cell_id", "scenario_id", "step"], "y_true_capacity")


@query("broken_quantiles_found", f"""WITH {B.SQL_INTERVALS}
SELECT cell_id, scenario_id, model_name, step FROM intervals WHERE y_pred_capacity_q10 IS NOT NULL AND step % 5 = 0
UNION ALL SELECT cell_id, scenario_id, model_name, step FROM intervals WHERE model_name = 'Persistence' AND step = 1""")
def broken_quantiles_found(spark, sf_dir):
    """Bands turned over at every fifth step, and a negative middle: the contract names these rows."""
    intervals, _, _ = B.interval_table(spark, sf_dir)
    fifth, negative = F.col("step") % 5 == 0, (F.col("model_name") == "Persistence") & (F.col("step") == 1)
    q10, q50, q90 = (f"y_pred_capacity_{q}" for q in ("q10", "q50", "q90"))
    altered = intervals.withColumns({
        q10: F.when(fifth, F.col(q90) + 1).otherwise(F.col(q10)), q50: F.when(negative, F.lit(-1.0)).otherwise(F.col(q50))})
    return K.broken_quantiles(altered, q10, q50, q90).select("cell_id", "scenario_id", "model_name", "step")


@query("quantile_order_contract", f"""WITH {B.SQL_INTERVALS}
SELECT cell_id, scenario_id, model_name, step FROM intervals
WHERE coalesce(y_pred_capacity_q10 > y_pred_capacity_q50 OR y_pred_capacity_q50 > y_pred_capacity_q90, false)""")
def quantile_order_contract(spark, sf_dir):
    intervals, _, _ = B.interval_table(spark, sf_dir)
    broken = K.broken_quantiles(intervals, *[f"y_pred_capacity_{q}" for q in ("q10", "q50", "q90")])
    return broken.select("cell_id", "scenario_id", "model_name", "step")


@query("stacked_model_tables", f"""WITH {B.SQL_INTERVALS}
SELECT cell_id, scenario_id, model_name, step, NULL::DOUBLE AS q10, NULL::DOUBLE AS q90 FROM forecasts WHERE model_name <> 'MovingAverage'
UNION ALL SELECT cell_id, scenario_id, model_name, step, {r('y_pred_capacity_q10', 5)}, {r('y_pred_capacity_q90', 5)} FROM intervals WHERE model_name = 'MovingAverage'""")
def stacked_model_tables(spark, sf_dir):
    """Tables of point and interval models stacked; columns only one of them has are NULL for the other."""
    intervals, _, _ = B.interval_table(spark, sf_dir)
    keep = ["cell_id", "scenario_id", "model_name", "step"]
    point = intervals.filter("model_name <> 'MovingAverage'").select(*keep)
    banded = intervals.filter("model_name = 'MovingAverage'").select(
        *keep, F.round("y_pred_capacity_q10", 5).alias("q10"), F.round("y_pred_capacity_q90", 5).alias("q90")
    )
    return point.unionByName(banded, allowMissingColumns=True)


def _variants(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    smooth = exponential_mean(series, ["cell_id"], ["cycle"], "capacity_ah", "ewm", span=9)
    return series, H.median_smoothed(smooth, "cell_id", "cycle", "capacity_ah", "median7")


@query("target_variants", f"""WITH RECURSIVE {B.SQL_SCENARIOS},
smooth(cell_id, pos, ewm) AS (
  SELECT cell_id, pos, capacity_ah FROM series WHERE pos = 0
  UNION ALL
  SELECT s.cell_id, s.pos, 0.2::DOUBLE * s.capacity_ah + 0.8::DOUBLE * m.ewm FROM smooth m JOIN series s ON s.cell_id = m.cell_id AND s.pos = m.pos + 1),
wide AS (
  SELECT s.cell_id, s.pos, capacity_ah AS capacity_raw, ewm AS capacity_ewm_span_9,
         median(capacity_ah) OVER (PARTITION BY s.cell_id ORDER BY s.pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS capacity_roll_median_7
  FROM series s JOIN smooth USING (cell_id, pos)),
long AS (
  SELECT * FROM (UNPIVOT wide ON capacity_raw, capacity_ewm_span_9, capacity_roll_median_7 INTO NAME target_name VALUE target)),
stats AS (
  SELECT cell_id, pos, target_name, target AS persistence, avg(target) OVER (PARTITION BY cell_id, target_name ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS moving
  FROM long),
predicted AS (
  SELECT c.cell_id, c.scenario_id, c.scenario_type, st.target_name, m.model_name, c.origin_position + t.step AS target_pos,
         CASE m.model_name WHEN 'Persistence' THEN persistence ELSE moving END AS y
  FROM scenarios c JOIN stats st ON st.cell_id = c.cell_id AND st.pos = c.origin_position,
       LATERAL (SELECT unnest(range(1, c.horizon + 1)) AS step) t, (SELECT unnest(['Persistence', 'MovingAverage']) AS model_name) m)
SELECT p.target_name, scenario_type, model_name, count(*) AS n, {r('avg(abs(y - l.target))')} AS own_mae, {r('avg(abs(y - s.capacity_ah))')} AS raw_mae
FROM predicted p JOIN long l ON l.cell_id = p.cell_id AND l.pos = target_pos AND l.target_name = p.target_name
JOIN series s ON s.cell_id = p.cell_id AND s.pos = target_pos GROUP BY 1, 2, 3""")
def target_variants(spark, sf_dir):
    """Raw and smoothed targets forecast alike, scored against themselves and against the raw value."""
    series, smooth = _variants(spark, sf_dir)
    scenarios = B.scenarios_of(series)
    columns = {"capacity_raw": "capacity_ah", "capacity_ewm_span_9": "ewm", "capacity_roll_median_7": "median7"}
    plans = scenarios.select("cell_id", "scenario_id", "scenario_type", "origin_position", "horizon")
    # targets stand side by side until each step has met its row: long tables would cross every shuffle three times
    forecasts = M.baseline_forecasts(
        settle(smooth.select("cell_id", "pos", *columns.values())), plans, columns, window=10, models=("Persistence", "MovingAverage"),
        aimed=list(columns.values()),
    )
    scored = E.target_variants(
        forecasts, columns, ["scenario_type", "model_name", "capacity_ah"], {"y_pred": {name: f"y_pred_{name}" for name in columns}})
    return B.rounded(scored.groupBy("target_name", "scenario_type", "model_name").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("target"))).alias("own_mae"),
        F.avg(F.abs(F.col("y_pred") - F.col("capacity_ah"))).alias("raw_mae"),
    ))


def _named_targets(spark, sf_dir):
    """(series by cell and target, scenarios by cell and target, long targets beside the raw value)."""
    series, smooth = _variants(spark, sf_dir)
    columns = {"capacity_raw": "capacity_ah", "capacity_ewm_span_9": "ewm", "capacity_roll_median_7": "median7"}
    long = settle(E.target_variants(smooth, columns, ["cell_id", "pos", "cycle", "capacity_ah"]))
    plans = B.scenarios_of(series).withColumn("target_name", F.explode(F.array(*[F.lit(n) for n in columns])))
    both = F.struct("cell_id", "target_name")
    return long.withColumn("series_id", both), plans.withColumn("series_id", both)


def _variant_errors(forecasts, long):
    scored = forecasts.withColumn("pos", F.col("origin_position") + F.col("step")).join(
        shuffled(long.select("series_id", "pos", "target", "capacity_ah")), ["series_id", "pos"])
    return B.rounded(scored.groupBy("target_name", "scenario_type", "model_name").agg(
        F.count("*").alias("n"), *E.error_columns("target", "y_pred", "own_", percent=False),
        *E.error_columns("capacity_ah", "y_pred", "raw_", percent=False)))


def _error_sql(actual: str, prefix: str) -> str:
    return (f"{r(f'avg(abs(y - {actual}))')} AS {prefix}_mae, {r(f'sqrt(avg((y - {actual}) ** 2))')} AS {prefix}_rmse, "
            f"{r(f'avg(coalesce(2 * abs(y - {actual}) / nullif(abs(y) + abs({actual}), 0), 0))')} AS {prefix}_smape")


@query("smoothed_target_ridge", f"""WITH RECURSIVE {B.SQL_SCENARIOS},
smooth(cell_id, pos, ewm) AS (
  SELECT cell_id, pos, capacity_ah FROM series WHERE pos = 0
  UNION ALL
  SELECT s.cell_id, s.pos, 0.2::DOUBLE * s.capacity_ah + 0.8::DOUBLE * m.ewm FROM smooth m JOIN series s ON s.cell_id = m.cell_id AND s.pos = m.pos + 1),
wide AS (
  SELECT s.cell_id, s.pos, s.cycle, capacity_ah AS raw_value, capacity_ah AS capacity_raw, ewm AS capacity_ewm_span_9,
         median(capacity_ah) OVER (PARTITION BY s.cell_id ORDER BY s.pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS capacity_roll_median_7
  FROM series s JOIN smooth USING (cell_id, pos)),
long AS (SELECT * FROM (UNPIVOT wide ON capacity_raw, capacity_ewm_span_9, capacity_roll_median_7 INTO NAME target_name VALUE target)),
fits AS (
  SELECT c.cell_id, c.forecast_origin, l.target_name, avg(l.cycle) AS mx, avg(l.target) AS my,
         covar_pop(l.target, l.cycle) / var_pop(l.cycle) * count(*) / (count(*) + 1.0) AS w
  FROM (SELECT DISTINCT cell_id, forecast_origin FROM scenarios) c JOIN long l ON l.cell_id = c.cell_id AND l.cycle <= c.forecast_origin GROUP BY 1, 2, 3),
predicted AS (
  SELECT c.scenario_type, l.target_name, greatest(f.my + f.w * (l.cycle - f.mx), 0) AS y, l.target, l.raw_value
  FROM scenarios c JOIN fits f USING (cell_id, forecast_origin), LATERAL (SELECT unnest(range(1, c.horizon + 1)) AS step) t
  JOIN long l ON l.cell_id = c.cell_id AND l.pos = c.origin_position + t.step AND l.target_name = f.target_name)
SELECT target_name, scenario_type, 'RidgeRegression' AS model_name, count(*) AS n, {_error_sql('target', 'own')}, {_error_sql('raw_value', 'raw')}
FROM predicted GROUP BY 1, 2""")
def smoothed_target_ridge(spark, sf_dir):
    """A learned model on raw and smoothed targets, scored against its own target and the raw value; on one feature it has a closed form."""
    long, plans = _named_targets(spark, sf_dir)
    return _variant_errors(M.ridge_forecasts(long, plans, "target", "series_id", names=("cycle",)), long)


@query("smoothed_target_models")
def smoothed_target_models(spark, sf_dir):
    """Recursive ridge forecasts of the same targets, with their whole features."""
    long, plans = _named_targets(spark, sf_dir)
    return _variant_errors(M.ridge_forecasts(long, plans, "target", "series_id", strict=False), long)


@query("ridge_forecasts")
def ridge_forecasts(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    forecasts = M.ridge_forecasts(series, B.scenarios_of(series))
    return E.leaderboard(E.scenario_errors(M.with_truth(forecasts, series), KEYS), ["scenario_type", "model_name"])


@query("ridge_forecasts_unscaled")
def ridge_forecasts_unscaled(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    forecasts = M.ridge_forecasts(series, B.scenarios_of(series), strict=False)
    return E.leaderboard(E.scenario_errors(M.with_truth(forecasts, series), KEYS), ["scenario_type", "model_name"])


@query("ridge_on_cycle", f"""WITH {B.SQL_SCENARIOS},
fits AS (
  SELECT c.cell_id, c.forecast_origin, avg(s.cycle) AS x, avg(s.capacity_ah) AS y,
         covar_pop(s.capacity_ah, s.cycle) / var_pop(s.cycle) * count(*) / (count(*) + 1.0) AS w
  FROM (SELECT DISTINCT cell_id, forecast_origin FROM scenarios) c
  JOIN series s ON s.cell_id = c.cell_id AND s.cycle <= c.forecast_origin GROUP BY 1, 2)
SELECT c.cell_id, c.scenario_id, t.step, s.cycle, {r('f.y + f.w * (s.cycle - f.x)')} AS y_raw
FROM scenarios c JOIN fits f USING (cell_id, forecast_origin), LATERAL (SELECT unnest(range(1, c.horizon + 1)) AS step) t
JOIN series s ON s.cell_id = c.cell_id AND s.pos = c.origin_position + t.step""")
def ridge_on_cycle(spark, sf_dir):
    """Ridge on one feature has a closed form: the slope shrinks by n / (n + alpha). Excluded cycles leave holes in every horizon."""
    series = B.modelling_series(spark, sf_dir)
    forecasts = M.ridge_forecasts(series, B.scenarios_of(series), names=("cycle",))
    return B.rounded(M.with_truth(forecasts, series).select("cell_id", "scenario_id", "step", "cycle", "y_raw"))


def _forest(spark, sf_dir):
    series = B.modelling_series(spark, sf_dir)
    slot = F.regexp_extract("scenario_id", r"(pre_\d+|lead\d+)", 1)
    scenarios = B.scenarios_of(series).withColumn("slot", slot)
    return settle(M.with_truth(M.forest_forecasts(series, scenarios), series)), scenarios, series


@query("forest_forecasts")
def forest_forecasts(spark, sf_dir):
    """One forest per origin slot (four origins before the event, three leads up to it), all cells and steps."""
    forecasts, scenarios, _ = _forest(spark, sf_dir)
    metrics = D.decision_metrics(D.evaluate_decisions(forecasts, scenarios), ["model_name"])
    leaders = E.leaderboard(E.scenario_errors(forecasts, KEYS, percent=False), ["scenario_type", "model_name"])
    return leaders.join(metrics, "model_name")


@query("forest_forecast_rows", f"""WITH {B.SQL_SCENARIOS}
SELECT c.cell_id, c.scenario_id, t.step, s.cycle, s.capacity_ah AS y_true_capacity, true AS within_training
FROM scenarios c, LATERAL (SELECT unnest(range(1, c.horizon + 1)) AS step) t
JOIN series s ON s.cell_id = c.cell_id AND s.pos = c.origin_position + t.step""")
def forest_forecast_rows(spark, sf_dir):
    """Every scenario step is forecast once, and a forest's mean of training values cannot leave their range."""
    forecasts, _, series = _forest(spark, sf_dir)
    bounds = series.agg(F.min("capacity_ah").alias("low"), F.max("capacity_ah").alias("high")).first()
    within = F.col("y_raw").between(bounds["low"] - 1e-9, bounds["high"] + 1e-9)
    return forecasts.select("cell_id", "scenario_id", "step", "cycle", "y_true_capacity", within.alias("within_training"))
