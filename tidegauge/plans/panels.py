"""Panel queries: labels, features, weather windows, calendar, serving lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.columns import calendar, ordinal_stage, reaches
from tidegauge.operators import panel as P
from tidegauge.operators.ordered import over_series
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r

LABEL_SQL = f"""labelled_events AS (
  SELECT site, day, lead(day) OVER w AS label_date, CAST(lead(day) OVER w - day AS INT) AS horizon_days,
         lead(value) OVER w AS label_value, CAST(lead(value) OVER w >= {B.EVENT_THRESHOLD} AS INT) AS target
  FROM panel WINDOW w AS (PARTITION BY site ORDER BY day)),
targets AS (SELECT * FROM labelled_events
  WHERE label_value IS NOT NULL AND horizon_days BETWEEN {B.EVENT_GAPS[0]} AND {B.EVENT_GAPS[1]})"""


def _rolling(column: str) -> str:
    parts = []
    for n in (3, 5):
        frame = f"(PARTITION BY site ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts += [
            f"{r(f'avg({column}) OVER {frame}')} AS {column}_rollmean{n}",
            f"{r(f'max({column}) OVER {frame}')} AS {column}_rollmax{n}",
            f"{r(f'stddev_samp({column}) OVER {frame}')} AS {column}_rollstd{n}",
        ]
    return ", ".join(parts)


def _lags(column: str, lags=(1, 2, 3, 4)) -> str:
    return ", ".join(f"lag({column}, {k}) OVER w AS {column}_lag{k}" for k in lags)


def _calendar(day: str) -> str:
    angle = f"2 * pi() * dayofyear({day}) / 365.25::DOUBLE"
    return (f"CAST(month({day}) AS INT) AS month, CAST(weekofyear({day}) AS INT) AS weekofyear, "
            f"{r(f'sin({angle})')} AS doy_sin, {r(f'cos({angle})')} AS doy_cos, "
            f"CAST(month({day}) BETWEEN 5 AND 10 AS INT) AS is_season")


FEATURE_SQL = f"""features AS (
  SELECT site, day, value AS cur_value, temp AS cur_temp, {_lags('value')}, {_lags('temp')},
         {_rolling('value')}, {_rolling('temp')},
         {r('value - lag(value) OVER w')} AS value_delta1, {r('temp - lag(temp) OVER w')} AS temp_delta1,
         {_calendar('day')}, CAST(day - lag(day) OVER w AS INT) AS days_since_prev
  FROM panel WINDOW w AS (PARTITION BY site ORDER BY day))"""


@query("panel_first_per_key", f"WITH {B.SQL_PANEL} SELECT * FROM panel")
def panel_first_per_key(spark, sf_dir):
    return B.event_panel(spark, sf_dir)


@query("next_measurement_labels", f"WITH {B.SQL_PANEL}, {LABEL_SQL} SELECT * FROM targets")
def next_measurement_labels(spark, sf_dir):
    return P.build_targets(B.event_panel(spark, sf_dir), "site", "day", "value", B.EVENT_THRESHOLD, *B.EVENT_GAPS)


@query("order_labels", f"WITH {B.SQL_ORDER_DATASET} SELECT site, day, label_date, horizon_days, label_value, target FROM dataset")
def order_labels(spark, sf_dir):
    return P.build_targets(B.order_panel(spark, sf_dir), "site", "day", "price", B.ORDER_THRESHOLD, *B.ORDER_GAPS)


@query("label_summary", f"""WITH {B.SQL_PANEL}, {LABEL_SQL}
SELECT count(*) AS n, CAST(sum(target) AS BIGINT) AS positives, median(horizon_days) AS horizon_median,
       min(horizon_days) AS horizon_min, max(horizon_days) AS horizon_max, min(day) AS date_min, max(day) AS date_max,
       count(DISTINCT site) AS sites FROM targets""")
def label_summary(spark, sf_dir):
    targets = P.build_targets(B.event_panel(spark, sf_dir), "site", "day", "value", B.EVENT_THRESHOLD, *B.EVENT_GAPS)
    # horizons are whole days inside the window, so the exact median counts a handful of values
    return targets.agg(
        F.count("*").alias("n"), F.sum("target").alias("positives"), F.percentile("horizon_days", F.lit(0.5)).alias("horizon_median"),
        F.min("horizon_days").alias("horizon_min"), F.max("horizon_days").alias("horizon_max"),
        F.min("day").alias("date_min"), F.max("day").alias("date_max"), F.countDistinct("site").alias("sites"),
    )


@query("panel_features", f"WITH {B.SQL_PANEL}, {FEATURE_SQL} SELECT * FROM features")
def panel_features(spark, sf_dir):
    return B.rounded(P.build_features(B.event_panel(spark, sf_dir), B.EVENT_SPEC))


@query("assembled_dataset", f"""WITH {B.SQL_PANEL}, {LABEL_SQL}, {FEATURE_SQL}
SELECT t.target, t.label_date, t.horizon_days, t.label_value, f.* FROM targets t JOIN features f USING (site, day)""")
def assembled_dataset(spark, sf_dir):
    return B.rounded(P.assemble_dataset(B.event_panel(spark, sf_dir), B.EVENT_SPEC, "value", B.EVENT_THRESHOLD, *B.EVENT_GAPS))


@query("dataset_summary", f"""WITH {B.SQL_ORDER_DATASET}
SELECT count(*) AS n, count(DISTINCT site) AS sites, CAST(sum(target) AS BIGINT) AS positives, {r('avg(target)')} AS positive_rate,
       min(day) AS date_min, max(day) AS date_max FROM dataset""")
def dataset_summary(spark, sf_dir):
    return B.rounded(B.order_dataset(spark, sf_dir).agg(
        F.count("*").alias("n"), F.countDistinct("site").alias("sites"), F.sum("target").alias("positives"),
        F.avg("target").alias("positive_rate"), F.min("day").alias("date_min"), F.max("day").alias("date_max"),
    ))


@query("calendar_features", f"WITH {B.SQL_ORDER_PANEL} SELECT site, day, {_calendar('day')}, CAST(year(day) AS INT) AS year FROM order_panel")
def calendar_features(spark, sf_dir):
    day = F.col("day")
    parts = [c.alias(n) for n, c in calendar(day).items()]
    return B.rounded(B.order_panel(spark, sf_dir).select("site", "day", *parts, F.year(day).alias("year")))


@query("threshold_stages", f"""WITH {B.SQL_MEASURES}
SELECT event_id, CAST(value >= {B.EVENT_THRESHOLD} AS INT) AS target,
       coalesce(CAST(value >= {B.EVENT_STAGES[0]} AS INT), 0) + coalesce(CAST(value >= {B.EVENT_STAGES[1]} AS INT), 0) AS stage
FROM measures""")
def threshold_stages(spark, sf_dir):
    return B.event_measures(spark, sf_dir).select(
        "event_id", reaches(F.col("value"), B.EVENT_THRESHOLD).alias("target"),
        ordinal_stage(F.col("value"), B.EVENT_STAGES).alias("stage"),
    )


RAW_SERIES_ROWS = 1_000_000


@query("raw_series_windows", f"""WITH {B.SQL_MEASURES}
SELECT site, event_id, lag(temp, 1) OVER w AS temp_lag1, lag(temp, 10) OVER w AS temp_lag10,
       {r('avg(temp) OVER (PARTITION BY site ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS temp_mean5,
       lead(temp) OVER w AS temp_next
FROM measures WINDOW w AS (PARTITION BY site ORDER BY event_id)""")
def raw_series_windows(spark, sf_dir):
    """Windows over undeduplicated rows, where one key may hold most of the table: long keys are chunked."""

    def build(w):
        return {
            "temp_lag1": F.lag("temp", 1).over(w), "temp_lag10": F.lag("temp", 10).over(w),
            "temp_mean5": F.avg("temp").over(w.rowsBetween(-5, -1)), "temp_next": F.lead("temp").over(w),
        }

    rows = B.event_measures(spark, sf_dir).select("site", "event_id", "temp")
    return B.rounded(over_series(rows, ["site"], ["event_id"], build, back=10, ahead=1, max_rows=RAW_SERIES_ROWS).drop("temp"))


def _daily_weather(spark, sf_dir):
    homes = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station")
    )
    orders = B.table(spark, sf_dir, "orders").join(homes, "o_custkey")
    return orders.groupBy("station", F.to_date("o_orderdate").alias("day")).agg(
        F.avg(F.sqrt("o_totalprice")).alias("temp_avg"), F.max(F.sqrt("o_totalprice")).alias("temp_max"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("precip"),
        F.count("*").cast("double").alias("sunshine_hours"),
    )


SQL_WEATHER = """weather AS (
  SELECT c_nationkey AS station, CAST(o_orderdate AS DATE) AS day, avg(sqrt(o_totalprice)) AS temp_avg,
         max(sqrt(o_totalprice)) AS temp_max, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS precip,
         CAST(count(*) AS DOUBLE) AS sunshine_hours
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _trailing(n: int) -> str:
    frame = f"(PARTITION BY station ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"{r(f'avg(temp_avg) OVER {frame}', 4)} AS wx_temp_avg_{n}, {r(f'max(temp_max) OVER {frame}', 4)} AS wx_temp_max_{n}, "
            f"{r(f'sum(coalesce(precip, 0)) OVER {frame}', 2)} AS wx_precip_{n}, {r(f'sum(sunshine_hours) OVER {frame}', 2)} AS wx_sunshine_{n}")


SQL_TRAILING = f"{SQL_WEATHER}, wx AS (SELECT station, day, {_trailing(7)}, {_trailing(14)} FROM weather)"


def _trim(df):
    digits = {"wx_temp_avg": 4, "wx_temp_max": 4, "wx_precip": 2, "wx_sunshine": 2}
    return df.select(*[
        F.round(c, digits[c.rsplit("_", 1)[0]]).alias(c) if c.startswith("wx_") else F.col(c) for c in df.columns
    ])


@query("trailing_weather", f"WITH {SQL_TRAILING} SELECT * FROM wx")
def trailing_weather(spark, sf_dir):
    return _trim(P.trailing_weather(_daily_weather(spark, sf_dir), "station", "day"))


@query("weather_joined_panel", f"""WITH {B.SQL_ORDER_PANEL}, {SQL_TRAILING}
SELECT p.*, wx_temp_avg_7, wx_temp_max_7, wx_precip_7, wx_sunshine_7, wx_temp_avg_14, wx_temp_max_14, wx_precip_14, wx_sunshine_14
FROM order_panel p LEFT JOIN (SELECT c_custkey AS site, c_nationkey AS station FROM customer) m USING (site)
LEFT JOIN wx t ON t.station = m.station AND t.day = p.day""")
def weather_joined_panel(spark, sf_dir):
    mapping = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("station")
    )
    weather = P.trailing_weather(_daily_weather(spark, sf_dir), "station", "day")
    return _trim(P.add_weather(B.order_panel(spark, sf_dir), mapping, weather, "site", "day", "station"))


@query("latest_row_per_key", f"""WITH {B.SQL_PANEL} SELECT * FROM panel
QUALIFY row_number() OVER (PARTITION BY site ORDER BY day DESC) = 1""")
def latest_row_per_key(spark, sf_dir):
    return P.latest_rows(B.event_panel(spark, sf_dir), ["site"], ["day"])


@query("history_per_key", f"""WITH {B.SQL_PANEL} SELECT * FROM panel
QUALIFY row_number() OVER (PARTITION BY site ORDER BY day DESC) <= 24""")
def history_per_key(spark, sf_dir):
    return P.latest_rows(B.event_panel(spark, sf_dir), ["site"], ["day"], 24)


@query("model_input_columns", f"""WITH {B.SQL_PANEL}, {LABEL_SQL}, {FEATURE_SQL},
joined AS (SELECT f.* EXCLUDE (site, day) FROM targets t JOIN features f USING (site, day)),
filled AS (UNPIVOT (SELECT CAST(COLUMNS(*) IS NOT NULL AS INT) FROM joined) ON COLUMNS(*) INTO NAME feature VALUE present)
SELECT feature, CAST(sum(present) AS BIGINT) AS filled FROM filled GROUP BY 1""")
def model_input_columns(spark, sf_dir):
    """The inputs a model may see, with how many rows carry each."""
    dataset = P.assemble_dataset(B.event_panel(spark, sf_dir), B.EVENT_SPEC, "value", B.EVENT_THRESHOLD, *B.EVENT_GAPS)
    names = P.model_inputs(dataset, "site", "day")
    filled = dataset.agg(*[F.count(c).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("filled")) for c in names]
    return filled.select(F.explode(F.array(*cells)).alias("f")).select("f.*")
