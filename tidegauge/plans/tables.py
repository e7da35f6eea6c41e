"""How the test tables stand in for measurements, sites and cells, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.errors import with_intervals
from tidegauge.operators.forecast import baseline_forecasts, with_truth
from tidegauge.operators.health import health_labels, life_stages
from tidegauge.operators.ordered import over_series
from tidegauge.operators.panel import FeatureSpec, assemble_dataset, first_per_key
from tidegauge.operators.scenarios import rolling_scenarios, with_positions
from tidegauge.session import settle
from tidegauge.sources import readers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order cannot show."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits})"


# --- events as measurements: key user, one row per day, the value missing where the event is an error ---

EVENT_THRESHOLD = 50.0
EVENT_STAGES = (50.0, 120.0)
EVENT_GAPS = (1, 2)


def event_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("site"), F.to_date("ts").alias("day"), "event_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").try_cast("double").alias("temp"),
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row per user and calendar day, which bounds every series by the days covered."""
    return first_per_key(event_measures(spark, sf_dir), ["site", "day"], "event_id", ["value", "temp"])


def event_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("kind"),
                           F.col("c_nationkey").alias("basin"), F.col("c_name").alias("site_name"))


EVENT_SPEC = FeatureSpec(
    key="site", day="day", current=("value", "temp"), lagged=("value", "temp"), rolled=("value", "temp"),
    deltas=("value", "temp"),
)

SQL_MEASURES = """measures AS (
  SELECT user_id AS site, CAST(ts AS DATE) AS day, event_id, event_type,
         CASE WHEN event_type <> 'error' THEN value END AS value,
         CAST(props->>'$.k' AS DOUBLE) AS temp
  FROM events)"""

SQL_PANEL = SQL_MEASURES + """,
panel AS (
  SELECT site, day, value, temp FROM measures WHERE site IS NOT NULL AND day IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY site, day ORDER BY event_id) = 1)"""

SQL_SITES = """sites AS (
  SELECT c_custkey AS site, c_mktsegment AS kind, c_nationkey AS basin, c_name AS site_name FROM customer)"""


# --- orders as a sparse panel: key customer, price missing while the order is pending ---

ORDER_THRESHOLD = 250000.0
ORDER_STAGES = (250000.0, 400000.0)
ORDER_GAPS = (30, 365)
ORDER_START, ORDER_MIN_TEST = 1998, 100


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("site"), F.to_date("o_orderdate").alias("day"), "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("urgency"),
    )
    return first_per_key(orders, ["site", "day"], "o_orderkey", ["price", "urgency"])


ORDER_SPEC = FeatureSpec(
    key="site", day="day", current=("price", "urgency"), lagged=("price",), rolled=("price", "urgency"),
    deltas=("price",), static=("kind", "basin"),
)

SQL_ORDER_PANEL = """order_panel AS (
  SELECT o_custkey AS site, CAST(o_orderdate AS DATE) AS day,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS urgency
  FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1)"""


def order_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = order_panel(spark, sf_dir).join(event_sites(spark, sf_dir).select("site", "kind", "basin"), "site", "left")
    return assemble_dataset(panel, ORDER_SPEC, "price", ORDER_THRESHOLD, *ORDER_GAPS)


SQL_ORDER_DATASET = SQL_ORDER_PANEL + f""",
order_next AS (
  SELECT *, lead(day) OVER w AS label_date, lead(price) OVER w AS label_value FROM order_panel
  WINDOW w AS (PARTITION BY site ORDER BY day)),
dataset AS (
  SELECT site, day, price AS cur_price, urgency AS cur_urgency, label_date, label_value,
         CAST(label_date - day AS INT) AS horizon_days, CAST(label_value >= {ORDER_THRESHOLD} AS INT) AS target
  FROM order_next
  WHERE label_value IS NOT NULL AND label_date - day BETWEEN {ORDER_GAPS[0]} AND {ORDER_GAPS[1]})"""


# --- line items as cycler rows: a supplier is a cell and a file, a ship day a cycle, a line number a step ---

def cycler_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"), day.alias("day"), F.col("l_linenumber").alias("step"),
        (F.col("l_quantity") - 25.5).alias("current"), (F.col("l_discount") + 2.75).alias("voltage"),
        F.col("l_extendedprice").alias("test_time"), (F.col("l_extendedprice") / 100).alias("step_time"),
        F.col("l_tax").alias("charge"), (F.datediff(day, F.lit("1990-01-01").cast("date")) * 0.01).alias("discharge"),
    )


SQL_ROWS = """cycler AS (
  SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS day, l_linenumber AS step, l_quantity - 25.5 AS current,
         l_discount + 2.75 AS voltage, l_extendedprice AS test_time, l_extendedprice / 100 AS step_time,
         l_tax AS charge, (CAST(l_shipdate AS DATE) - DATE '1990-01-01') * 0.01::DOUBLE AS discharge
  FROM lineitem)"""


def health_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of every cell: capacity is a trailing mean with a steady fade; heavily discounted days are excluded."""
    daily = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("cell_id"), F.to_date("l_shipdate").alias("day")
    ).agg(F.avg(F.sqrt("l_quantity")).alias("quantity"), F.avg("l_discount").alias("discount"))

    def build(w) -> dict[str, Column]:
        number = F.row_number().over(w)
        return {
            "cycle": number,
            "capacity_ah": F.round(F.avg("quantity").over(w.rowsBetween(-19, 0)) - number * 0.002, 3),
        }

    numbered = over_series(daily, ["cell_id"], ["day"], build)
    # the cycle table is read several times from here on: written once, the raw rows are scanned once
    return settle(numbered.select(
        "cell_id", "cycle", "day", "capacity_ah", (F.col("discount") < 0.095).alias("is_modeling_cycle")
    ))


SQL_HEALTH_CYCLES = """daily AS (
  SELECT l_suppkey AS cell_id, CAST(l_shipdate AS DATE) AS day, avg(sqrt(l_quantity)) AS quantity, avg(l_discount) AS discount
  FROM lineitem GROUP BY 1, 2),
cycles AS (
  SELECT cell_id, day, CAST(row_number() OVER w AS INT) AS cycle,
         round(avg(quantity) OVER (PARTITION BY cell_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
               - row_number() OVER w * 0.002::DOUBLE, 3) AS capacity_ah,
         discount < 0.095 AS is_modeling_cycle
  FROM daily WINDOW w AS (PARTITION BY cell_id ORDER BY day))"""


def labelled_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_labels(health_cycles(spark, sf_dir))


def staged_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life_stages(labelled_cycles(spark, sf_dir))


SQL_LABELLED = SQL_HEALTH_CYCLES + """,
base AS (
  SELECT cell_id, avg(capacity_ah) AS initial_capacity FROM (
    SELECT cell_id, capacity_ah FROM cycles WHERE is_modeling_cycle
    QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY cycle) <= 5) GROUP BY 1),
healthy AS (
  SELECT c.*, b.initial_capacity, CASE WHEN is_modeling_cycle THEN capacity_ah / nullif(initial_capacity, 0) END AS soh
  FROM cycles c LEFT JOIN base b USING (cell_id)),
runs AS (
  SELECT cell_id, cycle, soh < 0.8 AS below,
         count(*) OVER f = 5 AND min(CAST(soh < 0.8 AS INT)) OVER f = 1 AS starts
  FROM healthy WHERE is_modeling_cycle
  WINDOW f AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
eol AS (
  SELECT cell_id, min(CASE WHEN starts THEN cycle END) AS eol_cycle, min(CASE WHEN below THEN cycle END) AS first_below_cycle
  FROM runs GROUP BY 1),
labelled AS (
  SELECT h.*, e.eol_cycle, e.first_below_cycle, e.eol_cycle IS NULL AS is_censored,
         CASE WHEN is_modeling_cycle THEN e.eol_cycle - cycle END AS rul,
         CASE WHEN is_modeling_cycle AND e.eol_cycle IS NOT NULL THEN greatest(e.eol_cycle - cycle, 0) END AS rul_clipped
  FROM healthy h LEFT JOIN eol e USING (cell_id))"""

SQL_STAGED = SQL_LABELLED + """,
staged AS (
  SELECT *, CASE WHEN is_modeling_cycle THEN cycle > eol_cycle END AS post_eol,
         CASE WHEN NOT is_modeling_cycle THEN 'excluded' WHEN cycle < eol_cycle THEN 'pre_eol'
              WHEN cycle = eol_cycle THEN 'eol' WHEN cycle > eol_cycle THEN 'post_eol' ELSE 'excluded' END AS life_stage
  FROM labelled)"""


def modelling_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(with_positions(readers.modelling_series(labelled_cycles(spark, sf_dir))))


def scenarios_of(series: DataFrame) -> DataFrame:
    """A few rows per cell, used again by every forecast and decision."""
    return settle(rolling_scenarios(series))


SQL_SCENARIOS = SQL_LABELLED + """,
series AS (
  SELECT cell_id, cycle, capacity_ah, soh, initial_capacity, eol_cycle,
         CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS INT) AS pos
  FROM labelled WHERE is_modeling_cycle),
cells AS (
  SELECT cell_id, max(CASE WHEN cycle = eol_cycle THEN pos END) AS eol_pos, max(eol_cycle) AS true_eol_cycle
  FROM series GROUP BY 1 HAVING eol_pos IS NOT NULL),
horizons AS (SELECT unnest([10, 20, 30]) AS h),
origin_list AS (
  SELECT cell_id, eol_pos, true_eol_cycle, row_number() OVER (PARTITION BY cell_id ORDER BY origin_position) AS number, origin_position
  FROM (SELECT DISTINCT cell_id, eol_pos, true_eol_cycle, CAST(179 + floor(i * (eol_pos - 31 - 179) / 3.0) AS INT) AS origin_position
        FROM cells, range(4) t(i) WHERE eol_pos - 31 >= 179)),
plans AS (
  SELECT cell_id, eol_pos, true_eol_cycle, 'pre_eol_rolling' AS scenario_type, number, origin_position, h AS horizon,
         CAST(NULL AS INT) AS rul_lead_horizon FROM origin_list, horizons
  UNION ALL
  SELECT cell_id, eol_pos, true_eol_cycle, 'eol_crossing', NULL, eol_pos - h, h + 4, h FROM cells, horizons WHERE eol_pos - h >= 179),
scenarios AS (
  SELECT CASE WHEN scenario_type = 'eol_crossing'
              THEN 'eol_o' || o.cycle || '_lead' || rul_lead_horizon || '_h' || horizon
              ELSE 'pre_' || lpad(CAST(number AS VARCHAR), 2, '0') || '_o' || o.cycle || '_h' || horizon END AS scenario_id,
         scenario_type, p.cell_id, origin_position, o.cycle AS forecast_origin, o.capacity_ah AS origin_capacity_ah,
         o.soh AS origin_soh, o.soh < 0.8 AS origin_below_threshold, horizon, rul_lead_horizon,
         origin_position + 1 AS train_rows, horizon AS test_rows, s.cycle AS test_start_cycle, e.cycle AS test_end_cycle,
         true_eol_cycle, greatest(true_eol_cycle - o.cycle, 0) AS true_rul,
         eol_pos > origin_position AND eol_pos <= origin_position + horizon AS includes_eol,
         (SELECT count(*) FROM series x WHERE x.cell_id = p.cell_id AND x.cycle BETWEEN true_eol_cycle AND true_eol_cycle + 4
            AND x.pos > origin_position AND x.pos <= origin_position + horizon) = 5 AS includes_eol_confirmation
  FROM plans p
  JOIN series o ON o.cell_id = p.cell_id AND o.pos = origin_position
  JOIN series s ON s.cell_id = p.cell_id AND s.pos = origin_position + 1
  JOIN series e ON e.cell_id = p.cell_id AND e.pos = origin_position + horizon)"""

SQL_FORECASTS = SQL_SCENARIOS + """,
origin_stats AS (
  SELECT cell_id, pos AS origin_position, capacity_ah AS last_value, avg(capacity_ah) OVER f AS recent_mean,
         stddev_samp(capacity_ah) OVER f AS recent_std,
         regr_slope(capacity_ah, pos) OVER f AS slope, regr_intercept(capacity_ah, pos) OVER f AS intercept
  FROM series WINDOW f AS (PARTITION BY cell_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
raw_forecasts AS (
  SELECT s.*, t.step, st.recent_std, m.model_name,
         CASE m.model_name WHEN 'Persistence' THEN last_value WHEN 'MovingAverage' THEN recent_mean
              ELSE intercept + slope * (s.origin_position + t.step) END AS y_raw
  FROM scenarios s JOIN origin_stats st USING (cell_id, origin_position),
       LATERAL (SELECT unnest(range(1, s.horizon + 1)) AS step) t,
       (SELECT unnest(['Persistence', 'MovingAverage', 'LinearTrend']) AS model_name) m),
forecasts AS (
  SELECT f.*, greatest(y_raw, 0) AS y_pred_capacity, x.cycle, x.capacity_ah AS y_true_capacity, x.soh AS y_true_soh,
         x.initial_capacity, greatest(y_raw, 0) / x.initial_capacity AS y_pred_soh
  FROM raw_forecasts f JOIN series x ON x.cell_id = f.cell_id AND x.pos = f.origin_position + f.step)"""

SQL_INTERVALS = SQL_FORECASTS + """,
banded AS (
  SELECT *, CASE WHEN model_name = 'MovingAverage' THEN greatest(y_pred_capacity - 1.2816 * recent_std, 0) END AS lo,
         CASE WHEN model_name = 'MovingAverage' THEN greatest(y_pred_capacity + 1.2816 * recent_std, 0) END AS hi
  FROM forecasts),
intervals AS (
  SELECT *, CASE WHEN lo IS NOT NULL THEN least(lo, y_pred_capacity) END AS y_pred_capacity_q10, y_pred_capacity AS y_pred_capacity_q50,
         CASE WHEN hi IS NOT NULL THEN greatest(hi, y_pred_capacity) END AS y_pred_capacity_q90,
         CASE WHEN lo IS NOT NULL THEN least(lo, y_pred_capacity) / initial_capacity END AS y_pred_soh_q10,
         y_pred_soh AS y_pred_soh_q50,
         CASE WHEN hi IS NOT NULL THEN greatest(hi, y_pred_capacity) / initial_capacity END AS y_pred_soh_q90
  FROM banded)"""


def baseline_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecasts with truth, scenarios, series)."""
    series = modelling_series(spark, sf_dir)
    scenarios = scenarios_of(series)
    return with_truth(baseline_forecasts(series, scenarios), series), scenarios, series


def interval_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The baselines, where the moving average also carries a band from its recent spread."""
    forecasts, scenarios, series = baseline_table(spark, sf_dir)
    banded = F.col("model_name") == "MovingAverage"
    low = F.when(banded, F.col("y_pred_capacity") - F.col("recent_std") * 1.2816)
    high = F.when(banded, F.col("y_pred_capacity") + F.col("recent_std") * 1.2816)
    return with_intervals(forecasts, low, high), scenarios, series
