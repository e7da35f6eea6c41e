"""Audit and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import audit as A
from tidegauge.operators.ordered import row_numbers
from tidegauge.operators.preprocess import stable_sample
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r

MASTER_SQL = "master AS (SELECT c_custkey AS site, c_mktsegment AS kind, c_nationkey AS basin, c_name AS site_name FROM customer WHERE c_acctbal > 0)"


def _master(spark, sf_dir):
    """The site master: customers in credit; users without one are unknown codes."""
    customer = B.table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return customer.select(F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("kind"),
                           F.col("c_nationkey").alias("basin"), F.col("c_name").alias("site_name"))


@query("whitelisted_rows", f"WITH {B.SQL_MEASURES}, {MASTER_SQL} SELECT * FROM measures SEMI JOIN master USING (site)")
def whitelisted_rows(spark, sf_dir):
    return A.known(B.event_measures(spark, sf_dir), _master(spark, sf_dir), "site")


@query("unknown_codes", f"""WITH {B.SQL_MEASURES}, {MASTER_SQL}
SELECT site, count(*) AS row_count FROM measures ANTI JOIN master USING (site) WHERE site IS NOT NULL GROUP BY 1""")
def unknown_codes(spark, sf_dir):
    return A.unknown(B.event_measures(spark, sf_dir), _master(spark, sf_dir), "site")


@query("site_metadata", f"""WITH {B.SQL_MEASURES}, {MASTER_SQL}
SELECT m.*, kind, basin FROM measures m LEFT JOIN master USING (site)""")
def site_metadata(spark, sf_dir):
    return A.with_attributes(B.event_measures(spark, sf_dir), _master(spark, sf_dir), "site", ["kind", "basin"])


def _gap_sql(panel: str, source: str, edges) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS bucket, {float(lo)}::DOUBLE AS above, {float(hi)}::DOUBLE AS up_to"
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    )
    return f"""WITH {panel},
gaps AS (SELECT day - lag(day) OVER (PARTITION BY site ORDER BY day) AS gap FROM {source}),
kept AS (SELECT gap FROM gaps WHERE gap IS NOT NULL),
edges AS ({rows}),
counted AS (SELECT bucket, above, up_to, count(gap) AS n FROM edges LEFT JOIN kept ON gap > above AND gap <= up_to GROUP BY ALL)
SELECT bucket, above, up_to, n, {r('n / (SELECT nullif(sum(n), 0) FROM counted)')} AS share,
       {r('(SELECT avg(gap) FROM kept)')} AS gap_mean, (SELECT median(gap) FROM kept) AS gap_median FROM counted"""


@query("gap_buckets", _gap_sql(B.SQL_PANEL, "panel", A.GAP_EDGES))
def gap_buckets(spark, sf_dir):
    return B.rounded(A.gap_statistics(A.gap_days(B.event_panel(spark, sf_dir), "site", "day")))


ORDER_GAP_EDGES = (0, 30, 90, 180, 365, 100000)


@query("order_gap_buckets", _gap_sql(B.SQL_ORDER_PANEL, "order_panel", ORDER_GAP_EDGES))
def order_gap_buckets(spark, sf_dir):
    return B.rounded(A.gap_statistics(A.gap_days(B.order_panel(spark, sf_dir), "site", "day"), ORDER_GAP_EDGES))


THRESHOLDS = (50, 120, 200, 400)


@query("exceedance_rates", f"""WITH {B.SQL_MEASURES}
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (value >= t) AS n, {r('count(*) FILTER (value >= t) / count(value)')} AS rate
FROM measures, (SELECT unnest({list(THRESHOLDS)}) AS t) GROUP BY t""")
def exceedance_rates(spark, sf_dir):
    return B.rounded(A.exceedance(B.event_measures(spark, sf_dir), "value", THRESHOLDS))


@query("monthly_exceedance", f"""WITH {B.SQL_ORDER_PANEL}
SELECT CAST(month(day) AS INT) AS month, count(*) AS measurements, {r(f'avg(CAST(price >= {B.ORDER_THRESHOLD} AS INT))')} AS exceed_rate
FROM order_panel GROUP BY 1""")
def monthly_exceedance(spark, sf_dir):
    return B.rounded(A.monthly_exceedance(B.order_panel(spark, sf_dir), "day", "price", B.ORDER_THRESHOLD))


@query("coverage_by_kind", f"""WITH {B.SQL_MEASURES}, {MASTER_SQL}
SELECT kind, count(*) FILTER (site IN (SELECT site FROM measures)) AS with_data, count(*) AS all_keys FROM master GROUP BY 1""")
def coverage_by_kind(spark, sf_dir):
    return A.coverage(_master(spark, sf_dir), B.event_measures(spark, sf_dir), "site", "kind")


@query("rows_per_site", f"""WITH {B.SQL_MEASURES}, sizes AS (SELECT site, count(*) AS row_count FROM measures GROUP BY 1)
SELECT count(*) AS n, {r('avg(row_count)')} AS mean, {r('stddev_samp(row_count)')} AS std, min(row_count) AS min, max(row_count) AS max,
       quantile_cont(row_count, 0.25) AS q25, quantile_cont(row_count, 0.5) AS q50, quantile_cont(row_count, 0.75) AS q75 FROM sizes""")
def rows_per_site(spark, sf_dir):
    return B.rounded(A.rows_per_key(B.event_measures(spark, sf_dir), "site"))


@query("table_completeness", f"""WITH {B.SQL_MEASURES}
SELECT count(*) AS row_count, count(DISTINCT site) AS key_count, min(day) AS date_min, max(day) AS date_max,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT site, day FROM measures)) AS duplicate_rows,
       {r('avg(CAST(value IS NULL AS INT))')} AS missing_rate,
       count(*) FILTER (coalesce(value, temp) IS NULL) AS empty_rows, max(value) AS value_max FROM measures""")
def table_completeness(spark, sf_dir):
    return B.rounded(A.completeness(B.event_measures(spark, sf_dir), "site", "day", "value", ["value", "temp"]))


@query("value_quantiles", f"""WITH {B.SQL_MEASURES}
SELECT {', '.join(f"{r(f'quantile_cont(value, {p})')} AS q{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))} FROM measures""")
def value_quantiles(spark, sf_dir):
    wanted = {f"q{int(p * 100)}": p for p in (0.5, 0.9, 0.95, 0.99)}
    return B.rounded(A.exact_quantiles(B.event_measures(spark, sf_dir), [], "value", wanted))


@query("rows_without_measures", f"WITH {B.SQL_MEASURES} SELECT event_id, site, day FROM measures WHERE coalesce(value, CASE WHEN temp >= 50 THEN temp END) IS NULL")
def rows_without_measures(spark, sf_dir):
    rows = B.event_measures(spark, sf_dir).withColumn("high_temp", F.when(F.col("temp") >= 50, F.col("temp")))
    return rows.filter(F.coalesce("value", "high_temp").isNull()).select("event_id", "site", "day")


@query("positive_share_by_type", f"""WITH {B.SQL_MEASURES}
SELECT event_type, {r('avg(CAST(value > 100 AS INT))')} AS positive_share FROM measures GROUP BY 1""")
def positive_share_by_type(spark, sf_dir):
    shifted = B.event_measures(spark, sf_dir).withColumn("value", F.col("value") - 100)
    return B.rounded(A.positive_share(shifted, "event_type", "value"))


@query("monthly_rates_and_medians", f"""WITH {B.SQL_ORDER_PANEL}
SELECT CAST(month(day) AS INT) AS month, {r(f'avg(coalesce(CAST(price >= {B.ORDER_THRESHOLD} AS INT), 0))')} AS rate, count(*) AS n,
       {r('median(price)')} AS median FROM order_panel GROUP BY 1""")
def monthly_rates_and_medians(spark, sf_dir):
    panel = B.order_panel(spark, sf_dir).withColumn("month", F.month("day"))
    rates = A.group_rates(panel, "month", "price", B.ORDER_THRESHOLD)
    return B.rounded(rates.join(A.group_medians(panel, "month", "price"), "month", "left"))


@query("yearly_rates", f"""WITH {B.SQL_ORDER_PANEL}
SELECT CAST(year(day) AS INT) AS year, {r(f'avg(coalesce(CAST(price >= {B.ORDER_THRESHOLD} AS INT), 0))')} AS rate, count(*) AS n
FROM order_panel GROUP BY 1""")
def yearly_rates(spark, sf_dir):
    return B.rounded(A.group_rates(B.order_panel(spark, sf_dir), F.year("day").alias("year"), "price", B.ORDER_THRESHOLD))


@query("basin_rates", f"""WITH {B.SQL_MEASURES}, {MASTER_SQL}
SELECT basin, {r(f'avg(coalesce(CAST(value >= {B.EVENT_THRESHOLD} AS INT), 0))')} AS rate, count(*) AS n
FROM measures JOIN master USING (site) GROUP BY 1""")
def basin_rates(spark, sf_dir):
    rows = B.event_measures(spark, sf_dir).join(_master(spark, sf_dir), "site")
    return B.rounded(A.group_rates(rows, "basin", "value", B.EVENT_THRESHOLD))


@query("log_histogram", f"""WITH {B.SQL_MEASURES}
SELECT CAST(floor(log10(value + 1) / 0.05::DOUBLE) AS INT) AS bin, count(*) AS n, count(*) FILTER (value = 0) AS zeros
FROM measures WHERE value IS NOT NULL GROUP BY 1""")
def log_histogram(spark, sf_dir):
    return A.log_histogram(B.event_measures(spark, sf_dir), "value", 0.05)


@query("top_sites", f"""WITH {B.SQL_MEASURES}, {B.SQL_SITES}
SELECT site, min(site_name) AS site_name, {r(f'avg(coalesce(CAST(value >= {B.EVENT_THRESHOLD} AS INT), 0))')} AS rate, count(*) AS n
FROM measures LEFT JOIN sites USING (site) GROUP BY 1 HAVING count(*) >= 60 ORDER BY rate DESC, site LIMIT 12""")
def top_sites(spark, sf_dir):
    rows = A.with_attributes(B.event_measures(spark, sf_dir), B.event_sites(spark, sf_dir), "site", ["site_name"])
    return B.rounded(A.top_groups(rows, "site", "site_name", "value", B.EVENT_THRESHOLD, min_rows=60))


PROFILED = ("current", "voltage", "test_time", "charge", "discharge")


@query("column_profile", f"""WITH {B.SQL_ROWS}, long AS (
  UNPIVOT (SELECT {', '.join(PROFILED)} FROM cycler) ON {', '.join(PROFILED)} INTO NAME column_name VALUE value)
SELECT column_name, count(value) AS n, (SELECT count(*) FROM cycler) - count(value) AS missing, {r('avg(value)', 5)} AS mean,
       {r('stddev_samp(value)', 5)} AS std, min(value) AS min, max(value) AS max, {r('quantile_cont(value, 0.25)', 5)} AS q25,
       {r('quantile_cont(value, 0.5)', 5)} AS q50, {r('quantile_cont(value, 0.75)', 5)} AS q75 FROM long GROUP BY 1""")
def column_profile(spark, sf_dir):
    return B.rounded(A.column_profile(B.cycler_rows(spark, sf_dir), PROFILED), 5)


@query("rows_by_file", f"WITH {B.SQL_ROWS} SELECT cell_id, count(*) AS n, count(*) FILTER (charge IS NULL) AS missing FROM cycler GROUP BY 1")
def rows_by_file(spark, sf_dir):
    return B.cycler_rows(spark, sf_dir).groupBy("cell_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("charge").isNull()).alias("missing")
    )


def _scaled(c: str) -> str:
    lo, hi = (f"(SELECT quantile_cont({c}, {p}) FROM measures)" for p in (0.05, 0.95))
    scaled = f"least(greatest(({c} - {lo}) / ({hi} - {lo} + 1e-9), 0), 1)"
    return f"CASE WHEN {c} IS NOT NULL THEN {r(scaled)} END AS {c}_scaled"


@query("clip_normalised", f"WITH {B.SQL_MEASURES} SELECT event_id, value, temp, {_scaled('value')}, {_scaled('temp')} FROM measures")
def clip_normalised(spark, sf_dir):
    rows = B.event_measures(spark, sf_dir).select("event_id", "value", "temp")
    return B.rounded(A.clip_normalised(rows, ["value", "temp"]))


def _spearman_sql(pair: str, x: str, y: str, source: str) -> str:
    return f"""SELECT '{pair}' AS pair, count(*) AS n, {r('corr(rx, ry)')} AS rho FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


LAGGED = "lagged AS (SELECT value, " + ", ".join(
    f"lag(value, {k}) OVER (PARTITION BY site ORDER BY day) AS lag{k}" for k in range(1, 6)
) + " FROM panel)"


@query("lag_rank_correlation", f"WITH {B.SQL_PANEL}, {LAGGED} " + " UNION ALL ".join(
    _spearman_sql(f"lag{k}", "value", f"lag{k}", "lagged") for k in range(1, 6)))
def lag_rank_correlation(spark, sf_dir):
    lagged = A.lag_pairs(B.event_panel(spark, sf_dir), "site", "day", "value")
    return B.rounded(A.spearman(lagged, {f"lag{k}": ("value", f"lag{k}") for k in range(1, 6)}))


MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
PAIRS = {f"{x}~{y}": (x, y) for i, x in enumerate(MATRIX) for y in MATRIX[i:]}


@query("rank_correlation_matrix", " UNION ALL ".join(_spearman_sql(p, x, y, "lineitem") for p, (x, y) in PAIRS.items()))
def rank_correlation_matrix(spark, sf_dir):
    return B.rounded(A.spearman(B.table(spark, sf_dir, "lineitem").select(*MATRIX), PAIRS))


@query("seeded_sample", f"WITH {B.SQL_MEASURES} SELECT * FROM measures ORDER BY md5('0:' || event_id), event_id LIMIT 2500")
def seeded_sample(spark, sf_dir):
    return stable_sample(B.event_measures(spark, sf_dir), ["event_id"], 2500, seed=0)


@query("sorted_panel", f"WITH {B.SQL_PANEL} SELECT site, day, value, row_number() OVER (ORDER BY site, day) AS position FROM panel")
def sorted_panel(spark, sf_dir):
    """The panel in order of its keys; the order shows as a position, found slice by slice."""
    return row_numbers(B.event_panel(spark, sf_dir).select("site", "day", "value"), [], ["site", "day"], "position")
