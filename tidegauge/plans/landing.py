"""Landed records to standard tables, sinks, and table contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.columns import file_date, status_text
from tidegauge.operators import checks as K
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.session import ensure_checkpoint_dir
from tidegauge.sources import readers as R
from tidegauge.sources import schemas as S
from tidegauge.sources.sinks import difference, read_both, write_both, write_table


def _records(spark, sf_dir, *keep):
    """Events as service records: all text, some fields absent, empty or a sentinel."""
    kind = F.col("event_type")
    return B.table(spark, sf_dir, "events").select(
        *keep,
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("SWMN_CODE"), kind.alias("SWMN_NM"),
        F.when(kind == "signup", "unknown").otherwise(F.date_format("ts", "yyyy.MM.dd")).alias("CHCK_DE"),
        F.get_json_object("props", "$.k").alias("IEM_WTRTP"),
        F.when(kind == "error", "정량한계미만").when(kind == "view", "").when(kind == "click", "NaN")
        .otherwise(F.col("event_id").cast("string")).alias("IEM_BGALAGE_CELL_CO"),
        F.col("props").alias("EXTRA"),
    )


def _standard_sql(present: dict[str, str], columns: list[str], keys: list[str]) -> str:
    def null(c: str) -> str:
        return "NULL::VARCHAR" if c in keys else "NULL::DATE" if c == "date" else "NULL::DOUBLE"

    return ", ".join(f"{present.get(c, null(c))} AS {c}" for c in columns)


@query("measurement_records", "SELECT " + _standard_sql({
    "site_code": "lpad(CAST(user_id AS VARCHAR), 6, '0')", "site_name": "event_type",
    "date": "CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END", "water_temp": "CAST(props->>'$.k' AS DOUBLE)",
    "cyano_cells": "CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(event_id AS DOUBLE) END",
}, [*S.MEASUREMENT_KEYS, "date", *S.MEASURES], S.MEASUREMENT_KEYS) + " FROM events")
def measurement_records(spark, sf_dir):
    return R.measurements(_records(spark, sf_dir))


@query("weather_records", "SELECT " + _standard_sql({
    "station_id": "CAST(o_custkey AS VARCHAR)", "date": "CAST(o_orderdate AS DATE)", "temp_avg": "round(o_totalprice / 1000, 3)",
    "precip": "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS DOUBLE) END",
}, [*S.WEATHER_KEYS, "date", *S.WEATHER_MEASURES], S.WEATHER_KEYS) + " FROM orders")
def weather_records(spark, sf_dir):
    records = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("stnId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tm"),
        F.round(F.col("o_totalprice") / 1000, 3).cast("string").alias("avgTa"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).otherwise("").alias("sumRn"),
    )
    return R.weather(records)


@query("positional_export", "SELECT " + _standard_sql({
    "water_body_type": "event_type", "site_name": "CAST(user_id AS VARCHAR)", "site_detail_name": "'d'",
    "date": "CAST(ts AS DATE)", "water_temp": "value", "microcystin_lr": "CAST(event_id AS DOUBLE)",
}, [*S.MEASUREMENT_KEYS, "date", *S.MEASURES], S.MEASUREMENT_KEYS) + " FROM events WHERE event_type IN ('view', 'click')")
def positional_export(spark, sf_dir):
    """Headerless rows by position; rows whose first field is no known type stand for titles and headers."""
    values = {
        "water_body_type": F.col("event_type"), "site_name": F.col("user_id").cast("string"), "site_detail_name": F.lit("d"),
        "date": F.date_format("ts", "yyyy.MM.dd"), "water_temp": F.col("value").cast("string"),
        "microcystin_lr": F.col("event_id").cast("string"), "mc_rr": F.lit("1"),
    }
    raw = B.table(spark, sf_dir, "events").select(*[
        values.get(c, F.lit("")).alias(f"_c{i}") for i, c in enumerate(S.EXPORT_COLUMNS)
    ])
    return R.positional_export(raw, ("view", "click"))


@query("forecast_summary", """WITH items AS (
  SELECT strftime(ts, '%m/%d') AS day, CASE event_type WHEN 'click' THEN 'TMN' WHEN 'view' THEN 'TMX' WHEN 'signup' THEN 'POP' ELSE 'SKY' END AS category, value FROM events)
SELECT day, min(value) FILTER (category = 'TMN') AS temp_min, max(value) FILTER (category = 'TMX') AS temp_max,
       max(value) FILTER (category = 'POP') AS precip_probability FROM items WHERE category <> 'SKY' GROUP BY 1""")
def forecast_summary(spark, sf_dir):
    kind = F.col("event_type")
    items = B.table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("fcstDate"),
        F.when(kind == "click", "TMN").when(kind == "view", "TMX").when(kind == "signup", "POP").otherwise("SKY").alias("category"),
        F.col("value").cast("string").alias("fcstValue"),
    )
    return R.forecast_summary(items)


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/landing/{uuid.uuid4().hex}"


@query("landed_site_master", """SELECT c_mktsegment AS station_type, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS site_code, c_name AS site_name,
  NULL::VARCHAR AS survey_location, NULL::VARCHAR AS address, NULL::VARCHAR AS agency, CAST(n_regionkey AS VARCHAR) AS major_basin,
  n_name AS mid_basin FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def landed_site_master(spark, sf_dir):
    """Customers landed as the site master file and read back all-text; codes keep their zeros."""
    nation = B.table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    customer = B.table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    values = {
        "station_type": F.col("c_mktsegment"), "site_code": F.lpad(F.col("c_custkey").cast("string"), 7, "0"),
        "site_name": F.col("c_name"), "major_basin": F.col("n_regionkey").cast("string"), "mid_basin": F.col("n_name"),
    }
    folder = _folder(spark)
    write_table(customer.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in S.SITE_COLUMNS]), folder, "csv")
    return R.read_sites(spark, folder)


@query("landed_cycler_rows", """SELECT l_orderkey * 10 + l_linenumber AS data_point, l_extendedprice AS test_time, l_linenumber AS step_index,
  l_quantity - 25.5 AS current, l_tax AS charge FROM lineitem""")
def landed_cycler_rows(spark, sf_dir):
    """Line items landed as cycler files with more columns than needed; only the required channels are read."""
    rows = B.table(spark, sf_dir, "lineitem")
    values = {
        "Data_Point": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "Test_Time(s)": F.col("l_extendedprice"),
        "Step_Time(s)": F.col("l_extendedprice") / 100, "Step_Index": F.col("l_linenumber"), "Cycle_Index": F.lit(1),
        "Current(A)": F.col("l_quantity") - 25.5, "Voltage(V)": F.col("l_discount"),
        "Charge_Capacity(Ah)": F.col("l_tax"), "Discharge_Capacity(Ah)": F.col("l_tax"),
    }
    folder = _folder(spark)
    write_table(rows.select(*[values[c].alias(c) for c in S.CYCLER_CHANNELS], "l_returnflag"), folder, "csv")
    landed = R.read_cycler(spark, folder)
    return landed.select(
        F.col("Data_Point").alias("data_point"), F.col("`Test_Time(s)`").alias("test_time"), F.col("Step_Index").alias("step_index"),
        F.col("`Current(A)`").alias("current"), F.col("`Charge_Capacity(Ah)`").alias("charge"),
    )


FILE_ROWS = 1000  # records of a landed array file


def _land_documents(rows: DataFrame, number: str, document, folder: str) -> None:
    """One JSON document a file: ``document`` of the rows with one ``number``, each in a folder of its own."""
    grouped = rows.groupBy(F.floor(F.col(number) / FILE_ROWS).alias("part")).agg(F.to_json(document).alias("value"))
    grouped.write.partitionBy("part").text(folder)


@query("landed_measurements", "SELECT " + _standard_sql({
    "site_code": "lpad(CAST(user_id AS VARCHAR), 6, '0')", "site_name": "event_type",
    "date": "CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END", "water_temp": "CAST(props->>'$.k' AS DOUBLE)",
    "cyano_cells": "CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(event_id AS DOUBLE) END",
}, [*S.MEASUREMENT_KEYS, "date", *S.MEASURES], S.MEASUREMENT_KEYS) + " FROM events")
def landed_measurements(spark, sf_dir):
    """The service records landed as files that each hold one JSON array, and read back."""
    records = _records(spark, sf_dir, "event_id")
    folder = _folder(spark)
    fields = F.struct(*[c for c in records.columns if c != "event_id"])
    _land_documents(records, "event_id", F.collect_list(fields), folder)
    return R.read_measurements(spark, folder)


@query("landed_weather", "SELECT " + _standard_sql({
    "station_id": "CAST(o_custkey AS VARCHAR)", "date": "CAST(o_orderdate AS DATE)", "temp_avg": "round(o_totalprice / 1000, 3)",
    "precip": "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS DOUBLE) END",
}, [*S.WEATHER_KEYS, "date", *S.WEATHER_MEASURES], S.WEATHER_KEYS) + " FROM orders")
def landed_weather(spark, sf_dir):
    records = B.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("stnId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tm"),
        F.round(F.col("o_totalprice") / 1000, 3).cast("string").alias("avgTa"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).otherwise("").alias("sumRn"),
    )
    folder = _folder(spark)
    _land_documents(records, "o_orderkey", F.collect_list(F.struct("stnId", "tm", "avgTa", "sumRn")), folder)
    return R.read_weather(spark, folder)


@query("landed_export", "SELECT " + _standard_sql({
    "water_body_type": "CASE event_type WHEN 'view' THEN '하천' ELSE '호소' END", "site_name": "CAST(user_id AS VARCHAR)", "site_detail_name": "'d'",
    "date": "CAST(ts AS DATE)", "water_temp": "value", "microcystin_lr": "CAST(event_id AS DOUBLE)",
}, [*S.MEASUREMENT_KEYS, "date", *S.MEASURES], S.MEASUREMENT_KEYS) + " FROM events WHERE event_type IN ('view', 'click')")
def landed_export(spark, sf_dir):
    """The headerless export landed as CSV: other events stand for title and header rows, which the reader leaves out."""
    kind = F.col("event_type")
    values = {
        "water_body_type": F.when(kind == "view", "하천").when(kind == "click", "호소").otherwise("title"),
        "site_name": F.col("user_id").cast("string"), "site_detail_name": F.lit("d"), "date": F.date_format("ts", "yyyy.MM.dd"),
        "water_temp": F.col("value").cast("string"), "microcystin_lr": F.col("event_id").cast("string"), "mc_rr": F.lit("1"),
    }
    folder = _folder(spark)
    B.table(spark, sf_dir, "events").select(*[values.get(c, F.lit("")).alias(c) for c in S.EXPORT_COLUMNS]).write.csv(folder, header=False)
    return R.read_export(spark, folder)


@query("landed_network", """SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, s_suppkey / 4 AS lat, s_nationkey / 2 AS lon FROM supplier""")
def landed_network(spark, sf_dir):
    """Suppliers landed as GeoJSON feature collections in subfolders, read back as points."""
    points = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.struct(F.struct(
        F.col("s_suppkey").cast("string").alias("ptNo"), F.col("s_name").alias("ptNm"), (F.col("s_nationkey") / 2).alias("X"),
        (F.col("s_suppkey") / 4).alias("Y")).alias("properties")).alias("feature"))
    folder = _folder(spark)
    _land_documents(points, "s_suppkey", F.struct(F.collect_list("feature").alias("features")), folder)
    return R.read_network(spark, folder).select("code", "name", "lat", "lon")


def _cycler_values(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem")
    values = {
        "Data_Point": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "Test_Time(s)": F.col("l_extendedprice"),
        "Step_Time(s)": F.col("l_extendedprice") / 100, "Step_Index": F.col("l_linenumber"), "Cycle_Index": F.lit(1),
        "Current(A)": F.when(F.col("l_linenumber") == 4, "NaN").otherwise((F.col("l_quantity") - 25.5).cast("string")),
        "Voltage(V)": F.col("l_discount"), "Charge_Capacity(Ah)": F.col("l_tax"), "Discharge_Capacity(Ah)": F.col("l_tax"),
    }
    return rows.select("l_orderkey", "l_linenumber", *[values[c].cast("string").alias(c) for c in S.CYCLER_CHANNELS])


def _land_cycler_files(spark, sf_dir) -> str:
    """Cycler files as they come: usual column order; another order with quoted names and a further column; a byte-order
    mark before the names; an empty file."""
    folder, rows = _folder(spark), _cycler_values(spark, sf_dir)
    usual = list(S.CYCLER_CHANNELS)
    layout = lambda k: rows.filter(F.col("l_linenumber") % 3 == k)
    layout(0).select(*usual).write.csv(f"{folder}/a", header=True)
    layout(1).select(*reversed(usual), F.lit("x, y").alias("Note, free")).write.csv(f"{folder}/b", header=True, quoteAll=True)
    data = layout(2).select((F.floor(F.col("l_orderkey") / 20000)).alias("file"), F.lit(1).alias("place"), F.concat_ws(",", *usual).alias("value"))
    heads = data.select("file").distinct().select("file", F.lit(0).alias("place"), F.lit("\ufeff" + ",".join(usual)).alias("value"))
    lines = data.unionByName(heads).repartition("file").sortWithinPartitions("file", "place")
    lines.select("file", "value").write.partitionBy("file").text(f"{folder}/c")
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{folder}/d")
    return folder


@query("landed_cycler_files", """SELECT l_orderkey * 10 + l_linenumber AS data_point, l_extendedprice AS test_time, l_linenumber AS step_index,
  CASE WHEN l_linenumber <> 4 THEN l_quantity - 25.5 END AS current, l_discount AS voltage, l_tax AS charge FROM lineitem""")
def landed_cycler_files(spark, sf_dir):
    """Files of three layouts and an empty one, read by their own headers through a manifest; NaN comes as NULL."""
    landed = R.read_cycler(spark, _land_cycler_files(spark, sf_dir), manifest=_folder(spark))
    return landed.select(
        F.col("Data_Point").alias("data_point"), F.col("`Test_Time(s)`").alias("test_time"), F.col("Step_Index").alias("step_index"),
        F.col("`Current(A)`").alias("current"), F.col("`Voltage(V)`").alias("voltage"), F.col("`Charge_Capacity(Ah)`").alias("charge"),
    )


@query("landed_header_audit", f"""SELECT true AS has_header, '' AS missing_columns, (SELECT count(*) > 0 FROM lineitem) AS found
UNION ALL SELECT false, '{",".join(sorted(S.CYCLER_CHANNELS))}', true FROM (SELECT count(*) FROM lineitem)""")
def landed_header_audit(spark, sf_dir):
    """What the audit says of the same files: all headers are whole, and the empty file lacks every column."""
    audit = R.audit_headers(spark, _land_cycler_files(spark, sf_dir), manifest=_folder(spark))
    return audit.groupBy("has_header", "missing_columns").agg((F.count("*") > 0).alias("found"))


REQUIRED = ("Data_Point", "Test_Time(s)", "Voltage(V)")


@query("file_header_audit", """SELECT 'CS2_35_' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || '_11.csv' AS source_file,
  make_date(2011, CAST(s_suppkey % 12 + 1 AS INT), CAST(s_nationkey + 1 AS INT)) AS file_date, s_acctbal > 0 AS has_header,
  CASE WHEN s_acctbal > 5000 THEN '' WHEN s_acctbal > 0 THEN 'Voltage(V)' ELSE 'Data_Point,Test_Time(s),Voltage(V)' END AS missing_columns FROM supplier""")
def file_header_audit(spark, sf_dir):
    balance = F.col("s_acctbal")
    header = F.when(balance > 5000, "Data_Point,Test_Time(s),Voltage(V)\n1,2,3").when(balance > 0, "Data_Point,Test_Time(s)\n1,2").otherwise("")
    files = B.table(spark, sf_dir, "supplier").select(
        F.format_string("/landing/CS2_35_%02d_%02d_11.csv", F.pmod("s_suppkey", F.lit(12)) + 1, F.col("s_nationkey") + 1).alias("path"),
        header.alias("value"),
    )
    return R.header_audit(files, REQUIRED)


@query("file_dates", """SELECT s_suppkey, make_date(2011, CAST(s_suppkey % 12 + 1 AS INT), CAST(s_nationkey + 1 AS INT)) AS file_date FROM supplier""")
def file_dates(spark, sf_dir):
    name = F.format_string("CS2_35_%d_%d_11.xlsx", F.pmod("s_suppkey", F.lit(12)) + 1, F.col("s_nationkey") + 1)
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", file_date(name).alias("file_date"))


@query("sink_parity", """SELECT count(*) AS csv_rows, count(*) AS parquet_rows, 0::BIGINT AS differing_rows FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) FROM orders)""")
def sink_parity(spark, sf_dir):
    """The order panel written as CSV and Parquet, read back and compared row by row."""
    folder = f"{ensure_checkpoint_dir(spark)}/sinks/{uuid.uuid4().hex}"
    write_both(B.order_panel(spark, sf_dir), f"{folder}/csv", f"{folder}/parquet")
    csv, parquet = read_both(spark, f"{folder}/csv", f"{folder}/parquet")
    counted = csv.agg(F.count("*").alias("csv_rows"))
    return counted.withColumn("parquet_rows", parquet.agg(F.count("*")).scalar()).withColumn(
        "differing_rows", difference(csv, parquet).agg(F.count("*")).scalar()
    )


@query("repeated_keys", f"WITH {B.SQL_MEASURES} SELECT site, day, count(*) AS n FROM measures GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return K.repeated_keys(B.event_measures(spark, sf_dir), ["site", "day"])


@query("gaps_in_numbering", f"""WITH {B.SQL_HEALTH_CYCLES}
SELECT cell_id, min(cycle) AS first, max(cycle) AS last, count(*) AS n FROM cycles WHERE is_modeling_cycle GROUP BY 1 HAVING max(cycle) - min(cycle) + 1 <> count(*)""")
def gaps_in_numbering(spark, sf_dir):
    return K.gaps_in_numbering(B.health_cycles(spark, sf_dir).filter("is_modeling_cycle"), "cell_id", "cycle")


@query("unforecastable_cycles", f"""WITH {B.SQL_SCENARIOS}
SELECT c.cell_id, c.scenario_id, c.forecast_origin + t.ahead AS cycle FROM scenarios c, LATERAL (SELECT unnest(range(1, c.horizon + 1)) AS ahead) t
ANTI JOIN series s ON s.cell_id = c.cell_id AND s.cycle = c.forecast_origin + t.ahead""")
def unforecastable_cycles(spark, sf_dir):
    """Cycles a horizon counted by cycle would need but the modelling series does not have."""
    series = B.modelling_series(spark, sf_dir)
    ahead = F.sequence(F.col("forecast_origin") + 1, F.col("forecast_origin") + F.col("horizon"))
    wanted = B.scenarios_of(series).select("cell_id", "scenario_id", F.explode(ahead).alias("cycle"))
    return K.uncovered(wanted, series, ["cell_id", "cycle"]).select("cell_id", "scenario_id", "cycle")


@query("status_texts", f"""WITH {B.SQL_SCENARIOS} SELECT cell_id, scenario_id, replace(scenario_type, '_', ' ') AS label FROM scenarios""")
def status_texts(spark, sf_dir):
    scenarios = B.scenarios_of(B.modelling_series(spark, sf_dir))
    return scenarios.select("cell_id", "scenario_id", status_text(F.col("scenario_type")).alias("label"))
