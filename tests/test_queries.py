"""Registered queries against their SQL on the smallest tables, and the entry contract."""

import os

import pytest

import __spark_entry__ as spark_entry
from check import TABLES, canonical

SMALL = "/root/testdata/sf0.001"
CHOSEN = (
    "assembled_dataset", "order_gap_buckets", "column_profile", "cycle_quality_flags", "fade_summary", "group_folds",
    "quantile_decision_metrics", "stage_metrics", "nearest_station", "matched_coordinates", "measurement_records", "sink_parity",
    "landed_cycler_files", "landed_measurements", "content_fingerprints", "cycles_across_files", "exponential_mean_with_gaps",
    "group_fold_metrics", "rank_correlation_matrix", "ridge_on_cycle", "missing_forecast_rows", "feature_leakage_found",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, con, name):
    got = canonical(spark_entry.queries()[name](spark, SMALL).toPandas())
    want = canonical(con.execute(spark_entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_runs(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0 and "target" in df.columns


def test_every_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_hot_paths_stay_in_the_jvm(spark):
    for name in ("assembled_dataset", "health_labels", "cycle_summary", "decision_metrics", "fold_metrics"):
        plan = spark_entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
