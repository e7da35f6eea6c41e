import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.geo import grid_cell
from tidegauge.operators import stations as S


def brute(points, stations):
    lat1, lon1 = np.radians(points["lat"].to_numpy())[:, None], np.radians(points["lon"].to_numpy())[:, None]
    lat2, lon2 = np.radians(stations["lat"].to_numpy())[None, :], np.radians(stations["lon"].to_numpy())[None, :]
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(a))


def test_nearest_station_with_clusters_ties_and_far_points(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF_STATIONS", 4)
    rng = np.random.default_rng(1)
    dense = pd.DataFrame({"lat": 37 + rng.normal(0, 0.01, 120), "lon": 127 + rng.normal(0, 0.01, 120)})
    wide = pd.DataFrame({"lat": rng.uniform(-80, 80, 60), "lon": rng.uniform(-180, 180, 60)})
    stations = pd.concat([dense, wide, dense.head(5)], ignore_index=True)
    stations["stn"] = np.arange(len(stations)) + 1000
    points = pd.concat([
        pd.DataFrame({"lat": rng.uniform(-89, 89, 150), "lon": rng.uniform(-180, 180, 150)}),
        pd.DataFrame({"lat": 37 + rng.normal(0, 0.02, 100), "lon": 127 + rng.normal(0, 0.02, 100)}), dense.head(5),
    ], ignore_index=True)
    points["p"] = np.arange(len(points))
    got = S.nearest_station(spark.createDataFrame(points), spark.createDataFrame(stations), "stn", "stn")
    got = got.toPandas().sort_values("p").reset_index(drop=True)
    distance = brute(points, stations)
    np.testing.assert_allclose(got["dist_km"], distance.min(axis=1), atol=1e-6)
    chosen = distance[np.arange(len(points)), got["stn"].to_numpy() - 1000]
    np.testing.assert_allclose(chosen, distance.min(axis=1), atol=1e-6)
    assert got["stn"].tail(5).tolist() == [1000, 1001, 1002, 1003, 1004]  # copies: the first one wins


def test_points_without_coordinates_stay_unmatched(spark):
    points = spark.createDataFrame([(1, 37.0, 127.0), (2, None, None)], "p int, lat double, lon double")
    stations = spark.createDataFrame([(9, 37.1, 127.0)], "stn int, lat double, lon double")
    got = {r["p"]: r["stn"] for r in S.nearest_station(points, stations, "stn", "stn").collect()}
    assert got == {1: 9, 2: None}


def test_grid_cell_of_the_capital(spark):
    nx, ny = grid_cell(F.lit(37.5665), F.lit(126.9780))
    assert tuple(spark.range(1).select(nx, ny).first()) == (60, 127)


def test_inherited_coordinates_count_at_the_next_level(spark):
    rows = [("a", "m1", "M", 10.0, 20.0, "precise"), ("b", "m1", "M", None, None, None), ("c", "m2", "M", None, None, None),
            ("d", "m3", "M", 40.0, 50.0, "precise"), ("e", "m4", "N", None, None, None)]
    df = spark.createDataFrame(rows, "s string, mid_basin string, major_basin string, lat double, lon double, coord_source string")
    got = {r["s"]: (r["lat"], r["coord_source"]) for r in S.inherit_missing(df).collect()}
    assert got["b"] == (10.0, "inherited")
    assert got["c"] == (pytest.approx((10 + 10 + 40) / 3), "coarse")
    assert got["e"] == (None, None)


def test_precise_match_priority(spark):
    points = spark.createDataFrame(
        [("f", 0, "P1", "세종보", 1.0, 1.0), ("f", 1, "P2", "금남댐(청벽)", 2.0, 2.0)],
        "file string, place int, code string, name string, lat double, lon double")
    sites = spark.createDataFrame(
        [("P1", "청벽", "금남댐(청벽)"), ("Q", "청벽", "금남댐(청벽)"), ("R", "세종호2", "x"), ("S", "한강", "x"), ("T", "none", "x")],
        "site_code string, site_name string, survey_location string")
    got = {r["site_code"]: r["lat"] for r in S.match_precise(sites, S.network_lookups(points)).collect()}
    assert got == {"P1": 1.0, "Q": 2.0, "R": 1.0, "S": None, "T": None}


def test_a_task_gets_a_bounded_number_of_points(spark, monkeypatch):
    monkeypatch.setattr(S, "SPOTS_PER_TASK", 20)
    points = spark.createDataFrame([(i, 35 + i * 0.01, 127 + i * 0.013) for i in range(100)], "p int, lat double, lon double")
    stations = spark.createDataFrame([(1, 35.0, 127.0), (2, 35.9, 128.1)], "stn int, lat double, lon double")
    got = S.nearest_station(points, stations, "stn", "stn")
    assert "hashpartitioning(_spot#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    assert {r["p"]: r["stn"] for r in got.collect() if not 40 <= r["p"] <= 50} == {i: 1 if i < 45 else 2 for i in range(100) if not 40 <= i <= 50}
