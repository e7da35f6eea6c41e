import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import cycles as C
from tidegauge.operators import decisions as D
from tidegauge.operators import errors as E
from tidegauge.operators import forecast as M
from tidegauge.operators import health as H
from tidegauge.operators import scenarios as S

SCHEMA = "cell_id string, cycle int, capacity_ah double, is_modeling_cycle boolean"


def fading(n=260, seed=0, cell="c1", drop=0.0012):
    rng = np.random.default_rng(seed)
    return [(cell, i + 1, float(1.1 - drop * i + rng.normal(0, 0.002)), True) for i in range(n)]


def test_first_confirmed_run_is_the_end_of_life(spark):
    health = [1.0] * 5 + [0.7] + [1.0] * 3 + [0.7] * 6 + [0.9] * 3
    rows = [("c", i + 1, h, True) for i, h in enumerate(health)]
    for max_rows in (None, 4):
        labelled = H.health_labels(spark.createDataFrame(rows, SCHEMA), max_rows=max_rows)
        row = labelled.filter("cycle = 3").first()
        assert (row["eol_cycle"], row["first_below_cycle"], row["rul"], row["is_censored"]) == (10, 6, 7, False)


def test_excluded_and_censored_rows_have_no_labels(spark):
    rows = [("c", 1, 1.0, True), ("c", 2, 0.1, False), ("c", 3, 1.0, True)]
    staged = H.life_stages(H.health_labels(spark.createDataFrame(rows, SCHEMA))).orderBy("cycle").collect()
    assert staged[1]["soh"] is None and staged[1]["life_stage"] == "excluded" and staged[1]["post_eol"] is None
    assert staged[0]["is_censored"] and staged[0]["rul"] is None and staged[0]["rul_clipped"] is None


def test_phase_duration_sums_the_longest_time_per_step(spark):
    names = "file string, cyc int, step int, cur double, v double, tt double, st double, ch double, dis double"
    rows = [("f", 1, 1, 0.5, 3.0, 1.0, 10.0, 0.1, 0.0), ("f", 1, 1, 0.7, 4.0, 2.0, 20.0, 0.2, 0.0), ("f", 1, 2, 0.2, 4.1, 3.0, 5.0, 0.3, 0.0),
            ("f", 1, 3, -0.5, 2.9, 4.0, 7.0, 0.3, 0.9), ("f", 1, 4, 0.0, 3.0, 5.0, 99.0, 0.3, 0.9), ("f", 2, 1, 0.05, 3.3, 6.0, 1.0, 0.4, 1.7)]
    channels = C.Channels("file", "cyc", "step", "cur", "v", "tt", "st", "ch", "dis")
    out = {r["local_cycle"]: r for r in C.own_amount(
        C.cycle_summary(spark.createDataFrame(rows, names), channels), ["source_file"], "local_cycle", "discharge_capacity_max").collect()}
    first, second = out[1], out[2]
    assert first["charge_duration_sec"] == 25.0 and first["discharge_duration_sec"] == 7.0
    assert first["charge_current_mean"] == pytest.approx(1.4 / 3) and first["row_count"] == 5
    assert second["charge_duration_sec"] is None and second["discharge_current_mean"] is None
    assert (first["capacity_ah"], second["capacity_ah"]) == (0.9, pytest.approx(0.8))


def test_flags_treat_missing_values_as_false(spark):
    rows = [(1, 2.5, 1.0, 10.0, None, None), (2, 2.9, 1.0, 10.0, 1.0, 1.0), (3, 2.5, 1.0, 10.0, 0.5, 1.0), (4, 2.5, 2.5, 10.0, 1.0, 1.0),
            (5, 2.5, 1.0, None, 1.0, None), (6, None, 1.0, 10.0, 1.0, 1.0)]
    names = "local_cycle int, voltage_min double, capacity_ah double, discharge_duration_sec double, charge_duration_sec_ratio double, discharge_duration_sec_ratio double"
    got = {r["local_cycle"]: r["cycle_type"] for r in C.quality_flags(spark.createDataFrame(rows, names)).collect()}
    standard, other, invalid = "standard_full_cycle", "nonstandard_cycle", "invalid"
    assert got == {1: standard, 2: other, 3: other, 4: invalid, 5: invalid, 6: other}


def test_duplicate_files_by_ordered_content(spark):
    rows = [("b", 1, "x"), ("b", 2, "y"), ("a", 1, "y"), ("a", 2, "x"), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x")]
    prints = C.fingerprints(spark.createDataFrame(rows, "f string, n int, v string"), "f", "n", ["v"])
    assert [tuple(r) for r in C.duplicate_files(prints, "f").collect()] == [("c", "b")]


def test_missing_cells_count_in_a_fingerprint(spark):
    rows = [("a", 1, None, "x"), ("b", 1, "x", None), ("c", 1, "x", None), ("d", 1, "", "x"), ("e", 1, "1:x", None), ("f", 2, None, "x")]
    prints = C.fingerprints(spark.createDataFrame(rows, "f string, n int, v string, w string"), "f", "n", ["v", "w"])
    assert [tuple(r) for r in C.duplicate_files(prints, "f").collect()] == [("c", "b")]


def test_the_first_file_owns_its_content_whatever_its_name(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")]
    prints = C.fingerprints(spark.createDataFrame(rows, "f string, n int, v string"), "f", "n", ["v"])
    placed = prints.join(spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", None)], "f string, place int"), "f")
    assert sorted(tuple(r) for r in C.duplicate_files(placed, "f", "place").collect()) == [("a", "b"), ("c", "b"), ("d", "b")]


def test_numbers_run_on_from_file_to_file(spark):
    rows = [("c", "z", 1, k) for k in (1, 2, 3)] + [("c", "a", 2, k) for k in (1, 2)] + [("c", "m", None, 1), ("d", "q", 5, 9)]
    got = C.across_files(spark.createDataFrame(rows, "cell string, file string, place int, local int"), "cell", "file", "place", "local")
    numbered = {(r["file"], r["local"]): r["cycle"] for r in got.collect()}
    assert numbered == {("z", 1): 1, ("z", 2): 2, ("z", 3): 3, ("a", 1): 4, ("a", 2): 5, ("m", 1): 6, ("q", 9): 1}


def test_pairs_without_any_row_break_the_contract(spark):
    from tidegauge.operators import checks as K

    scenarios = spark.createDataFrame([("s", 2), ("t", 1)], "scenario_id string, horizon int")
    forecasts = spark.createDataFrame([("s", "m", 1), ("s", "m", 2), ("t", "m", 1), ("s", "n", 1)], "scenario_id string, model string, step int")
    for models, more in ((None, []), (["m", "n", "o"], [("s", "o", 0), ("t", "o", 0)])):
        got = K.wrong_row_counts(forecasts, scenarios, ["scenario_id"], "model", models)
        assert sorted((r["scenario_id"], r["model"], r["found"]) for r in got.collect()) == sorted([("s", "n", 1), ("t", "n", 0), *more])


def series_of(spark, rows):
    return S.with_positions(H.health_labels(spark.createDataFrame(rows, SCHEMA)).filter("is_modeling_cycle"))


def test_fifteen_scenarios_per_complete_cell(spark):
    series = series_of(spark, fading()).cache()
    scenarios = S.rolling_scenarios(series, min_train=60)
    rows = scenarios.collect()
    eol = series.first()["eol_cycle"]
    assert len(rows) == 15 and len({r["scenario_id"] for r in rows}) == 15
    usual = [r for r in rows if r["scenario_type"] == "pre_eol_rolling"]
    crossing = [r for r in rows if r["scenario_type"] == "eol_crossing"]
    assert sorted({r["origin_position"] for r in usual}) == np.unique(np.linspace(59, eol - 1 - 31, 4, dtype=int)).tolist()
    assert not any(r["includes_eol"] or r["includes_eol_confirmation"] for r in usual)
    assert all(r["includes_eol"] and r["includes_eol_confirmation"] for r in crossing)
    assert sorted(r["horizon"] for r in crossing) == [14, 24, 34] and sorted(r["true_rul"] for r in crossing) == [10, 20, 30]
    tests = S.test_rows(series.select("cell_id", "cycle"), scenarios)
    assert S.incomplete_scenarios(tests, scenarios).count() == 0 and tests.count() == 312


def ridge(x, y, alpha, scaled):
    mean = x.mean(axis=0)
    dev = x.std(axis=0) if scaled else np.ones(x.shape[1])
    dev[dev == 0] = 1
    z = (x - mean) / dev
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / dev
    return w, y.mean() - w @ mean


def strict_row(history, cycle):
    five, ten = np.array(history[-5:]), np.array(history[-10:])
    return [cycle, history[-1], history[-3], history[-5], five.mean(), ten.mean(), five.std(ddof=1), np.polyfit(np.arange(5), five, 1)[0]]


def period_row(history, norm):
    five, ten = np.array(history[-5:]), np.array(history[-10:])
    return [history[-1], history[-2], history[-3], history[-5], history[-10], five.mean(), ten.mean(), ten.std(ddof=1), norm]


@pytest.mark.parametrize("strict", [True, False])
def test_ridge_recursion_matches_a_plain_loop(spark, strict):
    rows = fading(seed=4)
    series = series_of(spark, rows).cache()
    scenarios = S.rolling_scenarios(series, min_train=60).cache()
    got = M.ridge_forecasts(series, scenarios, strict=strict).toPandas()
    values = np.array([r[2] for r in rows])
    for s in scenarios.filter("horizon >= 20").collect():
        known = values[: s["origin_position"] + 1].tolist()
        origin = s["forecast_origin"]
        if strict:
            x = np.array([strict_row(known[:i], i + 1) for i in range(10, len(known))])
        else:
            x = np.array([period_row(known[:i], (i + 1) / origin) for i in range(10, len(known))])
        w, b = ridge(x, np.array(known[10:]), 1.0, strict)
        expected = []
        for step in range(s["horizon"]):
            row = strict_row(known, origin + step + 1) if strict else period_row(known, 1.0)
            expected.append(w @ np.array(row) + b)
            known.append(max(expected[-1], 0.0))
        mine = got[got["scenario_id"] == s["scenario_id"]].sort_values("step")["y_raw"].to_numpy()
        np.testing.assert_allclose(mine, expected, rtol=1e-6)


def test_ridge_looks_at_the_cycle_of_the_row_it_predicts(spark):
    """Excluded cycles leave holes; on the feature ``cycle`` alone the forecast is a shrunken line through real cycles."""
    rng = np.random.default_rng(11)
    rows = [(cell, i, v, bool(rng.random() > 0.2)) for cell, i, v, _ in fading(n=320, seed=8)]
    series = series_of(spark, rows).cache()
    scenarios = S.rolling_scenarios(series, min_train=60).cache()
    got = M.ridge_forecasts(series, scenarios, names=("cycle",)).toPandas()
    kept = [(i, v) for _, i, v, modelling in rows if modelling]
    cycles, values = np.array([c for c, _ in kept], dtype=float), np.array([v for _, v in kept])
    assert not got.empty and (np.diff(cycles) > 1).any()
    for s in scenarios.collect():
        n = s["origin_position"] + 1
        w, b = ridge(cycles[:n, None], values[:n], 1.0, True)
        mine = got[got["scenario_id"] == s["scenario_id"]].sort_values("step")["y_raw"].to_numpy()
        np.testing.assert_allclose(mine, w[0] * cycles[n:n + s["horizon"]] + b, rtol=1e-9)


def test_moments_of_slices_keep_their_digits(spark):
    """Values far from zero: raw products would lose the differences."""
    rng = np.random.default_rng(5)
    x, y = 1e8 + rng.normal(size=90), 1e8 + rng.normal(size=90)
    frame = pd.DataFrame({"cell_id": "c", "cycle": np.arange(90), "x": x, "y": y})
    origins = spark.createDataFrame([("c", 20), ("c", 21), ("c", 70)], "cell_id string, forecast_origin int")
    got = {r["forecast_origin"]: r for r in M.origin_moments(spark.createDataFrame(frame), origins, ["x"], "y").collect()}
    for origin, row in got.items():
        a, b = x[:origin + 1], y[:origin + 1]
        assert row["_n"] == origin + 1
        np.testing.assert_allclose(row["_products"], [((a - a.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum(), ((b - b.mean()) ** 2).sum()], rtol=1e-6)


def test_iterated_forecasts_equal_a_loop_over_transform(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.normal(size=(300, 9)), columns=list(M.PERIOD_FEATURES))
    frame["cycle_norm"] = rng.random(300)
    frame["y"] = frame["lag_1"] * 2 + frame["rolling_mean_5"] + rng.normal(0, 0.1, 300)
    assembler = VectorAssembler(inputCols=list(M.PERIOD_FEATURES), outputCol="features")
    df = assembler.transform(spark.createDataFrame(frame)).cache()
    models = {name: RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=4, seed=i).fit(df) for i, name in enumerate("ab")}
    rows = [(rng.normal(size=10).tolist(), h, name) for h in (1, 3, 7) for name in "ab"]
    got = M.iterated_forecasts(spark.createDataFrame(rows, "history array<double>, horizon int, slot string"), models, "slot")
    paths = {(r["slot"], r["horizon"]): r["raw"] for r in got.collect()}
    for history, horizon, name in rows:
        past, path = list(history), paths[name, horizon]
        assert len(path) == horizon
        for value in path:
            vector = spark.createDataFrame([tuple(float(x) for x in period_row(past, 1.0))], list(M.PERIOD_FEATURES))
            assert value == pytest.approx(models[name].transform(assembler.transform(vector)).first()["prediction"])
            past.append(max(value, 0.0))


def test_forest_forecasts_cover_every_scenario_step(spark):
    rows = [r for i in range(3) for r in fading(seed=i, cell=f"c{i}")]
    series = series_of(spark, rows).cache()
    scenarios = S.rolling_scenarios(series, min_train=60).withColumn("slot", F.regexp_extract("scenario_id", r"(pre_\d+|lead\d+)", 1))
    forecasts = M.with_truth(M.forest_forecasts(series, scenarios, trees=5), series)
    assert forecasts.groupBy("cell_id").count().collect()[0]["count"] == 312
    assert forecasts.agg(F.max(F.abs(F.col("y_pred_capacity") - F.col("y_true_capacity")))).first()[0] < 0.3


def test_large_forests_grow_in_parts_over_few_tasks(spark, monkeypatch):
    rows = [r for i in range(3) for r in fading(seed=i, cell=f"c{i}")]
    series = series_of(spark, rows).repartition(6, "cycle").cache()
    scenarios = S.rolling_scenarios(series, min_train=60).withColumn("slot", F.regexp_extract("scenario_id", r"(pre_\d+|lead\d+)", 1))
    scenarios = scenarios.where(F.col("slot").isin("pre_02", "lead10")).cache()
    for name, size in (("AS_STORED", 10), ("FIT_ROWS", 400), ("FIT_DRAWS", 1200)):
        monkeypatch.setattr(M, name, size, raising=False)
    grown, joined, fit = [], [], M.RandomForestRegressor.fit

    def watched(learner, rows, *rest):
        grown.append((learner.getNumTrees(), learner.getSeed(), rows.count(), rows.rdd.getNumPartitions()))
        return fit(learner, rows, *rest)

    def kept(start, models, slot, *rest):
        joined.extend(models.values())
        return forecast(start, models, slot, *rest)

    forecast = M.iterated_forecasts
    monkeypatch.setattr(M.RandomForestRegressor, "fit", watched)
    monkeypatch.setattr(M, "iterated_forecasts", kept)
    got = M.forest_forecasts(series, scenarios, trees=7).cache()
    slots = scenarios.select("slot").distinct().count()
    assert sum(trees for trees, *_ in grown) == 7 * slots and [m.getNumTrees for m in joined] == [7] * slots
    assert len({seed for _, seed, *_ in grown}) > 1
    for trees, _, count, tasks in grown:
        assert tasks == -(-count // 400) and trees * min(count, 400) <= 1200 + 400
    # every step of every scenario once, and a short horizon is the start of a longer one
    assert got.count() == scenarios.agg(F.sum("horizon")).first()[0] == got.select("cell_id", "scenario_id", "step").distinct().count()
    assert got.groupBy("cell_id", "origin_position", "slot", "step").agg(F.count_distinct("y_raw").alias("n")).where("n > 1").count() == 0


def test_parts_of_a_forest_add_up_to_its_mean(spark):
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(float(a), float(b), float(3 * a - b)) for a, b in rng.normal(size=(200, 2))], "a double, b double, y double")
    rows = M.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame)
    parts = [M.RandomForestRegressor(labelCol="y", numTrees=n, seed=n).fit(rows) for n in (2, 3)]
    whole = M.one_forest(parts)
    assert whole.getNumTrees == 5
    p, q, both = ([r.prediction for r in m.transform(rows).orderBy("a").collect()] for m in (*parts, whole))
    assert both == pytest.approx([(2 * x + 3 * y) / 5 for x, y in zip(p, q)])


def test_baselines(spark):
    series = series_of(spark, fading(seed=9)).cache()
    scenarios = S.rolling_scenarios(series, min_train=60).cache()
    values = np.array([r[2] for r in fading(seed=9)])
    got = M.baseline_forecasts(series, scenarios).toPandas()
    for s in scenarios.collect():
        recent = values[s["origin_position"] - 19: s["origin_position"] + 1]
        a, b = np.polyfit(np.arange(20), recent, 1)
        part = got[got["scenario_id"] == s["scenario_id"]].set_index(["model_name", "step"])["y_pred"]
        assert part["Persistence", 1] == recent[-1] and part["MovingAverage", 3] == pytest.approx(recent.mean())
        assert part["LinearTrend", 5] == pytest.approx(a * 24 + b)


def test_targets_side_by_side_are_forecast_like_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, *map(float, rng.normal(5, 3, 2))) for c in ("c1", "c2") for i in range(60)]
    series = spark.createDataFrame(rows, "cell_id string, pos int, a double, b double").cache()
    scenarios = spark.createDataFrame([("c1", "x", 30, 3), ("c1", "y", 30, 5), ("c2", "x", 57, 5), ("c2", "x", 57, 5)], "cell_id string, scenario_id string, origin_position int, horizon int")
    both = M.baseline_forecasts(series, scenarios, {"first": "a", "second": "b"}, window=10, aimed=["a", "b"])
    long = E.target_variants(both, {"first": "a", "second": "b"}, ["cell_id", "scenario_id", "step", "model_name"],
                             {"y_pred": {"first": "y_pred_first", "second": "y_pred_second"}})
    want = []
    for name, column in (("first", "a"), ("second", "b")):
        truth = series.select("cell_id", F.col("pos").alias("at"), F.col(column).alias("target"))
        alone = M.baseline_forecasts(series, scenarios, column, window=10).withColumn("at", F.col("origin_position") + F.col("step"))
        want += [(r.cell_id, r.scenario_id, r.step, r.model_name, name, r.target, r.y_pred) for r in alone.join(truth, ["cell_id", "at"]).collect()]
    assert sorted(map(tuple, long.collect())) == sorted(want) and len(want) == 2 * 3 * (3 + 5 + 2 + 2)


def test_baselines_run_no_window_over_the_series(spark):
    series = spark.createDataFrame([("c1", i, 1.0) for i in range(50)], "cell_id string, pos int, capacity_ah double")
    scenarios = spark.createDataFrame([("c1", 30, 3)], "cell_id string, origin_position int, horizon int")
    plan = M.baseline_forecasts(series, scenarios)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_tables_that_grow_with_the_cells_are_not_broadcast(spark, tmp_path):
    rows = [r for i in range(2) for r in fading(seed=i, cell=f"c{i}")]
    series_of(spark, rows).write.parquet(f"{tmp_path}/series")
    series = spark.read.parquet(f"{tmp_path}/series")
    S.rolling_scenarios(series, min_train=60).write.parquet(f"{tmp_path}/scenarios")
    scenarios = spark.read.parquet(f"{tmp_path}/scenarios")
    for forecasts in (M.ridge_forecasts(series, scenarios), M.ridge_forecasts(series, scenarios, strict=False), M.baseline_forecasts(series, scenarios)):
        plan = M.with_truth(forecasts, series)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_both_percentage_errors(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, p double")
    percent = df.agg(*E.error_columns("a", "p")).first()
    fraction = df.agg(*E.error_columns("a", "p", percent=False)).first()
    assert percent["smape"] == 100.0 and fraction["smape"] == 0.5 and percent["mae"] == 1.0 and percent["rmse"] == pytest.approx(2 ** 0.5)


def test_decision_metrics_of_the_published_decisions(spark):
    rows = ([("m", "true_positive", -4.0, True)] * 2 + [("m", "false_negative", None, True)] + [("m", "true_negative", None, False)] * 12
            + [("n", "true_negative", None, False)])
    df = spark.createDataFrame(rows, "model_name string, event_status string, rul_error double, true_event_in_horizon boolean")
    got = {r["model_name"]: r for r in D.decision_metrics(df, ["model_name"]).collect()}
    m, n = got["m"], got["n"]
    assert (m["true_positive"], m["false_negative"], m["false_positive"], m["true_negative"]) == (2, 1, 0, 12)
    assert m["eol_detection_rate"] == pytest.approx(2 / 3) and m["false_alarm_rate"] == 0.0 and m["precision"] == 1.0
    assert (m["rul_mae_detected"], m["rul_bias_detected"], m["early_warning_count"]) == (4.0, -4.0, 2)
    assert n["eol_detection_rate"] is None and n["precision"] is None
    ranked = D.ranked(D.decision_metrics(df, ["model_name"]), D.decision_order()).orderBy("rank").collect()
    assert [r["model_name"] for r in ranked] == ["m", "n"]


def test_forecast_with_missing_health_predicts_nothing(spark):
    rows = [("c", "s", "m", i, 0.7 if i != 3 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "cell_id string, scenario_id string, model_name string, cycle int, h double")
    keys = ["cell_id", "scenario_id", "model_name"]
    assert D.predicted_eol(df, keys, {"e": "h"}).first()["e"] is None
    assert D.predicted_eol(df, keys, {"e": "h"}, strict_nulls=False).first()["e"] == 4


def test_fits_of_slots_run_side_by_side(spark):
    import threading

    from tidegauge.session import side_by_side

    met = threading.Barrier(3, timeout=20)  # passes only if all three wait at once
    assert side_by_side(spark, [lambda i=i: (met.wait(), spark.range(i).count())[1] for i in (3, 1, 2)]) == [3, 1, 2]
