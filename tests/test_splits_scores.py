import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.columns import ordinal_stage, stage_from_probabilities
from tidegauge.operators import preprocess as P
from tidegauge.operators import scoring as S
from tidegauge.operators import splits as V


def dataset(spark):
    rows = [(f"s{i % 7}", dt.date(y, m, 1 + i % 27), int((i * m) % 3 == 0), float(i))
            for i in range(12) for y in range(2019, 2024) for m in (3, 6, 9)]
    return spark.createDataFrame(rows, "site string, day date, target int, cur double")


def test_expanding_year_folds(spark):
    splits = V.year_splits(dataset(spark), "day", 2021, 10)
    spans = splits.groupBy("fold", "role").agg(F.min(F.year("day")).alias("a"), F.max(F.year("day")).alias("b")).collect()
    assert {r["fold"] for r in spans} == {2021, 2022, 2023}
    for r in spans:
        assert (r["a"], r["b"]) == ((r["fold"],) * 2 if r["role"] == "test" else (2019, r["fold"] - 1))


def test_first_year_is_no_fold_and_small_years_are_skipped(spark):
    assert {r["fold"] for r in V.year_folds(dataset(spark), "day", 2015, 1).collect()} == {2020, 2021, 2022, 2023}
    assert V.year_folds(dataset(spark), "day", 2015, 1000).count() == 0


def greedy(sizes, n):
    weights, out = [0] * n, {}
    for key, size in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        fold = weights.index(min(weights))
        weights[fold] += size
        out[key] = fold + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_group_folds_equal_the_sequential_greedy_choice(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {int(k): int(s) for k, s in enumerate([400, *rng.integers(1, 12, 60)] if seed else [5] * 17)}
    rows = [(k,) for k, s in sizes.items() for _ in range(s)]
    got = V.group_folds(spark.createDataFrame(rows, "site int"), "site", 5).collect()
    assert {r["site"]: r["fold"] for r in got} == greedy(sizes, 5)


def test_group_folds_are_disjoint_and_complete(spark):
    data = dataset(spark)
    splits = V.site_splits(data, "site", 3)
    roles = splits.groupBy("site", "fold").agg(F.countDistinct("role").alias("n"))
    assert roles.filter("n > 1").count() == 0
    assert splits.filter("role = 'test'").count() == data.count()


def test_inner_validation_is_the_newest_fifth(spark):
    out = V.inner_time_validation(dataset(spark).dropDuplicates(["site", "day"]), "day", ["site"])
    spans = {r["is_validation"]: r for r in out.groupBy("is_validation").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("n")).collect()}
    total = spans[True]["n"] + spans[False]["n"]
    assert spans[False]["b"] <= spans[True]["a"] and spans[False]["n"] == int(total * 0.8)


def test_seasonal_score_falls_back_to_the_global_rate(spark):
    train = spark.createDataFrame([(dt.date(2020, 5, 1), 1), (dt.date(2020, 5, 2), 0), (dt.date(2020, 6, 1), 1)], "day date, target int")
    test = spark.createDataFrame([(dt.date(2021, 5, 1),), (dt.date(2021, 7, 1),)], "day date")
    got = [r["seasonal"] for r in V.seasonal_score(train, test, "day", "target").orderBy("day").collect()]
    assert got == [0.5, pytest.approx(2 / 3)]


def frame(spark, y, s):
    return spark.createDataFrame(list(zip(y, s)), "y int, s double")


def test_perfect_scores(spark):
    row = S.evaluate(frame(spark, [0, 0, 1, 1], [.1, .2, .8, .9]), [], "y", "s").first()
    assert (row["pr_auc"], row["roc_auc"], row["recall_at_p50"]) == (1.0, 1.0, 1.0)


def test_single_class_has_no_scores(spark):
    row = S.evaluate(frame(spark, [0, 0], [.1, None]), [], "y", "s").first()
    assert row["n"] == 2 and row["pr_auc"] is None and row["roc_auc"] is None and row["recall_at_p50"] is None


def test_scores_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400) * 0.6 + rng.integers(0, 2, 400) * 0.2, 1)
    row = S.evaluate(frame(spark, y.tolist(), s.tolist()), [], "y", "s").first()
    ap, last, best = 0.0, 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        precision, recall = y[hit].mean(), y[hit].sum() / y.sum()
        ap += (recall - last) * precision
        last, best = recall, max(best, recall if precision >= 0.5 else 0.0)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())
    assert row["pr_auc"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc) and row["recall_at_p50"] == pytest.approx(best)


def test_stage_thresholds(spark):
    df = spark.createDataFrame([(999.0,), (1000.0,), (9999.0,), (10000.0,), (5e6,), (None,)], "v double")
    assert [r[0] for r in df.select(ordinal_stage(F.col("v"), (1000, 10000))).collect()] == [0, 1, 1, 2, 2, 0]


def test_high_probability_is_capped_by_the_low_one(spark):
    df = spark.createDataFrame([(.2, .1), (.7, .2), (.9, .8), (.3, .9)], "l double, h double")
    assert [r[0] for r in df.select(stage_from_probabilities(F.col("l"), F.col("h"))).collect()] == [0, 1, 2, 0]


def test_perfect_stages_and_single_class(spark):
    df = spark.createDataFrame([(i, i) for i in (0, 1, 2, 2)], "a int, p int")
    row = S.evaluate_stages(df, [], "a", "p").first()
    assert (row["accuracy"], row["macro_f1"], row["qwk"], row["recall_0"], row["recall_2"]) == (1.0,) * 5
    assert S.evaluate_stages(df.filter("a = 1"), [], "a", "p").first()["qwk"] is None


def test_stage_scores_match_definitions(spark):
    rng = np.random.default_rng(2)
    a, p = rng.integers(0, 3, 200), rng.integers(0, 2, 200)
    row = S.evaluate_stages(spark.createDataFrame(list(zip(a.tolist(), p.tolist())), "a int, p int"), [], "a", "p").first()
    c = np.zeros((3, 3))
    np.add.at(c, (a, p), 1)
    w = (np.arange(3)[:, None] - np.arange(3)[None, :]) ** 2
    assert row["qwk"] == pytest.approx(1 - (w * c).sum() / (w * np.outer(c.sum(1), c.sum(0)) / 200).sum())
    f1 = [2 * c[i, i] / (c[i].sum() + c[:, i].sum()) for i in range(3)]
    assert row["macro_f1"] == pytest.approx(np.mean(f1)) and row["recall_2"] == 0.0


def test_preprocessing_fits_on_training_rows_only(spark):
    rows = [(1, 1.0, None, "a"), (2, 3.0, None, "b"), (3, None, None, None), (9, 100.0, 5.0, "z")]
    df = spark.createDataFrame(rows, "i int, x double, empty double, c string")
    train = df.filter("i < 9")
    out = P.apply_scaler(df, P.fit_scaler(train, ["x", "empty"]), ["x", "empty"])
    out = {r["i"]: r for r in P.apply_codes(out, P.fit_codes(train, "c"), "c").collect()}
    scale = np.std([1.0, 3.0, 2.0])
    assert [out[i]["x"] for i in (1, 2, 3)] == [pytest.approx(v / scale) for v in (-1, 1, 0)]
    assert out[9]["empty"] == 5.0 and out[1]["empty"] == 0.0
    assert [out[i]["c_code"] for i in (1, 2, 3, 9)] == [1, 2, 0, 0]


def test_risk_table_names_the_strongest_features(spark):
    df = spark.createDataFrame([(1, 0.9, 2.0, -3.0, 0.1, 1.0), (2, 0.95, -1.0, 0.5, 4.0, 0.0)], "i int, p double, a double, b double, c double, d double")
    got = P.risk_table(df, ["i"], "p", ["a", "b", "c", "d"], k=2).collect()
    assert [r["i"] for r in got] == [2, 1]
    assert [r["top_features"] for r in got] == ["c(+), a(-), b(+)", "b(-), a(+), d(+)"]


def test_sample_is_stable(spark):
    df = spark.range(500)
    first = {r[0] for r in P.stable_sample(df, ["id"], 50, 1).collect()}
    assert first == {r[0] for r in P.stable_sample(df.repartition(7), ["id"], 50, 1).collect()} and len(first) == 50


def test_seasonal_scores_come_from_sums_of_earlier_years_and_other_folds(spark):
    import datetime as dt
    import random

    rng = random.Random(4)
    rows = [(k, dt.date(2019, 1, 1) + dt.timedelta(days=rng.randrange(1400)), rng.randrange(2), rng.randrange(1, 4)) for k in range(900)]
    rows = [r for r in rows if not (r[1].year < 2021 and r[1].month == 7)]  # a month without history
    df = spark.createDataFrame(rows, "site int, day date, y int, fold int")

    def rate(train, month):
        own = [y for _, d, y, _ in train if d.month == month]
        return sum(own) / len(own) if own else sum(y for _, _, y, _ in train) / len(train)

    got = {r["site"]: (r["fold"], r["seasonal"]) for r in V.seasonal_scores_by_year(df.drop("fold"), "day", "y", 2021, 10).collect()}
    want = {k: (d.year, rate([r for r in rows if r[1].year < d.year], d.month)) for k, d, _, _ in rows if d.year >= 2021}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    got = {r["site"]: r["seasonal"] for r in V.seasonal_scores_by_group(df, "day", "y").collect()}
    assert all(abs(got[k] - rate([r for r in rows if r[3] != fold], d.month)) < 1e-12 for k, d, _, fold in rows)


def test_year_scores_read_their_table_once_for_the_sums(spark, tmp_path):
    import datetime as dt

    rows = [(k, dt.date(2020 + k % 4, 1 + k % 12, 1), k % 2) for k in range(200)]
    spark.createDataFrame(rows, "site int, day date, y int").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    scored = V.seasonal_scores_by_year(table, "day", "y", 2021, 10)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert sum("day#" in line and "Relation" in line for line in plan.splitlines()) == 1
    assert V.year_folds(table, "day", 2021, 10)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
