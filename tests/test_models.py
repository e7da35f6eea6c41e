"""Classifiers end to end on a small synthetic panel with a learnable next value."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import classify as L
from tidegauge.operators import splits as V
from tidegauge.operators.panel import FeatureSpec, assemble_dataset, latest_rows


@pytest.fixture(scope="module")
def dataset(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(12):
        level = rng.uniform(0, 2500)
        for w in range(100):
            level = max(0.0, 0.9 * level + rng.normal(150 + 60 * s, 250))
            rows.append((f"s{s}", dt.date(2021, 1, 4) + dt.timedelta(days=7 * w), level if w % 17 else None, "AB"[s % 2], None))
    panel = spark.createDataFrame(rows, "site string, day date, v double, kind string, hollow double")
    spec = FeatureSpec("site", "day", current=("v", "hollow"), lagged=("v",), rolled=("v",), deltas=("v",), static=("kind",))
    return assemble_dataset(panel, spec, "v").cache()


LEARNER = L.Learner(numeric=("cur_v", "v_lag1", "v_rollmean3", "cur_hollow"), categorical=("kind",), rounds=6, patience=3, depth=3, step=0.2, leaf_rows=5)


def test_cross_validation_beats_the_seasonal_rule(dataset):
    folds = V.year_conditions(dataset, "day", 2022, 50)
    assert [f[0] for f in folds] == [2022]
    oof = L.cross_validate(dataset, folds, LEARNER, "target", "day", "site", "cur_v").cache()
    assert oof.count() == dataset.filter(F.year("day") == 2022).count()
    scores = {r["method"]: r for r in L.fold_metrics(oof, "target").collect()}
    assert scores["model"]["pr_auc"] > scores["seasonal"]["pr_auc"] and scores["model"]["roc_auc"] > 0.8


def test_production_model_round_trip_and_serving(spark, dataset, tmp_path):
    models = []
    for i, threshold in enumerate((1000, 3000)):
        labelled = dataset.withColumn("y", (F.col("label_value") >= threshold).cast("int"))
        model = L.train_production(labelled, LEARNER, "y", ["day", "site"])
        again = L.train_production(labelled, LEARNER, "y", ["day", "site"])
        L.save_model(model, f"{tmp_path}/m{i}", labelled, LEARNER, "y", "day", {"pr_auc": 0.51239})
        loaded, card = L.load_model(spark, f"{tmp_path}/m{i}")
        scores = [[r["p"] for r in L.probability(m, dataset, LEARNER, "p").orderBy("site", "day").collect()] for m in (model, again, loaded)]
        assert scores[0] == scores[1] == scores[2]
        facts = card.first()
        assert facts["n_train_rows"] == dataset.count() and facts["cv_pr_auc"] == 0.5124 and facts["features"][-1] == "kind"
        models.append(loaded)
    served = L.serve_stages(latest_rows(dataset, ["site"], ["day"]), *models, LEARNER, "label_value", (1000, 3000)).collect()
    assert len(served) == 12 and all(r["p_high"] <= r["p_low"] and r["hit"] == (r["stage"] == r["actual_stage"]) for r in served)


def test_stage_cross_validation(dataset):
    out = L.cross_validate_stages(dataset, V.year_conditions(dataset, "day", 2022, 50), LEARNER, "label_value", "day", "site", "cur_v", (1000, 3000))
    assert {r[0] for r in out.select("actual").distinct().collect()} <= {0, 1, 2}
    assert out.filter("model not in (0, 1, 2)").count() == 0


def test_importance_names_the_inputs(spark, dataset):
    got = L.importance(L.train_boosted(dataset, LEARNER, "target", ["day", "site"]), spark).collect()
    assert {r["feature"] for r in got} == {"cur_v", "v_lag1", "v_rollmean3", "kind"} and got[0]["importance"] > 0


def test_the_best_round_within_the_patience():
    assert L.best_round([3, 2, 1, 2, 2, 0], 2) == (3, True)
    assert L.best_round([3, 2, 1, 2, 2, 0], 3) == (6, False)
    assert L.best_round([1, 1, 1, 1], 3) == (1, True) and L.best_round([2], 5) == (1, False)


def test_kept_trees_are_those_up_to_the_least_loss(spark, dataset):
    from dataclasses import replace

    learner = replace(LEARNER, rounds=24, patience=4, depth=2)
    tuned = L.tune_boosted(dataset, learner, "target", ["day", "site"])
    best = min(range(len(tuned.curve)), key=lambda i: tuned.curve[i])
    assert tuned.rounds == best + 1 == tuned.model.stages[-1].getNumTrees and 1 < tuned.rounds
    assert len(tuned.curve) in (8, 16, 24) and (len(tuned.curve) == 24 or len(tuned.curve) > best + learner.patience)
    rows = L.loss_curve(tuned, spark).orderBy("round").collect()
    assert [r["loss"] for r in rows] == list(tuned.curve) and [r["kept"] for r in rows] == [i <= best for i in range(len(rows))]


def test_many_categories_get_a_bin_each(spark, dataset):
    from dataclasses import replace

    wide = dataset.withColumn("many", F.concat(F.lit("c"), (F.dayofyear("day") % 300).cast("string")))
    tuned = L.tune_boosted(wide, replace(LEARNER, categorical=("many",), bins=4, rounds=2), "target", ["day", "site"])
    assert tuned.model.stages[-1].getNumTrees <= 2


def test_first_rounds_of_a_run_need_no_fit_of_their_own(dataset, monkeypatch):
    train, fits, fit = dataset, [], L.GBTClassifier.fit

    def counted(booster, rows, *rest):
        fits.append(booster.getMaxIter())
        return fit(booster, rows, *rest)

    monkeypatch.setattr(L.GBTClassifier, "fit", counted)
    tuned = L.tune_boosted(train, L.replace(LEARNER, patience=2, rounds=8), "target", ["day", "site"])
    model = tuned.model.stages[-1]
    assert fits == [4, 8][:len(fits)] and model.getNumTrees == tuned.rounds
    inputs = L.PipelineModel(tuned.model.stages[:-1]).transform(L._typed(train, LEARNER)).withColumn("_weight", F.lit(1.0))
    long = fit(L._boosting(LEARNER, "target", 6, tuned.model), inputs)
    short = fit(L._boosting(LEARNER, "target", 3, tuned.model), inputs)
    cut = L.first_rounds(long, 3)
    assert cut.getNumTrees == cut.getMaxIter() == 3 and cut.toDebugString.split("\n", 1)[1] == short.toDebugString.split("\n", 1)[1]
    a, b = ([r.probability for r in m.transform(inputs).select("site", "day", "probability").orderBy("site", "day").collect()] for m in (cut, short))
    assert a == b
    assert L.first_rounds(long, 6) is long
