"""Exceedance classifiers on Spark ML: cross-validation, stages, production fit, store and serving."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.columns import ordinal_stage, stage_from_probabilities
from tidegauge.operators.scoring import evaluate
from tidegauge.operators.splits import Fold, inner_time_validation, seasonal_score
from tidegauge.session import ensure_checkpoint_dir, settle, side_by_side
from tidegauge.sources.sinks import read_card, write_card

STAGE_THRESHOLDS = (1000, 10000)


@dataclass(frozen=True)
class Learner:
    """Boosting parameters. ``rounds`` is the most trees; early stopping keeps those up to the best round.

    A search ends ``patience`` rounds after the last better one. Every node looks at ``feature_share`` of the features,
    every tree at ``subsample`` of the rows.
    """

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    rounds: int = 1000
    patience: int = 50
    depth: int = 5
    step: float = 0.05
    leaf_rows: int = 30
    subsample: float = 0.8
    feature_share: float = 0.8
    bins: int = 255
    seed: int = 42


def _stages(learner: Learner) -> list:
    filled = [f"_f_{c}" for c in learner.numeric]
    indexed = [f"_i_{c}" for c in learner.categorical]
    stages: list = [Imputer(inputCols=list(learner.numeric), outputCols=filled, strategy="mean")]
    if indexed:
        stages.append(StringIndexer(inputCols=list(learner.categorical), outputCols=indexed, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*filled, *indexed], outputCol="features"))
    return stages


def _boosting(learner: Learner, target: str, rounds: int, prepared: PipelineModel) -> GBTClassifier:
    """The booster; a category needs a bin of its own, so many categories raise the number of bins."""
    most = max([0, *(len(labels) + 1 for s in prepared.stages if isinstance(s, StringIndexerModel) for labels in s.labelsArray)])
    return GBTClassifier(
        featuresCol="features", labelCol=target, weightCol="_weight", maxIter=rounds, maxDepth=learner.depth,
        stepSize=learner.step, minInstancesPerNode=learner.leaf_rows, subsamplingRate=learner.subsample,
        featureSubsetStrategy=str(learner.feature_share), seed=learner.seed, maxBins=max(learner.bins, most),
    )


def _typed(df: DataFrame, learner: Learner) -> DataFrame:
    """Numbers as doubles and only columns that hold a value somewhere, as the imputer needs."""
    return df.select(
        *[c for c in df.columns if c not in learner.numeric], *[F.col(c).cast("double").alias(c) for c in learner.numeric]
    )


def _weighted(train: DataFrame, target: str, fit_rows: Column) -> DataFrame:
    """Positive rows weigh as much as all negatives together."""
    facts = train.filter(fit_rows).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    weight = facts.select((F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1))).scalar()
    return train.withColumn("_weight", F.when(F.col(target) == 1, weight).otherwise(F.lit(1.0)))


def usable_numeric(train: DataFrame, numeric: Sequence[str]) -> list[str]:
    """Columns with at least one value in training."""
    filled = train.agg(*[F.count(c).alias(c) for c in numeric]).first()
    return [c for c in numeric if filled[c] > 0]


def best_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether the search may end): the first best round before ``patience`` rounds without a better one."""
    best = 0
    for i, loss in enumerate(curve):
        if loss < curve[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass(frozen=True)
class Tuned:
    """A model cut at its best round, and the validation loss of every round tried."""

    model: PipelineModel
    curve: tuple[float, ...]
    rounds: int


def tune_boosted(train: DataFrame, learner: Learner, target: str, order: Sequence[str]) -> Tuned:
    """Fit on the older rows and keep the trees up to the round with the least loss on the newest fifth.

    Boosting is deterministic, so a longer run starts with the trees of a shorter one. Runs of doubling length are
    judged round by round (``evaluateEachIteration``, one pass over the validation rows) until the loss has not fallen for
    ``patience`` rounds or the most rounds are reached; the first trees of the last run are the model.
    """
    learner = replace(learner, numeric=usable_numeric(train, learner.numeric))
    typed = inner_time_validation(_typed(train, learner), order[0], list(order[1:]))
    ready = settle(_weighted(typed, target, ~F.col("is_validation")))
    ensure_checkpoint_dir(train.sparkSession)  # long runs cut their lineage there
    prepared = Pipeline(stages=_stages(learner)).fit(ready.filter("not is_validation"))
    inputs = settle(prepared.transform(ready).select("features", target, "_weight", "is_validation"))
    older, newer = inputs.filter("not is_validation"), inputs.filter("is_validation")
    tried = min(learner.rounds, max(2 * learner.patience, 2))
    while True:
        model = _boosting(learner, target, tried, prepared).fit(older)
        curve = tuple(model.evaluateEachIteration(newer))
        kept, ended = best_round(curve, learner.patience)
        if ended or tried >= learner.rounds:
            break
        tried = min(learner.rounds, 2 * tried)
    return Tuned(PipelineModel([*prepared.stages, first_rounds(model, kept)]), curve, kept)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model that a run of so many rounds would have given."""
    if rounds >= model.getNumTrees:
        return model
    context = SparkSession.active().sparkContext
    java, spark_ml = model._java_obj, context._jvm.org.apache.spark.ml
    trees = context._gateway.new_array(spark_ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for k, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], list(java.treeWeights())[:rounds])):
        trees[k], weights[k] = tree, weight
    cut = GBTClassificationModel(spark_ml.classification.GBTClassificationModel(
        f"{model.uid}_{rounds}", trees, weights, model.numFeatures, model.numClasses))
    return model._copyValues(cut)._set(maxIter=rounds)


def train_boosted(train: DataFrame, learner: Learner, target: str, order: Sequence[str]) -> PipelineModel:
    """The model of ``tune_boosted``."""
    return tune_boosted(train, learner, target, order).model


def train_production(train: DataFrame, learner: Learner, target: str, order: Sequence[str]) -> PipelineModel:
    """Find the number of trees with early stopping, then refit that many on all rows."""
    rounds = tune_boosted(train, learner, target, order).rounds
    learner = replace(learner, numeric=usable_numeric(train, learner.numeric))
    ready = settle(_weighted(_typed(train, learner), target, F.lit(True)))
    prepared = Pipeline(stages=_stages(learner)).fit(ready)
    model = _boosting(learner, target, rounds, prepared).fit(prepared.transform(ready))
    return PipelineModel([*prepared.stages, model])


def loss_curve(tuned: Tuned, spark: SparkSession) -> DataFrame:
    """(round, loss, kept): the validation loss of every round tried, and whether its tree is in the model."""
    rows = [(i + 1, float(loss), i < tuned.rounds) for i, loss in enumerate(tuned.curve)]
    return spark.createDataFrame(rows, "round int, loss double, kept boolean")


def probability(model: PipelineModel, df: DataFrame, learner: Learner, name: str) -> DataFrame:
    """Add the probability of the positive class."""
    original = _typed(df, learner)
    scored = model.transform(original)
    return scored.select(*original.columns, vector_to_array("probability")[1].alias(name))


def cross_validate(dataset: DataFrame, folds: Sequence[Fold], learner: Learner, target: str, day: str, key: str,
                   current: str) -> DataFrame:
    """Out-of-fold scores of the model and both baselines, one row per test row and fold.

    The folds are few (years or five groups) and each one is a distributed fit, beside those of the other folds. They are
    conditions on one stored table, so training rows are filtered per fold, not copied.
    """
    ready = settle(dataset)

    def scores(fold: object, is_train: Column, is_test: Column) -> DataFrame:
        train, test = ready.filter(is_train), ready.filter(is_test)
        scored = probability(train_boosted(train, learner, target, [day, key]), test, learner, "model")
        return seasonal_score(train, scored, day, target).select(
            key, day, F.lit(fold).alias("fold"), target,
            F.coalesce(F.col(current).cast("double"), F.lit(0.0)).alias("persistence"), "seasonal", "model",
        )

    return reduce(DataFrame.unionByName, side_by_side(ready.sparkSession, [partial(scores, *f) for f in folds]))


def fold_metrics(oof: DataFrame, target: str, methods: Sequence[str] = ("model", "persistence", "seasonal"),
                 keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Metrics per fold and method from one long table; ``keys=()`` pools the folds."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])
    long = oof.select(*keys, target, F.explode(cells).alias("s")).select(*keys, target, "s.*")
    return evaluate(long, [*keys, "method"], target, "score")


def cross_validate_stages(
    dataset: DataFrame, folds: Sequence[Fold], learner: Learner, label: str, day: str, key: str, current: str,
    thresholds: Sequence[float] = STAGE_THRESHOLDS,
) -> DataFrame:
    """Out-of-fold stages: two cumulative models per fold, and persistence of the current stage."""
    ready = settle(dataset.select("*", *[(F.col(label) >= t).cast("int").alias(f"_y{i}") for i, t in enumerate(thresholds)]))
    models = iter(side_by_side(ready.sparkSession, [
        partial(train_boosted, ready.filter(is_train), learner, f"_y{i}", [day, key])
        for _, is_train, _ in folds for i in range(len(thresholds))]))
    parts = []
    for fold, _, is_test in folds:
        scored = ready.filter(is_test)
        for i in range(len(thresholds)):
            scored = probability(next(models), scored, learner, f"p{i}")
        parts.append(scored.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts).select(
        key, day, "fold", ordinal_stage(F.col(label), thresholds).alias("actual"),
        stage_from_probabilities(F.col("p0"), F.col("p1")).alias("model"),
        ordinal_stage(F.col(current), thresholds).alias("persistence"), "p0", "p1",
    )


def importance(model: PipelineModel, spark: SparkSession, k: int = 15) -> DataFrame:
    """The k most important features of a fitted model."""
    names = [c.removeprefix("_f_").removeprefix("_i_") for c in model.stages[-2].getInputCols()]
    rows = list(zip(names, model.stages[-1].featureImportances.toArray().tolist()))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def save_model(model: PipelineModel, path: str, train: DataFrame, learner: Learner, target: str, day: str,
               metrics: dict[str, float] | None = None) -> None:
    """Save the model beside a card: parameters, rows, date range, positive rate, validation metrics."""
    model.write().overwrite().save(f"{path}/model")
    facts: dict[str, object] = {
        "features": [*learner.numeric, *learner.categorical], "categorical_features": list(learner.categorical),
        "seed": learner.seed, "rounds": model.stages[-1].getNumTrees, "depth": learner.depth, "step": learner.step,
        "feature_share": learner.feature_share, "subsample": learner.subsample, "leaf_rows": learner.leaf_rows,
        **{f"cv_{k}": round(float(v), 4) for k, v in (metrics or {}).items()},
    }
    aggregates = train.agg(
        F.count("*").alias("n_train_rows"), F.min(day).cast("string").alias("date_from"),
        F.max(day).cast("string").alias("date_to"), F.round(F.avg(target), 4).alias("positive_rate"),
    )
    write_card(train.sparkSession, f"{path}/card", facts, aggregates)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), read_card(spark, f"{path}/card")


def save_stage_models(models: Sequence[PipelineModel], path: str, train: DataFrame, learner: Learner, label: str, day: str,
                      thresholds: Sequence[float] = STAGE_THRESHOLDS, tau: float = 0.5,
                      metrics: dict[str, float] | None = None) -> None:
    """Save the models of both thresholds, each beside its own card, and one card that says how they make a stage."""
    for i, (model, threshold) in enumerate(zip(models, thresholds)):
        reached = train.withColumn("_reached", (F.col(label) >= threshold).cast("int"))
        save_model(model, f"{path}/stage_{i + 1}", reached, learner, "_reached", day, metrics)
    pair = train.agg(F.count("*").alias("n_train_rows"), *[
        F.count_if(F.col(label) >= t).alias(f"rows_from_{i + 1}") for i, t in enumerate(thresholds)])
    write_card(train.sparkSession, f"{path}/card", {
        "stage_thresholds": [float(t) for t in thresholds], "tau": tau, "models": [f"stage_{i + 1}" for i in range(len(models))],
        "rule": "stage = (p_low >= tau) + (min(p_high, p_low) >= tau)", "features": [*learner.numeric, *learner.categorical],
    }, pair)


def load_stage_models(spark: SparkSession, path: str) -> tuple[list[PipelineModel], DataFrame]:
    """The models of a stage pair from the lowest threshold up, and the pair's card."""
    card = read_card(spark, f"{path}/card")
    return [load_model(spark, f"{path}/{name}")[0] for name in card.first()["models"]], card


def serve_stages(rows: DataFrame, low: PipelineModel, high: PipelineModel, learner: Learner,
                 label: str | None = None, thresholds: Sequence[float] = STAGE_THRESHOLDS) -> DataFrame:
    """Stage and probabilities for each row; with ``label`` also the actual stage and whether it was hit."""
    scored = probability(high, probability(low, rows, learner, "p_low"), learner, "p_high")
    scored = scored.withColumn("p_high", F.least("p_high", "p_low")).withColumn(
        "stage", stage_from_probabilities(F.col("p_low"), F.col("p_high"))
    )
    if label is None:
        return scored
    actual = F.when(F.col(label).isNotNull(), ordinal_stage(F.col(label), thresholds))
    return scored.withColumn("actual_stage", actual).withColumn("hit", F.col("stage") == F.col("actual_stage"))
