"""Forecasts of all series at once: baselines from the rows before each origin, and recursive models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import floored
from tidegauge.operators.ordered import over_series
from tidegauge.session import settle, shuffled, side_by_side

# Names of models and features, and the lengths of their windows.
BASELINES = ("Persistence", "MovingAverage", "LinearTrend")
WINDOW = 20
HISTORY = 10
PERIOD_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_5", "lag_10",
    "rolling_mean_5", "rolling_mean_10", "rolling_std_10", "cycle_norm",
)
STRICT_FEATURES = (
    "cycle", "lag_1", "lag_3", "lag_5", "rolling_mean_5", "rolling_mean_10", "rolling_std_5", "rolling_slope_5",
)


def rows_before(series: DataFrame, origins: DataFrame, cell: str, value: str | Sequence[str], count: int) -> DataFrame:
    """The last ``count`` rows up to each origin: (cell, origin_position, pos, value), or all values of a list.

    The few origins are unrolled to the positions they want and meet the series in an equi-join on (cell, pos);
    no window runs over the rest of the series, and a long cell is spread over all tasks.
    """
    wanted = origins.select(cell, "origin_position").distinct().withColumn(
        "pos", F.explode(F.sequence(F.greatest(F.col("origin_position") - (count - 1), F.lit(0)), F.col("origin_position")))
    )
    return wanted.join(shuffled(series.select(cell, "pos", *([value] if isinstance(value, str) else value))), [cell, "pos"])


STATISTICS = ("last_value", "recent_mean", "recent_std", "slope", "intercept")


def origin_statistics(series: DataFrame, origins: DataFrame, cell: str, value: str, window: int = WINDOW) -> DataFrame:
    """What every baseline needs at each origin: last value, recent mean and deviation, recent line."""
    return _statistics(series, origins, cell, {"": value}, window)


def _statistics(series: DataFrame, origins: DataFrame, cell: str, values: Mapping[str, str], window: int) -> DataFrame:
    """Statistics of several values of the same rows, which are read once; their names end as ``values`` says."""
    at = F.col("pos").cast("double")
    return rows_before(series, origins, cell, list(values.values()), window).groupBy(cell, "origin_position").agg(*[
        column.alias(f"{name}{end}") for end, v in values.items() for name, column in zip(STATISTICS, (
            F.max(F.when(F.col("pos") == F.col("origin_position"), F.col(v))), F.avg(v), F.stddev_samp(v),
            F.regr_slope(F.col(v), at), F.regr_intercept(F.col(v), at)))
    ])


def baseline_forecasts(
    series: DataFrame, scenarios: DataFrame, value: str | Mapping[str, str] = "capacity_ah", cell: str = "cell_id",
    window: int = WINDOW, models: Sequence[str] = BASELINES, aimed: Sequence[str] = (),
) -> DataFrame:
    """Persistence, moving average and linear trend for every scenario and step, clipped at zero.

    Only the rows just before an origin are looked up; training rows are never copied per scenario. ``value`` may name
    several targets of the same rows (name and column): their forecasts stand side by side, as ``y_pred_<name>`` and so on.
    ``aimed`` are columns of the row a step aims at, met before models are unrolled; steps without such a row are left out.
    """
    ends = {"": value} if isinstance(value, str) else {f"_{name}": c for name, c in value.items()}
    stepped = scenarios.join(shuffled(_statistics(series, scenarios, cell, ends, window)), [cell, "origin_position"]).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.col("horizon")))
    )
    if aimed:
        # with the same columns this is the shuffle the statistics were read from
        stepped = stepped.withColumn("pos", F.col("origin_position") + F.col("step")).join(shuffled(series.select(cell, "pos", *aimed)), [cell, "pos"])

    def raw(end: str) -> dict[str, Column]:
        return {
            "Persistence": F.col(f"last_value{end}"),
            "MovingAverage": F.col(f"recent_mean{end}"),
            "LinearTrend": F.col(f"intercept{end}") + F.col(f"slope{end}") * (F.col("origin_position") + F.col("step")),
        }

    cells = F.array(*[F.struct(F.lit(m).alias("model_name"), *[raw(end)[m].alias(f"y_raw{end}") for end in ends]) for m in models])
    keep = [*scenarios.columns, "step", *[f"recent_std{end}" for end in ends], *aimed]
    return stepped.select(*keep, F.explode(cells).alias("f")).select(*keep, "f.model_name", *[
        x for end in ends for x in (F.col(f"f.y_raw{end}"), floored(F.col(f"f.y_raw{end}"), 0.0).alias(f"y_pred{end}"))])


def with_truth(forecasts: DataFrame, series: DataFrame, cell: str = "cell_id", cycle: str = "cycle",
               value: str = "capacity_ah") -> DataFrame:
    """Join each forecast step to the row it predicts and express both in health."""
    truth = series.select(
        cell, F.col("pos").alias("_target"), cycle, F.col(value).alias("y_true_capacity"),
        F.col("soh").alias("y_true_soh"), "initial_capacity",
    )
    aimed = forecasts.withColumn("_target", F.col("origin_position") + F.col("step"))
    return aimed.join(shuffled(truth), [cell, "_target"]).drop("_target").withColumnRenamed("y_pred", "y_pred_capacity").withColumn(
        "y_pred_soh", F.col("y_pred_capacity") / F.nullif(F.col("initial_capacity"), F.lit(0.0))
    )


def period_features(w: WindowSpec, value: str) -> dict[str, Column]:
    """Lags, and rolling statistics that accept shorter histories."""

    def past(n: int) -> WindowSpec:
        return w.rowsBetween(-n, -1)

    return {
        **{f"lag_{k}": F.lag(value, k).over(w) for k in (1, 2, 3, 5, 10)},
        "rolling_mean_5": F.avg(value).over(past(5)),
        "rolling_mean_10": F.avg(value).over(past(10)),
        "rolling_std_10": F.stddev_samp(value).over(past(10)),
    }


def strict_features(w: WindowSpec, value: str, pos: str) -> dict[str, Column]:
    """Lags, and rolling statistics that exist only where every row of the window does."""

    def full(n: int, column: Column) -> Column:
        return F.when(F.count(value).over(w.rowsBetween(-n, -1)) == n, column)

    def past(n: int) -> WindowSpec:
        return w.rowsBetween(-n, -1)

    return {
        **{f"lag_{k}": F.lag(value, k).over(w) for k in (1, 3, 5)},
        "rolling_mean_5": full(5, F.avg(value).over(past(5))),
        "rolling_mean_10": full(10, F.avg(value).over(past(10))),
        "rolling_std_5": full(5, F.stddev_samp(value).over(past(5))),
        "rolling_slope_5": full(5, F.regr_slope(F.col(value), F.col(pos).cast("double")).over(past(5))),
    }


def supervised(series: DataFrame, cell: str, value: str, strict: bool, pos: str = "pos",
               max_rows: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Feature table without rows that lack one of the features (``names``, by default all).

    ``cycle_norm`` depends on the longest cycle a model may see, so it is added per origin by the caller.
    """
    build = (lambda w: strict_features(w, value, pos)) if strict else (lambda w: period_features(w, value))
    wide = over_series(series, [cell], [pos], build, back=HISTORY, max_rows=max_rows)
    names = [n for n in names or (STRICT_FEATURES if strict else PERIOD_FEATURES) if n in wide.columns]
    return wide.dropna(subset=[*names, value])


def scaled_position(series: DataFrame, keys: Sequence[str], cycle: str = "cycle", name: str = "cycle_norm") -> DataFrame:
    """cycle / longest cycle of the key, by an aggregate and a join instead of an unbounded window."""
    longest = series.groupBy(*keys).agg(F.max(cycle).alias("_longest"))
    return series.join(shuffled(longest), list(keys)).withColumn(name, F.col(cycle) / F.col("_longest")).drop("_longest")


def origin_moments(
    features: DataFrame, origins: DataFrame, names: Sequence[str], value: str, cell: str = "cell_id", cycle: str = "cycle",
) -> DataFrame:
    """Count, means and co-moments of the rows each origin of a cell may learn from (cycle <= origin).

    Every row is counted once, in the slice of its cell between two origins; the few slices are then added up over the
    origins they precede. Co-moments are taken about means, in the slices as in their sums, so no digits cancel.
    ``cycle_norm`` stands for cycle / origin and is scaled when slices are added.
    """
    p = len(names)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    columns = [F.col(cycle if c == "cycle_norm" else c).cast("double") for c in [*names, value]]
    listed = origins.groupBy(cell).agg(F.array_sort(F.collect_set("forecast_origin")).alias("_origins"))
    slice_no = F.size(F.filter("_origins", lambda o: o < F.col(cycle)))  # the first origin that sees the row
    slices = features.join(shuffled(listed), cell).withColumn("_slice", slice_no).filter(F.col("_slice") < F.size("_origins")).groupBy(cell, "_slice").agg(
        F.count("*").cast("double").alias("_k"), F.array(*[F.avg(c) for c in columns]).alias("_m"),
        F.array(*[F.covar_pop(columns[i], columns[j]) * F.count("*") for i, j in pairs]).alias("_c"),
    )
    every = listed.select(cell, F.posexplode("_origins").alias("_place", "forecast_origin"))
    seen = settle(every.join(shuffled(slices), cell).filter(F.col("_slice") <= F.col("_place")))
    keys = [cell, "forecast_origin"]
    centers = seen.groupBy(*keys).agg(
        F.sum("_k").alias("_n"), F.array(*[F.sum(F.col("_k") * F.get("_m", F.lit(i))) / F.sum("_k") for i in range(p + 1)]).alias("_means"))

    def off(i: int) -> Column:
        return F.get("_m", F.lit(i)) - F.get("_means", F.lit(i))

    def scale(i: int) -> Column:
        return F.col("forecast_origin").cast("double") if i < p and names[i] == "cycle_norm" else F.lit(1.0)

    summed = seen.join(shuffled(centers), keys).groupBy(*keys, "_n", "_means").agg(F.array(*[
        F.sum(F.get("_c", F.lit(at)) + F.col("_k") * off(i) * off(j)) for at, (i, j) in enumerate(pairs)]).alias("_products"))
    return summed.select(
        *keys, "_n", F.array(*[F.get("_means", F.lit(i)) / scale(i) for i in range(p + 1)]).alias("_means"),
        F.array(*[F.get("_products", F.lit(at)) / (scale(i) * scale(j)) for at, (i, j) in enumerate(pairs)]).alias("_products"),
    )


def ridge_models(moments: DataFrame, keys: Sequence[str], features: int, alpha: float = 1.0, scaled: bool = True) -> DataFrame:
    """One ridge model per row of ``origin_moments``: coefficients, the intercept last.

    Spark has added up the normal equations; a vectorised helper solves the small systems. ``scaled`` penalises
    standardised features.
    """
    p = features

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(count: pd.Series, products: pd.Series, means: pd.Series) -> pd.Series:
        upper = np.triu_indices(p + 1)
        full = np.zeros((len(count), p + 1, p + 1))
        full[:, upper[0], upper[1]] = np.stack(products.to_numpy())
        full[:, upper[1], upper[0]] = full[:, upper[0], upper[1]]
        center = np.stack(means.to_numpy())
        gram, cross = full[:, :p, :p], full[:, :p, p]
        deviation = np.sqrt(np.einsum("kii->ki", gram) / count.to_numpy()[:, None]) if scaled else np.ones(cross.shape)
        deviation = np.where(deviation == 0, 1.0, deviation)
        system = gram / (deviation[:, :, None] * deviation[:, None, :]) + alpha * np.eye(p)
        slopes = np.linalg.solve(system, (cross / deviation)[:, :, None])[:, :, 0] / deviation
        intercept = center[:, p] - (slopes * center[:, :p]).sum(axis=1)
        return pd.Series(list(np.column_stack([slopes, intercept])))

    return moments.select(*keys, solve("_n", "_products", "_means").alias("coefficients"))


def target_cycles(series: DataFrame, scenarios: DataFrame, cell: str = "cell_id", cycle: str = "cycle") -> DataFrame:
    """(cell, origin_position, cycles): the cycles of the rows behind each origin, in order, as far as any horizon reaches.

    Excluded cycles leave holes, so the row ``step`` places behind an origin need not be ``step`` cycles behind it.
    """
    reach = scenarios.groupBy(cell, "origin_position").agg(F.max("horizon").alias("_reach"))
    wanted = reach.select(cell, "origin_position", F.explode(
        F.sequence(F.col("origin_position") + 1, F.col("origin_position") + F.col("_reach"))).alias("pos"))
    found = wanted.join(shuffled(series.select(cell, "pos", cycle)), [cell, "pos"])
    rows = F.array_sort(F.collect_list(F.struct("pos", cycle)))  # at most the longest horizon
    return found.groupBy(cell, "origin_position").agg(F.transform(rows, lambda x: x[cycle]).alias("cycles"))


def _strict_row(history: Column, cycle: Column) -> list[Column]:
    """Strict features of the next row from the last values, newest at the end."""

    def last(k: int) -> Column:
        return F.element_at(history, -k)

    five, ten = [last(k) for k in range(5, 0, -1)], [last(k) for k in range(10, 0, -1)]
    mean5, mean10 = sum(five[1:], five[0]) / 5, sum(ten[1:], ten[0]) / 10
    spread = [F.pow(v - mean5, 2) for v in five]
    slope = sum(((i - 2.0) * v for i, v in enumerate(five)), F.lit(0.0)) / 10
    return [cycle.cast("double"), last(1), last(3), last(5), mean5, mean10, F.sqrt(sum(spread[1:], spread[0]) / 4), slope]


def ridge_forecasts(
    series: DataFrame, scenarios: DataFrame, value: str = "capacity_ah", cell: str = "cell_id", cycle: str = "cycle",
    alpha: float = 1.0, strict: bool = True, max_rows: int | None = None, names: Sequence[str] | None = None,
) -> DataFrame:
    """Recursive ridge forecasts, one model per cell and origin.

    ``strict`` picks full-window features with a standardising model; otherwise short windows are accepted, the
    position is scaled by the origin and features are penalised as they are. ``names`` picks some of the features. A
    forecast feeds its own predictions back, but needs only the last ten values and the cycles of the rows to
    predict: each scenario row carries both in arrays and folds over its steps inside the JVM. No step loop, no growing plan.
    """
    every = STRICT_FEATURES if strict else PERIOD_FEATURES
    names = tuple(names or every)
    features = supervised(series, cell, value, strict, max_rows=max_rows, names=names)
    origins = scenarios.select(cell, "forecast_origin", "origin_position").distinct()
    models = ridge_models(origin_moments(features, origins, names, value, cell, cycle), [cell, "forecast_origin"], len(names), alpha, scaled=strict)
    base = scenarios.join(shuffled(models), [cell, "forecast_origin"]).join(
        shuffled(tail_values(series, origins, cell, value)), [cell, "origin_position"]).join(
        shuffled(target_cycles(series, scenarios, cell, cycle)), [cell, "origin_position"])
    picked = [every.index(n) for n in names]

    def advance(state: Column, step: Column) -> Column:
        history = state["history"]
        row = _strict_row(history, F.get("cycles", step - 1)) if strict else _period_row(history)
        weights = [F.element_at("coefficients", i + 1) for i in range(len(picked) + 1)]
        prediction = sum((w * row[at] for w, at in zip(weights, picked)), weights[-1])
        clipped = F.greatest(prediction, F.lit(0.0))
        return F.struct(
            F.concat(F.slice(state["history"], 2, HISTORY - 1), F.array(clipped)).alias("history"),
            F.concat(state["raw"], F.array(prediction)).alias("raw"),
        )

    start = F.struct(F.col("history").alias("history"), F.expr("cast(array() as array<double>)").alias("raw"))
    path = F.aggregate(F.sequence(F.lit(1), F.col("horizon")), start, advance, lambda state: state["raw"])
    return base.select(*scenarios.columns, F.posexplode(path).alias("_i", "y_raw")).select(
        *scenarios.columns, (F.col("_i") + 1).alias("step"), F.lit("RidgeRegression").alias("model_name"),
        "y_raw", floored(F.col("y_raw"), 0.0).alias("y_pred"),
    )


def tail_values(series: DataFrame, origins: DataFrame, cell: str, value: str) -> DataFrame:
    """(cell, origin_position, history): the last ten values up to each origin, oldest first."""
    rows = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows_before(series, origins, cell, value, HISTORY).groupBy(cell, "origin_position").agg(
        F.transform(rows, lambda x: x[value]).alias("history"))


STEPS_PER_WRITE = 5
# Sizes of a forest's fits. They are fixed, as a forest draws its rows by task and must not change with the cluster.
AS_STORED = 20_000  # rows that are fitted in the tasks they are read in
FIT_ROWS = 2_000_000  # rows of a task; each one sends the histograms of all nodes, whatever its rows
FIT_DRAWS = 32_000_000  # draws, one for each row and tree, that a task keeps while its trees grow
ROWS_AT_ONCE = 16_000_000  # rows of fits that go on side by side


def fit_sizes(rows: int, trees: int) -> list[int]:
    """How many trees of a forest grow together: all of them over few rows, as each task keeps a draw for every row and tree."""
    fits = max(1, -(-min(rows, FIT_ROWS) * trees // FIT_DRAWS))
    return [trees // fits + (k < trees % fits) for k in range(fits)]


def one_forest(parts: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """The forest of all trees of ``parts``."""
    if len(parts) == 1:
        return parts[0]
    context = SparkSession.active().sparkContext
    kinds = context._jvm.org.apache.spark.ml.regression
    trees = [t for part in parts for t in part._java_obj.trees()]
    listed = context._gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
    for k, tree in enumerate(trees):
        listed[k] = tree
    joined = RandomForestRegressionModel(kinds.RandomForestRegressionModel(f"{parts[0].uid}_joined", listed, parts[0].numFeatures))
    joined.setFeaturesCol(parts[0].getFeaturesCol())._set(numTrees=len(trees))
    joined._transfer_params_to_java()  # the sum of the trees is divided by this number
    return joined


def forest_forecasts(
    series: DataFrame, scenarios: DataFrame, slot: str = "slot", value: str = "capacity_ah", cell: str = "cell_id",
    cycle: str = "cycle", trees: int = 300, depth: int = 6, leaf_rows: int = 3, seed: int = 42,
    max_rows: int | None = None,
) -> DataFrame:
    """Recursive random-forest forecasts, one forest per origin slot, trained on all cells together.

    ``scenarios`` carries ``slot``, the place of its origin in the backtest (the same few slots for every
    cell). A slot's forest sees each cell only up to that cell's own origin.
    """
    features = supervised(series, cell, value, strict=False, max_rows=max_rows)
    origins = scenarios.select(cell, slot, "forecast_origin", "origin_position").distinct()
    slots = [row[0] for row in origins.select(slot).distinct().orderBy(slot).collect()]  # a fixed handful
    by_cell = origins.groupBy(cell).agg(
        F.collect_set(F.struct(slot, "forecast_origin")).alias("_origins"), F.max("forecast_origin").alias("_last"))
    # a row is stored once, beside the origins of its cell that see it, and unrolled for its slots where it is read
    known = [n for n in PERIOD_FEATURES if n != "cycle_norm"]
    seen = settle(features.join(shuffled(by_cell), cell).filter(F.col(cycle) <= F.col("_last")).select(value, *known, cycle, "_origins"))
    visible = seen.withColumn("_o", F.explode(F.filter("_origins", lambda o: o["forecast_origin"] >= F.col(cycle))))
    visible = visible.withColumn("cycle_norm", F.col(cycle) / F.col("_o.forecast_origin")).select(f"_o.{slot}", value, *PERIOD_FEATURES)
    assembler = VectorAssembler(inputCols=list(PERIOD_FEATURES), outputCol="features")
    counts = {row[0]: row[1] for row in visible.groupBy(slot).count().collect()}

    sizes = {name: fit_sizes(counts.get(name, 0), trees) for name in slots}

    def fitted(name: str, at: int) -> RandomForestRegressionModel:
        rows, count = visible.filter(F.col(slot) == name), counts.get(name, 0)
        if count > AS_STORED:
            tasks = -(-count // FIT_ROWS)
            rows = rows.coalesce(tasks) if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
        learner = RandomForestRegressor(
            featuresCol="features", labelCol=value, numTrees=sizes[name][at], maxDepth=depth, minInstancesPerNode=leaf_rows,
            seed=seed + (at << 20), featureSubsetStrategy="all", maxMemoryInMB=1024,
        )
        return learner.fit(assembler.transform(rows).select("features", value))

    fits = [(name, at) for name in slots for at in range(len(sizes[name]))]
    grown = side_by_side(series.sparkSession, [partial(fitted, *f) for f in fits], ROWS_AT_ONCE // max([1, *counts.values()]))
    models = {name: one_forest([m for (of, _), m in zip(fits, grown) if of == name]) for name in slots}
    # horizons from the same origin share one path, as far as the longest of them
    paths = scenarios.groupBy(cell, slot, "origin_position").agg(F.max("horizon").alias("horizon"))
    start = paths.join(shuffled(tail_values(series, origins, cell, value)), [cell, "origin_position"])
    ahead = iterated_forecasts(start, models, slot).select(cell, slot, "origin_position", "raw")
    return scenarios.join(shuffled(ahead), [cell, slot, "origin_position"]).select(
        *scenarios.columns, F.posexplode(F.slice("raw", F.lit(1), F.col("horizon"))).alias("_i", "y_raw")).select(
        *scenarios.columns, (F.col("_i") + 1).alias("step"), F.lit("RandomForestRegressor").alias("model_name"),
        "y_raw", floored(F.col("y_raw"), 0.0).alias("y_pred"),
    )


def iterated_forecasts(start: DataFrame, models: Mapping[str, Transformer], slot: str, features: Sequence[str] = PERIOD_FEATURES) -> DataFrame:
    """Let fitted models predict step after step from their own predictions; adds ``raw``, the predictions of every row.

    ``start`` has one row per series to continue, with ``history`` (its last ten values), ``horizon`` and ``slot``, the
    model it belongs to. These are the state: each step turns the carried values into features, asks
    ``model.transform`` for all rows of the model at once and carries the clipped prediction on. Every few steps the state is
    written, so that plans stay short and a lost executor repeats only those steps. Models go on side by side, each to the
    longest horizon of its own rows.
    """
    state = settle(start.withColumn("raw", F.expr("cast(array() as array<double>)")))
    width = max(1, state.rdd.getNumPartitions())
    longest = {row[0]: row[1] for row in state.groupBy(slot).agg(F.max("horizon")).collect()}
    kept = [c for c in state.columns if c not in ("history", "raw")]

    def advance(rows: DataFrame, model: Transformer, step: int) -> DataFrame:
        row = dict(zip(PERIOD_FEATURES, _period_row(F.col("history"))))
        scored = model.transform(rows.select("*", array_to_vector(F.array(*[row[n] for n in features])).alias("features")))
        going, clipped = F.col("horizon") >= step, F.greatest("prediction", F.lit(0.0))
        return scored.select(
            *kept, F.when(going, F.concat(F.slice("history", 2, HISTORY - 1), F.array(clipped))).otherwise(F.col("history")).alias("history"),
            F.when(going, F.concat("raw", F.array("prediction"))).otherwise(F.col("raw")).alias("raw"),
        )

    def continued(name: str) -> DataFrame:
        part, last = state.filter(F.col(slot) == name), longest.get(name) or 0
        for first in range(1, last + 1, STEPS_PER_WRITE):
            for step in range(first, min(first + STEPS_PER_WRITE, last + 1)):
                part = advance(part, models[name], step)
            part = settle(part.coalesce(width))
        return part

    return reduce(DataFrame.unionByName, side_by_side(state.sparkSession, [partial(continued, name) for name in models]))


def _spread(values: Column, mean: Column, count: int) -> Column:
    """Sample deviation of an array, as a fold: spelled out term by term it would fill the plan."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (count - 1))


def _mean(values: Column, count: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / count


def _period_row(history: Column) -> list[Column]:
    """Period features of the next row; it is always the longest cycle so far, hence position 1."""

    def last(k: int) -> Column:
        return F.element_at(history, -k)

    mean10 = _mean(history, HISTORY)
    return [
        *[last(k) for k in (1, 2, 3, 5, 10)], _mean(F.slice(history, -5, 5), 5), mean10,
        _spread(history, mean10, HISTORY), F.lit(1.0),
    ]
