"""Splits, baseline scores, classification and stage metrics, preprocessing, and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.functions.columns import capped, ordinal_stage, stage_from_probabilities
from tidegauge.operators import classify as L
from tidegauge.operators import preprocess as P
from tidegauge.operators import scoring as S
from tidegauge.operators import splits as V
from tidegauge.operators.checks import leaked_rows
from tidegauge.operators.panel import build_features, latest_rows, model_inputs
from tidegauge.plans import panels
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r
from tidegauge.session import ensure_checkpoint_dir, settle

KEEP = ("site", "day", "cur_price", "label_value", "target")


def _dataset(spark, sf_dir):
    return B.order_dataset(spark, sf_dir).select(*KEEP)


def _splits(spark, sf_dir):
    return V.year_splits(settle(_dataset(spark, sf_dir)), "day", B.ORDER_START, B.ORDER_MIN_TEST)


SQL_SPLITS = B.SQL_ORDER_DATASET + f""",
folds AS (
  SELECT year(day) AS fold FROM dataset GROUP BY 1
  HAVING fold >= {B.ORDER_START} AND count(*) >= {B.ORDER_MIN_TEST} AND fold > (SELECT min(year(day)) FROM dataset)),
splits AS (
  SELECT d.*, CAST(fold AS INT) AS fold, CASE WHEN year(day) < fold THEN 'train' ELSE 'test' END AS role
  FROM dataset d JOIN folds ON year(day) <= fold)"""


@query("year_folds", f"WITH {SQL_SPLITS} SELECT fold, count(*) AS test_rows FROM splits WHERE role = 'test' GROUP BY 1")
def year_folds(spark, sf_dir):
    return V.year_folds(_dataset(spark, sf_dir), "day", B.ORDER_START, B.ORDER_MIN_TEST)


@query("year_splits", f"WITH {SQL_SPLITS} SELECT site, day, fold, role FROM splits")
def year_splits(spark, sf_dir):
    return _splits(spark, sf_dir).select("site", "day", "fold", "role")


BASELINE_CTES = """rates AS (SELECT fold, month(day) AS m, avg(target) AS rate FROM splits WHERE role = 'train' GROUP BY 1, 2),
overall AS (SELECT fold, avg(target) AS rate FROM splits WHERE role = 'train' GROUP BY 1),
scored AS (
  SELECT s.site, s.day, s.fold, s.target, s.label_value, s.cur_price, coalesce(cur_price, 0) AS persistence, round(coalesce(a.rate, o.rate), 9) AS seasonal
  FROM splits s LEFT JOIN rates a ON a.fold = s.fold AND a.m = month(s.day) JOIN overall o ON o.fold = s.fold WHERE role = 'test'),
long AS (
  SELECT fold, target, 'persistence' AS method, persistence AS score FROM scored UNION ALL SELECT fold, target, 'seasonal', seasonal FROM scored)"""
SQL_BASELINES = SQL_SPLITS + ",\n" + BASELINE_CTES


def _evaluate_sql(keys: str, source: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""counts AS (SELECT {lead}score, sum(target)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {source} GROUP BY {lead}score),
curve AS (SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS cp, sum(n) OVER ({part}ORDER BY score DESC) AS cn FROM counts),
sums AS (
  SELECT {lead}CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos, sum(pos * cp / cn) / nullif(sum(pos), 0) AS ap,
         sum((n - pos) * (cp - pos / 2)) / nullif(sum(pos) * sum(n - pos), 0) AS auc,
         coalesce(max(cp) FILTER (cp / cn >= 0.5), 0) / nullif(sum(pos), 0) AS best FROM curve {group}),
evaluated AS (
  SELECT {lead}n, pos, CASE WHEN pos > 0 AND pos < n THEN {r('ap')} END AS pr_auc, CASE WHEN pos > 0 AND pos < n THEN {r('auc')} END AS roc_auc,
         CASE WHEN pos > 0 AND pos < n THEN {r('best')} END AS recall_at_p50 FROM sums)"""


GREEDY_SQL = f"""WITH RECURSIVE {B.SQL_ORDER_DATASET},
sizes AS (SELECT site, count(*) AS n FROM dataset GROUP BY 1),
queue AS MATERIALIZED (SELECT site, n, row_number() OVER (ORDER BY n DESC, site) AS rn FROM sizes),
filled(rn, weights, pick, site, n) AS (
  SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0, NULL::BIGINT, 0::BIGINT
  UNION ALL
  SELECT q.rn, list_transform(f.weights, lambda x, i: CASE WHEN i = list_position(f.weights, list_min(f.weights)) THEN x + q.n ELSE x END),
         list_position(f.weights, list_min(f.weights)), q.site, q.n
  FROM filled f JOIN queue q ON q.rn = f.rn + 1)
"""


@query("group_folds", GREEDY_SQL + "SELECT site, n AS rows, pick AS fold FROM filled WHERE rn > 0")
def group_folds(spark, sf_dir):
    return V.group_folds(_dataset(spark, sf_dir), "site")


@query("group_fold_metrics", GREEDY_SQL + f""",
splits AS (
  SELECT d.*, f.fold, CASE WHEN p.pick = f.fold THEN 'test' ELSE 'train' END AS role
  FROM dataset d JOIN filled p ON p.site = d.site AND p.rn > 0, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) f),
{BASELINE_CTES}, {_evaluate_sql('fold, method', 'long')} SELECT * FROM evaluated""")
def group_fold_metrics(spark, sf_dir):
    dataset = settle(_dataset(spark, sf_dir))
    folded = dataset.join(V.group_folds(dataset, "site").select("site", "fold"), "site")
    scored = V.seasonal_scores_by_group(folded, "day", "target").withColumn("persistence", F.coalesce("cur_price", F.lit(0.0)))
    scored = scored.withColumn("seasonal", F.round("seasonal", 9))
    return B.rounded(L.fold_metrics(scored, "target", ("persistence", "seasonal")))


@query("group_split_overlap", B.SQL_ORDER_DATASET.join(["WITH ", " SELECT site, 0 AS fold FROM dataset WHERE false"]))
def group_split_overlap(spark, sf_dir):
    """Groups that are in train and test of the same fold; there must be none."""
    roles = V.site_splits(_dataset(spark, sf_dir), "site").groupBy("site", "fold").agg(F.countDistinct("role").alias("roles"))
    return roles.filter("roles > 1").select("site", "fold")


@query("inner_time_validation", f"""WITH {B.SQL_ORDER_DATASET}
SELECT site, day, row_number() OVER (ORDER BY day, site) > greatest(1, floor((SELECT count(*) FROM dataset) * 0.8::DOUBLE)) AS is_validation FROM dataset""")
def inner_time_validation(spark, sf_dir):
    return V.inner_time_validation(_dataset(spark, sf_dir), "day", ["site"]).select("site", "day", "is_validation")


def _baselines(spark, sf_dir):
    scored = V.seasonal_scores_by_year(settle(_dataset(spark, sf_dir)), "day", "target", B.ORDER_START, B.ORDER_MIN_TEST)
    # rounding keeps equal rates equal whatever order they were summed in
    return scored.withColumn("persistence", F.coalesce("cur_price", F.lit(0.0))).withColumn("seasonal", F.round("seasonal", 9))


@query("baseline_scores", f"WITH {SQL_BASELINES} SELECT site, day, fold, persistence, {r('seasonal')} AS seasonal FROM scored")
def baseline_scores(spark, sf_dir):
    return B.rounded(_baselines(spark, sf_dir).select("site", "day", "fold", "persistence", "seasonal"))


@query("fold_metrics", f"WITH {SQL_BASELINES}, {_evaluate_sql('fold, method', 'long')} SELECT * FROM evaluated")
def fold_metrics(spark, sf_dir):
    return B.rounded(L.fold_metrics(_baselines(spark, sf_dir), "target", ("persistence", "seasonal")))


@query("pooled_benchmark", f"WITH {SQL_BASELINES}, {_evaluate_sql('method', 'long')} SELECT * FROM evaluated")
def pooled_benchmark(spark, sf_dir):
    return B.rounded(L.fold_metrics(_baselines(spark, sf_dir), "target", ("persistence", "seasonal"), keys=()))


@query("method_means", f"""WITH {SQL_BASELINES}, {_evaluate_sql('fold, method', 'long')}
SELECT method, {r('avg(pr_auc)', 5)} AS pr_auc, {r('avg(recall_at_p50)', 5)} AS recall_at_p50, {r('avg(roc_auc)', 5)} AS roc_auc FROM evaluated GROUP BY 1""")
def method_means(spark, sf_dir):
    metrics = B.rounded(L.fold_metrics(_baselines(spark, sf_dir), "target", ("persistence", "seasonal")))
    return B.rounded(S.method_means(metrics, ["method"]), 5)


@query("method_lift", f"""WITH {SQL_BASELINES}, {_evaluate_sql('method', 'long')}
SELECT {', '.join(f"{r(f'''max({m}) FILTER (method = 'persistence') - max({m}) FILTER (method = 'seasonal')''', 5)} AS {m}_lift" for m in ('pr_auc', 'recall_at_p50', 'roc_auc'))}
FROM evaluated""")
def method_lift(spark, sf_dir):
    pooled = B.rounded(L.fold_metrics(_baselines(spark, sf_dir), "target", ("persistence", "seasonal"), keys=()))
    return B.rounded(S.metric_lift(pooled, "method", "seasonal", "persistence"), 5)


@query("fold_pivot", f"""WITH {SQL_BASELINES}, {_evaluate_sql('fold, method', 'long')}
SELECT fold, max(pr_auc) FILTER (method = 'persistence') AS persistence, max(pr_auc) FILTER (method = 'seasonal') AS seasonal FROM evaluated GROUP BY 1""")
def fold_pivot(spark, sf_dir):
    metrics = L.fold_metrics(_baselines(spark, sf_dir), "target", ("persistence", "seasonal"))
    return B.rounded(S.fold_pivot(metrics, "fold", "method", ("persistence", "seasonal"), "pr_auc"))


def _graded_documents(spark, sf_dir):
    """Labelled documents scored by length in hundreds, so that scores tie."""
    documents, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    graded = labels.join(documents.select("doc_id", "n_chars", "lang"), "doc_id")
    return graded.select("doc_id", "lang", F.col("quality").alias("target"), F.col("toxic"),
                         F.floor(F.col("n_chars") / 100).cast("double").alias("score"))


SQL_GRADED = """graded AS (
  SELECT l.doc_id, d.lang, l.quality AS target, l.toxic, floor(d.n_chars / 100)::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"""


@query("average_precision", f"WITH {SQL_GRADED}, {_evaluate_sql('', 'graded')} SELECT * FROM evaluated")
def average_precision(spark, sf_dir):
    return B.rounded(S.evaluate(_graded_documents(spark, sf_dir), [], "target", "score"))


@query("average_precision_by_language", f"WITH {SQL_GRADED}, {_evaluate_sql('lang', 'graded')} SELECT * FROM evaluated")
def average_precision_by_language(spark, sf_dir):
    return B.rounded(S.evaluate(_graded_documents(spark, sf_dir), ["lang"], "target", "score"))


@query("precision_recall_points", f"""WITH {SQL_GRADED}, {_evaluate_sql('', 'graded')}
SELECT score, {r('cp / cn')} AS precision, {r('cp / (SELECT sum(pos) FROM counts)')} AS recall FROM curve""")
def precision_recall_points(spark, sf_dir):
    return B.rounded(S.precision_recall_points(_graded_documents(spark, sf_dir), [], "target", "score"))


def _stages(spark, sf_dir):
    scored = _baselines(spark, sf_dir)
    return scored.select("fold", ordinal_stage(F.col("label_value"), B.ORDER_STAGES).alias("actual"),
                         ordinal_stage(F.col("cur_price"), B.ORDER_STAGES).alias("predicted"))


def _stage(c: str) -> str:
    return " + ".join(f"coalesce(CAST({c} >= {t} AS INT), 0)" for t in B.ORDER_STAGES)


SQL_STAGES = SQL_BASELINES + f""",
staged AS (SELECT fold, {_stage('label_value')} AS actual, {_stage('cur_price')} AS predicted FROM scored)"""


@query("stage_confusion", f"""WITH {SQL_STAGES}
SELECT CAST(stage AS INT) AS stage, {', '.join(f"count(*) FILTER (actual = stage AND predicted = {j}) AS predicted_{j}" for j in range(3))}
FROM staged, range(3) t(stage) GROUP BY 1""")
def stage_confusion(spark, sf_dir):
    return S.confusion(_stages(spark, sf_dir), "actual", "predicted")


def _stage_metrics_sql() -> str:
    cells = ", ".join(f"(count(*) FILTER (actual = {i} AND predicted = {j}))::DOUBLE AS c{i}{j}" for i in range(3) for j in range(3))
    row = {i: f"(c{i}0 + c{i}1 + c{i}2)" for i in range(3)}
    col = {j: f"(c0{j} + c1{j} + c2{j})" for j in range(3)}
    observed = " + ".join(f"{(i - j) ** 2} * c{i}{j}" for i in range(3) for j in range(3))
    expected = " + ".join(f"{(i - j) ** 2} * {row[i]} * {col[j]}" for i in range(3) for j in range(3))
    f1 = " + ".join(f"coalesce(2 * c{i}{i} / nullif({row[i]} + {col[i]}, 0), 0)" for i in range(3))
    recalls = ", ".join(f"{r(f'coalesce(c{i}{i} / nullif({row[i]}, 0), 0)')} AS recall_{i}" for i in range(3))
    return f"""cells AS (SELECT fold, count(*) AS n, count(DISTINCT actual) AS classes, {cells} FROM staged GROUP BY 1)
SELECT fold, n, {r('(c00 + c11 + c22) / n')} AS accuracy, {r(f'({f1}) / 3')} AS macro_f1,
       CASE WHEN classes > 1 THEN {r(f'1 - ({observed}) / nullif(({expected}) / n, 0)')} END AS qwk, {recalls} FROM cells"""


@query("stage_metrics", f"WITH {SQL_STAGES}, {_stage_metrics_sql()}")
def stage_metrics(spark, sf_dir):
    return B.rounded(S.evaluate_stages(_stages(spark, sf_dir), ["fold"], "actual", "predicted"))


@query("stage_distribution", f"WITH {SQL_STAGES} SELECT actual, count(*) AS n FROM staged GROUP BY 1")
def stage_distribution(spark, sf_dir):
    return _stages(spark, sf_dir).groupBy("actual").agg(F.count("*").alias("n"))


@query("cumulative_stages", f"""WITH {SQL_GRADED},
p AS (SELECT doc_id, least(score / 40, 1) AS p_low, CASE WHEN toxic = 1 THEN 0.9 ELSE least(score / 80, 1) END AS p_high FROM graded)
SELECT doc_id, {r('p_low')} AS p_low, {r('least(p_high, p_low)')} AS p_high, CAST(p_low >= 0.5 AS INT) + CAST(least(p_high, p_low) >= 0.5 AS INT) AS stage FROM p""")
def cumulative_stages(spark, sf_dir):
    low = F.least(F.col("score") / 40, F.lit(1.0))
    high = F.when(F.col("toxic") == 1, F.lit(0.9)).otherwise(F.least(F.col("score") / 80, F.lit(1.0)))
    return B.rounded(_graded_documents(spark, sf_dir).select(
        "doc_id", low.alias("p_low"), capped(high, low).alias("p_high"), stage_from_probabilities(low, high).alias("stage")
    ))


# --- preprocessing and ranking ---

SCALED = ("cur_price", "cur_urgency", "horizon_days")


def _fitted(spark, sf_dir):
    dataset = B.order_dataset(spark, sf_dir).select("site", "day", "target", "kind", *SCALED)
    dataset = dataset.withColumn("horizon_days", F.col("horizon_days").cast("double"))
    train = dataset.filter(F.col("day") < "2000-01-01")
    scaled = P.apply_scaler(dataset, P.fit_scaler(train, SCALED), SCALED)
    return P.apply_codes(scaled, P.fit_codes(train, "kind"), "kind")


def _scaled_sql() -> str:
    parts = []
    for c in SCALED:
        fill = f"(SELECT coalesce(avg({c}), 0) FROM train)"
        scale = f"(SELECT coalesce(nullif(stddev_pop(coalesce({c}, {fill})), 0), 1) FROM train)"
        parts.append(f"(coalesce({c}, {fill}) - {fill}) / {scale} AS {c}")
    return ", ".join(parts)


SQL_FITTED = B.SQL_ORDER_DATASET + f""",
{B.SQL_SITES},
typed AS (SELECT d.site, day, target, kind, cur_price, cur_urgency, horizon_days::DOUBLE AS horizon_days FROM dataset d LEFT JOIN sites USING (site)),
train AS (SELECT * FROM typed WHERE day < DATE '2000-01-01'),
codes AS (SELECT kind, row_number() OVER (ORDER BY kind) AS code FROM (SELECT DISTINCT kind FROM train WHERE kind IS NOT NULL)),
fitted AS (SELECT site, day, target, t.kind, {_scaled_sql()}, coalesce(code, 0) AS kind_code FROM typed t LEFT JOIN codes USING (kind))"""


@query("train_only_preprocessing", f"""WITH {SQL_FITTED}
SELECT site, day, target, kind, {', '.join(f'{r(c)} AS {c}' for c in SCALED)}, kind_code FROM fitted""")
def train_only_preprocessing(spark, sf_dir):
    return B.rounded(_fitted(spark, sf_dir))


@query("ranked_contributions", f"WITH {SQL_FITTED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg(abs({c}))')} AS mean_abs FROM fitted" for c in SCALED))
def ranked_contributions(spark, sf_dir):
    return B.rounded(P.ranked_contributions(_fitted(spark, sf_dir), SCALED))


def _top_sql() -> str:
    cells = ", ".join(
        f"{{'w': -abs({c}), 'p': {i}, 't': '{c}(' || CASE WHEN {c} > 0 THEN '+' ELSE '-' END || ')'}}" for i, c in enumerate(SCALED)
    )
    return f"array_to_string(list_transform(list_sort([{cells}])[1:3], lambda x: x.t), ', ')"


@query("risk_table", f"""WITH {SQL_FITTED}, scored AS (SELECT *, 1 / (1 + exp(-cur_price - 0.1 * cur_urgency)) AS p FROM fitted)
SELECT site, day, round_even(p, 3) AS prob, {_top_sql()} AS top_features FROM scored ORDER BY p DESC, site, day LIMIT 15""")
def risk_table(spark, sf_dir):
    p = 1 / (1 + F.exp(-F.col("cur_price") - F.lit(0.1) * F.col("cur_urgency")))
    return P.risk_table(_fitted(spark, sf_dir).withColumn("p", p), ["site", "day"], "p", SCALED)


FEATURES = {  # more features than a row of the risk table names
    "price": "cur_price", "urgency": "CAST(0.5 AS DOUBLE) * cur_urgency", "horizon": "horizon_days",
    "month": "(month(day) - 6) / CAST(10 AS DOUBLE)", "code": "(kind_code - 3) / CAST(4 AS DOUBLE)",
}


def _named_top_sql() -> str:
    cells = ", ".join(f"{{'w': -abs({c}), 'p': {i}, 't': '{c}(' || CASE WHEN {c} > 0 THEN '+' ELSE '-' END || ')'}}" for i, c in enumerate(FEATURES))
    return f"array_to_string(list_transform(list_sort([{cells}])[1:3], lambda x: x.t), ', ')"


@query("risk_table_of_five", f"""WITH {SQL_FITTED},
named AS (SELECT site, day, {', '.join(f'round({sql}, 9) AS {c}' for c, sql in FEATURES.items())} FROM fitted),
scored AS (SELECT *, 1 / (1 + exp(-price - 0.2 * urgency)) AS p FROM named)
SELECT site, day, round_even(p, 3) AS prob, {_named_top_sql()} AS top_features FROM scored ORDER BY p DESC, site, day LIMIT 15""")
def risk_table_of_five(spark, sf_dir):
    """Five contributions a row, of which the table names the three strongest."""
    named = _fitted(spark, sf_dir).select("site", "day", *[F.round(F.expr(sql), 9).alias(c) for c, sql in FEATURES.items()])
    p = 1 / (1 + F.exp(-F.col("price") - F.lit(0.2) * F.col("urgency")))
    return P.risk_table(named.withColumn("p", p), ["site", "day"], "p", tuple(FEATURES))


@query("feature_leakage_found", f"""WITH {B.SQL_PANEL},
{panels.FEATURE_SQL},
later AS (SELECT site, day, CASE WHEN day >= DATE '2024-01-15' THEN value * 3 ELSE value END AS value, temp FROM panel),
{panels.FEATURE_SQL.replace('features AS', 'altered AS').replace('FROM panel', 'FROM later')}
SELECT site, day, 1 AS surplus FROM (SELECT * FROM features WHERE day <= DATE '2024-01-15' EXCEPT ALL SELECT * FROM altered WHERE day <= DATE '2024-01-15')""")
def feature_leakage_found(spark, sf_dir):
    """The same check where the day itself is altered too: the rows of that day must show."""
    cutoff = F.lit("2024-01-15").cast("date")
    panel = settle(B.event_panel(spark, sf_dir))
    altered = panel.withColumn("value", F.when(F.col("day") >= cutoff, F.col("value") * 3).otherwise(F.col("value")))
    before, after = (build_features(p, B.EVENT_SPEC) for p in (panel, altered))
    return leaked_rows(before, after, "day", cutoff).filter("surplus > 0").select("site", "day", "surplus")


@query("feature_leakage", f"""WITH {B.SQL_PANEL},
{panels.FEATURE_SQL},
later AS (SELECT site, day, CASE WHEN day > DATE '2024-01-15' THEN value * 3 ELSE value END AS value, temp FROM panel),
{panels.FEATURE_SQL.replace('features AS', 'altered AS').replace('FROM panel', 'FROM later')}
SELECT *, 1 AS surplus FROM (SELECT * FROM features WHERE day <= DATE '2024-01-15' EXCEPT ALL SELECT * FROM altered WHERE day <= DATE '2024-01-15')""")
def feature_leakage(spark, sf_dir):
    """Feature rows that change when only later measurements change; there must be none."""
    cutoff = F.lit("2024-01-15").cast("date")
    panel = settle(B.event_panel(spark, sf_dir))
    altered = panel.withColumn("value", F.when(F.col("day") > cutoff, F.col("value") * 3).otherwise(F.col("value")))
    before, after = (build_features(p, B.EVENT_SPEC) for p in (panel, altered))
    return leaked_rows(before, after, "day", cutoff)


# --- fitted models ---

def _learner(dataset) -> L.Learner:
    inputs = [c for c in model_inputs(dataset, "site", "day") if c not in ("kind", "basin")]
    return L.Learner(numeric=tuple(inputs), categorical=("kind", "basin"), patience=8, depth=4, step=0.1)


def _folds(dataset):
    return V.year_conditions(dataset, "day", B.ORDER_START, B.ORDER_MIN_TEST)


@query("cross_validated_classifier")
def cross_validated_classifier(spark, sf_dir):
    dataset = settle(B.order_dataset(spark, sf_dir))
    oof = L.cross_validate(dataset, _folds(dataset), _learner(dataset), "target", "day", "site", "cur_price")
    return L.fold_metrics(settle(oof), "target")


@query("cross_validated_stages")
def cross_validated_stages(spark, sf_dir):
    dataset = settle(B.order_dataset(spark, sf_dir))
    stages = settle(L.cross_validate_stages(
        dataset, _folds(dataset), _learner(dataset), "label_value", "day", "site", "cur_price", B.ORDER_STAGES
    ))
    out = None
    for method in ("model", "persistence"):
        part = S.evaluate_stages(stages, [], "actual", method).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


@query("feature_set_ablation")
def feature_set_ablation(spark, sf_dir):
    """The same folds with and without the rolling features, and the difference."""
    dataset = settle(B.order_dataset(spark, sf_dir))
    folds, full = _folds(dataset), _learner(dataset)
    slim = L.Learner(**{**full.__dict__, "numeric": tuple(c for c in full.numeric if "roll" not in c)})
    tables = []
    for name, learner in (("without_rolling", slim), ("with_rolling", full)):
        oof = L.cross_validate(dataset, folds, learner, "target", "day", "site", "cur_price")
        tables.append(L.fold_metrics(settle(oof), "target", ("model",), keys=()).withColumn("variant", F.lit(name)))
    both = settle(tables[0].unionByName(tables[1]))
    lift = S.metric_lift(both, "variant", "without_rolling", "with_rolling")
    return both.select("variant", "pr_auc", "recall_at_p50", "roc_auc").unionByName(lift.select(
        F.lit("lift").alias("variant"), *[F.col(f"{m}_lift").alias(m) for m in ("pr_auc", "recall_at_p50", "roc_auc")]
    ))


def _stage_models(spark, sf_dir):
    """Two production models fitted, stored as a pair with their cards, and loaded again."""
    dataset = settle(B.order_dataset(spark, sf_dir))
    learner = _learner(dataset)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    models = [L.train_production(dataset.withColumn("reached", (F.col("label_value") >= t).cast("int")), learner, "reached", ["day", "site"])
              for t in B.ORDER_STAGES]
    scored = L.probability(models[0], dataset, learner, "p")
    metrics = S.evaluate(scored, [], "target", "p").first().asDict()
    L.save_stage_models(models, path, dataset, learner, "label_value", "day", B.ORDER_STAGES,
                        metrics={k: metrics[k] for k in ("pr_auc", "roc_auc") if metrics[k] is not None})
    loaded, card = L.load_stage_models(spark, path)
    return dataset, learner, loaded, card, path


@query("served_stages")
def served_stages(spark, sf_dir):
    """Every customer's latest row, put to the stored stage models."""
    dataset, learner, models, _, _ = _stage_models(spark, sf_dir)
    latest = latest_rows(dataset, ["site"], ["day"])
    served = L.serve_stages(latest, *models, learner, label="label_value", thresholds=B.ORDER_STAGES)
    return served.select("site", "day", "p_low", "p_high", "stage", "actual_stage", "hit")


@query("served_history", f"""WITH {B.SQL_ORDER_DATASET}
SELECT site, day, {_stage('label_value')} AS actual_stage, true AS agrees FROM dataset""")
def served_history(spark, sf_dir):
    """Every labelled past row beside its actual stage; stage, probabilities and hit must agree with each other."""
    dataset, learner, models, _, _ = _stage_models(spark, sf_dir)
    served = L.serve_stages(dataset, *models, learner, label="label_value", thresholds=B.ORDER_STAGES)
    stage = (F.col("p_low") >= 0.5).cast("int") + (F.col("p_high") >= 0.5).cast("int")
    agrees = (F.col("p_high") <= F.col("p_low")) & F.col("p_low").between(0, 1) & (F.col("stage") == stage) & (F.col("hit") == (F.col("stage") == F.col("actual_stage")))
    return served.select("site", "day", "actual_stage", agrees.alias("agrees"))


@query("stage_model_cards", f"""WITH {B.SQL_ORDER_DATASET}
SELECT stage, count(*) AS n_train_rows, CAST(min(day) AS VARCHAR) AS date_from, CAST(max(day) AS VARCHAR) AS date_to,
       round(avg(CAST(label_value >= threshold AS INT)), 4) AS positive_rate, count(*) FILTER (label_value >= threshold) AS positives, true AS has_metrics
FROM dataset, (VALUES (1, {B.ORDER_STAGES[0]}), (2, {B.ORDER_STAGES[1]})) t(stage, threshold) GROUP BY stage""")
def stage_model_cards(spark, sf_dir):
    """What the cards of the stored pair say of its training rows."""
    _, _, _, pair, path = _stage_models(spark, sf_dir)
    out = None
    for i in (1, 2):
        card = L.load_model(spark, f"{path}/stage_{i}")[1]
        one = card.select(F.lit(i).alias("stage"), "n_train_rows", "date_from", "date_to", "positive_rate",
                          F.lit({"cv_pr_auc", "cv_roc_auc", "features", "seed", "rounds"} <= set(card.columns)).alias("has_metrics"))
        one = one.crossJoin(pair.select(F.col(f"rows_from_{i}").alias("positives")))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("out_of_fold_rows_by_site", GREEDY_SQL + """
SELECT d.site, d.day, p.pick AS fold, d.target, coalesce(cur_price, 0) AS persistence, true AS scored FROM dataset d JOIN filled p ON p.site = d.site AND p.rn > 0""")
def out_of_fold_rows_by_site(spark, sf_dir):
    """The classifier over site folds: every row is scored once, by the model that has not seen its site."""
    dataset = settle(B.order_dataset(spark, sf_dir))
    folded = dataset.join(V.group_folds(dataset, "site").select("site", "fold"), "site")
    oof = L.cross_validate(folded, V.group_conditions(5), _learner(dataset), "target", "day", "site", "cur_price")
    return oof.select("site", "day", "fold", "target", "persistence", F.col("model").between(0, 1).alias("scored"))


@query("served_baseline_stages", f"""WITH {B.SQL_ORDER_DATASET},
latest AS (SELECT * FROM dataset QUALIFY row_number() OVER (PARTITION BY site ORDER BY day DESC) = 1)
SELECT site, day, {_stage('cur_price')} AS stage, {_stage('label_value')} AS actual_stage, ({_stage('cur_price')}) = ({_stage('label_value')}) AS hit FROM latest""")
def served_baseline_stages(spark, sf_dir):
    """The same lookup served by persistence of the current stage."""
    latest = latest_rows(_dataset(spark, sf_dir), ["site"], ["day"])
    stage, actual = (ordinal_stage(F.col(c), B.ORDER_STAGES) for c in ("cur_price", "label_value"))
    return latest.select("site", "day", stage.alias("stage"), actual.alias("actual_stage"), (stage == actual).alias("hit"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    dataset = settle(B.order_dataset(spark, sf_dir))
    learner = _learner(dataset)
    model = L.train_boosted(dataset, learner, "target", ["day", "site"])
    return L.importance(model, spark)


@query("boosting_loss_curve")
def boosting_loss_curve(spark, sf_dir):
    """Validation loss of every round tried, and which rounds the model keeps."""
    dataset = settle(B.order_dataset(spark, sf_dir))
    return L.loss_curve(L.tune_boosted(dataset, _learner(dataset), "target", ["day", "site"]), spark)
