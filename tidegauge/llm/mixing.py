"""Mixing sources to target weights by iterative proportional fitting, and sampling by the fitted weights.

Documents are counted into cells of source, language and topic. The cells' token weights are raked: scaled to the target
shares of each margin in turn, again and again, and held at what the cell can supply. A document's probability is the
keep rate times its cell's fitted weight over its tokens; a hash of its id decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import WORD, table
from tidegauge.plans.registry import Query
from tidegauge.session import settle

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """``flatten`` makes default targets from the observed shares: 1 leaves them, 0 makes all categories equal.

    ``targets`` fixes the shares of a margin instead; categories it leaves out get none. They are rescaled to sum to 1.
    """

    rate: float = 0.5
    flatten: float = 0.5
    rounds: int = 8
    seed: int = 17
    targets: dict[str, dict[str, float]] = field(default_factory=dict)


def topic_of(text: Column, tokens: Column) -> Column:
    """Kind of text, by its shape."""
    marks, digits = F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.regexp_count(text, F.lit("[0-9]"))
    return (
        F.when(tokens == 0, "empty").when(10 * marks >= tokens, "marked").when(4 * digits >= tokens, "numeric")
        .when(tokens < 150, "brief").when(tokens < 600, "article").otherwise("long")
    )


def _described(docs: DataFrame) -> DataFrame:
    """Adds cell and token count; a null source or language is a category of its own."""
    counted = docs.withColumn("_tokens", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long"))
    return counted.withColumn("_topic", topic_of(F.coalesce("_text", F.lit("")), F.col("_tokens")))


def fit_weights(cells: DataFrame, mix: Mix) -> DataFrame:
    """Rake ``cells`` (source, lang, topic, tokens): adds weight, the fitted number of tokens before the keep rate."""
    spark = cells.sparkSession
    out = cells
    sums = {m: cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("_n")) for m in MARGINS}
    for m in MARGINS:
        if m in mix.targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in mix.targets[m].items()], f"{m} string, _goal double")
            goal = sums[m].join(given, m, "left").select(m, F.coalesce("_goal", F.lit(0.0)).alias("_goal"))
        else:
            goal = sums[m].select(m, F.when(F.col("_n") > 0, F.pow("_n", F.lit(mix.flatten))).otherwise(0.0).alias("_goal"))
        whole = goal.agg(F.sum("_goal").alias("_whole"))
        out = out.join(goal.crossJoin(F.broadcast(whole)).select(m, (F.col("_goal") / F.nullif("_whole", F.lit(0.0))).alias(f"_goal_{m}")), m)  # one row
    everything = cells.agg(F.sum("tokens").cast("double").alias("_total"))
    out = settle(out.crossJoin(F.broadcast(everything)).withColumn("weight", F.col("tokens").cast("double")))  # one row
    for turn in range(mix.rounds):
        for m in MARGINS:
            held = F.sum("weight").over(Window.partitionBy(m))
            scaled = F.col("weight") * F.col(f"_goal_{m}") * F.col("_total") / F.nullif(held, F.lit(0.0))
            out = out.withColumn("weight", F.least(F.coalesce(scaled, F.lit(0.0)), F.col("tokens") / mix.rate))
        if turn % 2 == 1:
            out = settle(out)
    return out.select(*MARGINS, "tokens", "weight")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", carry: bool = False) -> DataFrame:
    """Sample documents so that token shares approach the targets.

    Returns per row of ``docs``: doc_id, source, lang, topic, tokens, probability, kept; with ``carry`` also the whole
    row as the struct ``row``. Null sources and languages count as the category ``unknown``; texts without words weigh
    nothing and are kept at the plain rate. Rows that share an id share their draw; a null id is drawn as the empty
    text. A cell whose fitted weight exceeds its supply is taken whole.
    """
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"),
        F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("unknown")).alias("lang"), *whole)
    described = _described(rows).select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), *["row"] * carry)
    if not carry:
        described = settle(described)  # a few columns a document; the texts are read once
    cells = settle(described.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    fitted = fit_weights(cells, mix).select(*MARGINS, F.when(F.col("tokens") > 0, mix.rate * F.col("weight") / F.col("tokens")).otherwise(mix.rate).alias("probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return described.join(settle(fitted), list(MARGINS)).select(
        "doc_id", *MARGINS, "tokens", "probability", (draw < F.col("probability")).alias("kept"), *["row"] * carry)


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.withColumn("probability", F.round("probability", 6))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with their topic and probability."""
    drawn = mix_sources(docs, carry=True).where("kept")
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("topic").alias("mix_topic"), F.round("probability", 6).alias("mix_probability"))


def _sql(mix: Mix) -> str:
    head = r"""
WITH t AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS text,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
d AS (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN 10 * len(regexp_extract_all(text, '[#*$%&|<>]')) >= tokens THEN 'marked'
  WHEN 4 * len(regexp_extract_all(text, '[0-9]')) >= tokens THEN 'numeric' WHEN tokens < 150 THEN 'brief' WHEN tokens < 600 THEN 'article' ELSE 'long' END AS topic FROM t),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"""
    parts = [head]
    goals = []
    for m in MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, pow(n, {mix.flatten}) * (n > 0)::INT / sum(pow(n, {mix.flatten}) * (n > 0)::INT) OVER () AS g FROM (SELECT {m}, sum(tokens) AS n FROM c GROUP BY {m}))")
        goals.append(f"(SELECT g FROM g_{m} WHERE g_{m}.{m} = c.{m}) AS goal_{m}")
    parts.append(f"w0 AS (SELECT c.*, {', '.join(goals)}, sum(tokens) OVER () AS total, tokens AS weight FROM c)")
    k = 0
    for _ in range(mix.rounds):
        for m in MARGINS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (least(coalesce(weight * goal_{m} * total / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0), tokens / {mix.rate}) AS weight) FROM w{k})")
            k += 1
    return ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, d.tokens AS tokens, round(p, 6) AS probability, ('0x' || substr(md5('{mix.seed}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < p AS kept
FROM d JOIN (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN {mix.rate} * weight / tokens ELSE {mix.rate} END AS p FROM w{k}) f USING (source, lang, topic)
"""


QUERIES: dict[str, Query] = {"op10_mixing_sources": op10_mixing_sources}
ORACLES: dict[str, str] = {"op10_mixing_sources": _sql(Mix())}
