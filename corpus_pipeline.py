"""A corpus cleaning job in stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import table
from tidegauge.llm.decontaminate import stage_decontaminate
from tidegauge.llm.line_dedup import stage_dedup_lines
from tidegauge.llm.mixing import stage_mix
from tidegauge.llm.ngram_join import keep_one_per_group
from tidegauge.llm.toxicity import stage_reject_toxic
from tidegauge.session import settle

STAGES = [
    ("toxicity", stage_reject_toxic),
    ("line_dedup", stage_dedup_lines),
    ("near_duplicates", keep_one_per_group),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
]

ORACLE_SQL = None  # a trained classifier and a decomposition have no SQL; tests/llm compares each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
