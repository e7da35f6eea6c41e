"""Registered queries of the text operators, and the SQL they are checked against."""

from __future__ import annotations

from tidegauge.llm import (
    collocations, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, runs, secrets, suffix_tree, toxicity,
    url_filter, warc,
)
from tidegauge.plans.registry import Query

MODULES = (quality, toxicity, url_filter, decontaminate, suffix_tree, ngram_join, secrets, line_dedup, language_id, mixing,
           collocations, runs, warc)


def queries() -> dict[str, Query]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
