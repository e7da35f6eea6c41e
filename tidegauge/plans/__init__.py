"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

from tidegauge.plans.registry import ORACLES, QUERIES, Query

MODULES = ("panels", "audits", "cells", "backtests", "scores", "places", "landing")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidegauge.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
