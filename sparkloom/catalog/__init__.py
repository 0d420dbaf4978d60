"""Registered queries: each binds an operator to the input tables and, where one exists, to a SQL check."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

MODULES = ["words", "texts", "language", "entities", "classification", "flows", "business", "machines", "runs", "statistics", "sequences", "sequences2", "graphs", "matrices", "rasters", "streams"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
