"""Operators for preparing training data.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

from ._shared import ORACLES, QUERIES

MODULES = ["queries"]


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
