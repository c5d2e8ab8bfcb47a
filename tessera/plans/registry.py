"""All queries by name, each with its oracle SQL where DuckDB can express it."""

from __future__ import annotations

import importlib

from tessera.plans.registration import ORACLES, QUERIES

MODULES = ("preparing", "duplicates", "lexical", "modelling", "ranking", "importing", "packing", "evaluating", "hygiene", "streams")

for _name in MODULES:
    importlib.import_module(f"tessera.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
