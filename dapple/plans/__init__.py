"""Named queries over the test tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

MODULES = ("training", "bias", "labels", "records", "texts")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"dapple.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"dapple.plans.{m}").SQL.items()}
