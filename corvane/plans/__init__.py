"""Query plans of the engine, by family; every module has QUERIES and SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["incremental", "splits", "texts", "quality", "dedupe", "state", "analysis", "exports", "pages", "more"]


def modules() -> list:
    return [importlib.import_module(f"corvane.plans.{name}") for name in FAMILIES]
