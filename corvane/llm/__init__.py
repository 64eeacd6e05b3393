"""Operators on texts and pairs for training data; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

FAMILIES = ["overlap", "wrappers", "leaks", "spans", "defects", "markup", "history", "mixing"]


def modules() -> list:
    return [importlib.import_module(f"corvane.llm.{name}_queries") for name in FAMILIES]
