"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ("relational", "ordered", "sampling", "vectors", "texts", "state", "reviews", "streams", "judgements", "sourcing")

for _name in MODULES:
    importlib.import_module(f"attesta.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
