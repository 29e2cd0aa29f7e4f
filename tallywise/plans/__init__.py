"""Queries bound to the test tables, each next to its oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["review_flow", "scalars", "schema_ops", "rules", "joins", "aggregates", "ordering",
           "file_scans", "detection", "text_features", "classifiers", "streams"]


def load():
    """All bound queries and their oracle SQL."""
    for m in MODULES:
        importlib.import_module(f"tallywise.plans.{m}")
    from tallywise.plans.catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
