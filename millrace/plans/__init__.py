"""Registered queries, each beside the SQL that states the same result."""

from __future__ import annotations

import importlib

from millrace.plans.registry import ORACLES, QUERIES

FAMILIES = (
    "ingest",
    "cleaning",
    "quality",
    "observability",
    "timeline",
    "reconciliation",
    "findings",
    "governance",
    "scalar",
    "reports",
    "streams",
    "learning",
)


def load() -> tuple[dict, dict]:
    for family in FAMILIES:
        importlib.import_module(f"millrace.plans.{family}")
    return QUERIES, ORACLES
