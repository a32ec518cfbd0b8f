"""All catalogue queries by name."""

from __future__ import annotations

import importlib

from tickloom.plans.base import CATALOG, Query

FAMILIES = ["sampling", "paths", "labels", "tables", "evaluation", "diagnostics", "features", "portfolio"]


def catalog() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"tickloom.plans.{family}")
    return CATALOG
