"""Every registered query and its SQL twin, gathered from the query modules."""

from __future__ import annotations

import importlib

MODULES = ("weft.plans.relational", "weft.plans.functions", "weft.plans.flow", "weft.plans.documents", "weft.plans.graphs", "weft.plans.languages", "weft.plans.streams", "weft.plans.geometry", "weft.plans.dialect", "weft.plans.statements")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(module), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
