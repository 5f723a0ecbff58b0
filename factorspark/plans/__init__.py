"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

from factorspark.plans import registry

MODULES = ("technical", "scoring", "trends", "selection", "flow", "regimes", "portfolios", "grid", "ledger", "operations", "files")


def load():
    """Import every plan module once and return (queries, oracles)."""
    for name in MODULES:
        importlib.import_module(f"factorspark.plans.{name}")
    return registry.QUERIES, registry.ORACLES
