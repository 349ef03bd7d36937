"""Registered queries: each joins an operator with its inputs and, where SQL can say it, with a check query."""

from __future__ import annotations

import importlib

MODULES = [
    "roles", "cleaning", "quality", "master", "rules", "scoring", "fusion", "similarity", "geo", "dashboard", "civic", "models", "streaming",
]


def load_all() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"ledgerlens.catalog.{module}")
    from ledgerlens.catalog import registry

    return registry.QUERIES, registry.ORACLES
