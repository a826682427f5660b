"""Training-data operators. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Import every module of this package once and return (queries, oracle SQL)."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from snapledger.llm.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
