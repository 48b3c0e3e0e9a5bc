"""Queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans


def _modules():
    return [importlib.import_module(f"{plans.__name__}.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]


def queries() -> dict:
    """name -> function of (spark, sf_dir)."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> the same rows in DuckDB SQL."""
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLES", {}).items()}
