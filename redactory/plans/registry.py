"""All queries of the engine and their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil

from redactory import plans


def _modules():
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if m.name.endswith("_queries"):
            yield importlib.import_module(f"redactory.plans.{m.name}")


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
