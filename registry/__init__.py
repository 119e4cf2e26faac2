"""Queries over the driver tables, each with its SQL twin where one can be written."""

from __future__ import annotations

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MODULES = ("tables", "rows", "documents", "retrieval", "replies", "metrics")


def load() -> tuple[dict, dict]:
    """All queries and all SQL texts, by name."""
    found, sql = {}, {}
    for name in _MODULES:
        module = importlib.import_module(f"registry.{name}")
        found.update(module.QUERIES)
        sql.update(module.SQL)
    return found, sql
