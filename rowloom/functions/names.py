"""Columns by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name: names made from header cells may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_named(names: Iterable[str]) -> list[Column]:
    return [named(name) for name in names]
