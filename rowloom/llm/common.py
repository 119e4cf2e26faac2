"""What several corpus operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.names import named

#: White space between words: space and the control characters from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the names an operator works with.

    Whatever else a table holds, and whatever it is called, stays outside.
    """
    return df.select(*[exact(df, name).alias(alias) for alias, name in wanted.items()])


def exact(df: DataFrame, name: str) -> Column:
    """The column of exactly this spelling, also where others differ from it in case only."""
    same = [c for c in df.columns if c.lower() == name.lower()]
    if len(same) > 1 and name in same:
        renamed = [f"_other{i}" if c != name else c for i, c in enumerate(df.columns)]
        raise ValueError(f"columns {same} differ in case only; rename them first, e.g. toDF(*{renamed})")
    return named(name)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back to the machine when it ends: Python workers live on for the next task."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            import contextlib
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            # Only glibc has it.
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run
