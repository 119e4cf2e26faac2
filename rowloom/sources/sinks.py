"""Table sinks. Every sink writes a folder of part files, one per task."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.names import named

_KNOWN = ("csv", "parquet", "json")
#: Readers pass over names that begin with an underscore.
_HEADER = "_header"


def save_table(df: DataFrame, path: str, mode: str = "error", encoding: str = "utf-8") -> str:
    """Writes by suffix: ``.parquet``, ``.json`` (one record per line), else CSV with a header.

    A suffix that is unknown gets ``.csv`` added. Returns the path written. CSV carries no byte
    order mark: with many part files it would end up in the middle of the data. Every part begins with the header, and a hidden
    folder beside the parts says so, which lets ``load_table`` tell it from data.
    """
    writer = df.write.mode(mode)
    if path.endswith(".parquet"):
        writer.parquet(path)
    elif path.endswith(".json"):
        writer.option("ignoreNullFields", "false").json(path)
    else:
        path = path if path.endswith(".csv") else path + ".csv"
        writer.options(header="true", encoding=encoding, escape='"', emptyValue="").csv(path)
        titles = df.sparkSession.createDataFrame([(json.dumps({"columns": df.columns, "encoding": encoding, "delimiter": ","}),)], "value string")
        titles.write.mode("overwrite").text(f"{path}/{_HEADER}")
    return path


def header_of(spark: SparkSession, path: str) -> dict | None:
    """``columns``, ``encoding`` and ``delimiter`` of a folder that ``save_table`` wrote; every part begins with the columns' names."""
    try:
        rows = spark.read.text(f"{path}/{_HEADER}").collect()
    except AnalysisException:
        return None
    return json.loads(rows[0]["value"]) if rows else None


def save_column(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """Writes one column as text, each value followed by a ``---`` line; null counts as ``''``."""
    df.select(column_text(named(column), df.schema[column].dataType).alias("value")).write.mode(mode).text(path)


def column_text(value: Column, dtype: T.DataType) -> Column:
    return F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit("\n---"))


def output_path(table_path: str, requested: str | None = None) -> str:
    """``requested`` if its suffix is known, else ``<table>_mutated.<suffix of the table>``."""
    if requested and requested.rsplit(".", 1)[-1] in _KNOWN and "." in requested:
        return requested
    base, _, suffix = table_path.rpartition(".")
    if not base or "/" in suffix:
        return table_path + "_mutated"
    return f"{base}_mutated.{suffix}"
