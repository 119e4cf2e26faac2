"""Putting generated values back on the rows they belong to, and column definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named, named
from rowloom.plans.scale import with_position
from rowloom.session import written
from rowloom.sources.tables import ROW_ID


def align(table: DataFrame, generated: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Every row of ``table`` with its value from ``generated`` (``row_id``, ``column``), else ``''``."""
    values = generated.select(row_id, named(column).alias("_value"))
    joined = table.join(values, row_id, "left")
    return joined.select(*all_named(table.columns), _or_empty(F.col("_value")).alias(column))


def align_in_place(table: DataFrame, processed: Column, value: Column, column: str) -> DataFrame:
    """The same where the value is an expression over the row: no join at all."""
    return table.withColumn(column, F.when(processed, _or_empty(value)).otherwise(F.lit("")))


def append_remainder(
    processed: DataFrame, table: DataFrame, column: str, row_id: str = ROW_ID
) -> DataFrame:
    """Processed rows, then the rows of ``table`` that were not processed, with ``''``."""
    rest = table.join(processed.select(row_id), row_id, "left_anti").withColumn(column, F.lit(""))
    return processed.withColumn(column, _or_empty(named(column))).unionByName(rest)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def valid_definitions(definitions: DataFrame) -> DataFrame:
    """Definitions ``(…, headers, instructions)`` with at least one header part and instructions."""
    headers = F.filter("headers", lambda h: h.isNotNull() & (h != ""))
    return definitions.withColumn("headers", headers).where(
        (F.size("headers") > 0) & (F.coalesce(F.col("instructions"), F.lit("")) != "")
    )


def one_row_per_definition(rows: DataFrame, definitions: DataFrame | Sequence[dict]) -> DataFrame:
    """Every row once per definition, with the definition's fields as column ``definition``.

    A list written by a person travels inside the plan as one literal array, so the rows are only exploded. A table of more
    definitions than ``LITERAL_DEFINITIONS`` is joined by their numbers.
    """
    if isinstance(definitions, DataFrame):
        found = definitions.limit(LITERAL_DEFINITIONS + 1).collect()
        if len(found) > LITERAL_DEFINITIONS:
            return _joined_definitions(rows, definitions)
        definitions = [row.asDict() for row in sorted(found, key=lambda row: row["def_id"])]
    array = F.array(*[_definition_struct(i, item) for i, item in enumerate(definitions)])
    return rows.withColumn("definition", F.explode(array))


#: Definitions that are written into the plan.
LITERAL_DEFINITIONS = 1_000


def _joined_definitions(rows: DataFrame, definitions: DataFrame) -> DataFrame:
    """Each row with the numbers of all definitions, and the definitions joined to them; hot keys cannot occur, as every row has every number."""
    example = F.col("example") if "example" in definitions.columns else F.lit(None).cast("string")
    fields = F.struct(
        F.col("def_id").cast("int").alias("def_id"), F.array_join("headers", " - ").alias("column"), "instructions",
        F.coalesce(example, F.lit("")).alias("example"),
    )
    numbered = with_position(definitions.select(F.col("def_id").cast("long").alias("def_id"), fields.alias("definition")), "def_id", "_number")
    numbered = written(numbered.select("_number", "definition"), "definitions")
    whole = rows.select(F.struct(*all_named(rows.columns)).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(numbered.count()))).alias("_number"))
    joined = whole.join(numbered, "_number")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "definition")


def _definition_struct(index: int, item: dict) -> Column:
    return F.struct(
        F.lit(item.get("def_id", index)).cast("int").alias("def_id"),
        F.lit(" - ".join(item["headers"])).alias("column"),
        F.lit(item["instructions"]).alias("instructions"),
        F.lit(item.get("example") or "").alias("example"),
    )


def columns_per_definition(
    values: DataFrame, names: Sequence[str], row_id: str = ROW_ID, newest: Column | None = None
) -> DataFrame:
    """Long values ``(row_id, column, value)`` to one column per definition, in the given order.

    One aggregate, combined before its shuffle. ``newest`` orders repeated values; the greatest counts.
    """
    value = F.coalesce(F.col("value"), F.lit(""))

    def pick(name: str) -> Column:
        mine = F.col("column") == name
        if newest is None:
            return F.max(F.when(mine, value))
        return F.max_by(F.when(mine, value), F.when(mine, newest))

    wide = values.groupBy(row_id).agg(*[pick(n).alias(n) for n in names])
    return wide.select(row_id, *[F.coalesce(named(n), F.lit("")).alias(n) for n in names])
