"""Adding generated columns to a table, from end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named, named
from rowloom.functions.text import json_object
from rowloom.operators.combine import align_in_place, columns_per_definition, one_row_per_definition
from rowloom.operators.embed import Encoder
from rowloom.operators.generate import Generator, generate_once, reply_or_error, reply_order, with_request
from rowloom.operators.payload import (
    PromptTemplate, cells_as_text, output_column_name, prompt, row_payload,
)
from rowloom.operators.replies import new_value
from rowloom.operators.retrieve import LINE_TOP_K, Limits, chunks_per_row, context_text
from rowloom.operators.rows import SORTED_LIMIT, last_row_to_process, non_empty, non_empty_rows
from rowloom.session import new_folder
from rowloom.sources.tables import ROW_ID


def add_column(
    table: DataFrame,
    columns: Sequence[str],
    instructions: str,
    reply: Callable[[Column], Column],
    column: str | Sequence[str] | None = None,
    max_rows: int | None = None,
    row_id: str = ROW_ID,
    template: PromptTemplate = PromptTemplate(),
) -> DataFrame:
    """Adds one column whose replies are an expression over the prompt.

    Everything stays in one pass over the table: rows that are empty or beyond ``max_rows`` get
    ``''`` in place.
    """
    processed = non_empty(table, columns)
    if max_rows is not None:
        last = last_row_to_process(table, columns, max_rows, row_id)
        processed = processed & (F.col(row_id) <= F.lit(last)) if last is not None else F.lit(False)
    text = prompt(row_payload(table, columns), instructions, template=template)
    name = output_column_name(column, table.columns)
    return align_in_place(table, processed, new_value(reply(text)), name)


def generate_columns(
    table: DataFrame,
    columns: Sequence[str],
    definitions: Sequence[dict],
    load_generator: Callable[[], Generator],
    path: str | None = None,
    chunks: DataFrame | None = None,
    load_encoder: Callable[[], Encoder] | None = None,
    max_rows: int | None = None,
    on_error: str = "message",
    context: Column | str = "",
    row_id: str = ROW_ID,
    template: PromptTemplate = PromptTemplate(),
    limits: Limits = Limits(),
    batch: int = 32,
    max_tasks: int | None = None,
) -> DataFrame:
    """``table`` with one generated column per definition (``headers``, ``instructions``, ``example``).

    Replies are written to ``path`` before they are used, so a run that broke off goes on
    where it stopped. With ``chunks`` each row gets the chunks that its lines ask for.
    """
    if not columns:
        raise ValueError("choose at least one source column")
    # Of definitions with one name the last counts, at the place of the first.
    definitions = list({" - ".join(d["headers"]): d for d in definitions}.values())
    rows = non_empty_rows(table, columns, max_rows, row_id)
    cells = rows.select(row_id, *[text.alias(name) for name, text in cells_as_text(rows, columns)])
    values = [(c, named(c)) for c in columns]
    asked = cells.select(
        row_id,
        json_object(values, indent=2).alias("payload"),
        F.length(json_object(values)).alias("payload_length"),
    )
    if chunks is not None:
        found = chunks_per_row(cells, chunks, columns, load_encoder, row_id, LINE_TOP_K, limits)
        asked = asked.join(found, row_id, "left").withColumn("context", context_text(F.col("chunks"))).drop("chunks")
    else:
        asked = asked.withColumn("context", F.lit(context) if isinstance(context, str) else context)

    each = one_row_per_definition(asked, definitions)
    text = prompt(
        F.col("payload"), F.col("definition.instructions"), F.col("context"), F.col("definition.example"), template
    )
    requests = with_request(each, text, F.col("payload_length"), F.length("context")).select(
        row_id, F.col("definition.def_id").alias("def_id"), F.col("definition.column").alias("column"), "request"
    )
    path = path or new_folder(table.sparkSession, "replies")
    if max_tasks is None and max_rows is not None and max_rows <= SORTED_LIMIT:
        # A sorted limit leaves one partition, however many files the table has.
        batches = -(-max_rows * len(definitions) // batch)
        max_tasks = max(1, min(batches, table.sparkSession.sparkContext.defaultParallelism))
    replies = generate_once(requests, load_generator, path, [row_id, "def_id", "column"], batch, max_tasks)
    value = new_value(reply_or_error(F.col("reply"), F.col("error"), on_error))
    parsed = replies.withColumn("value", value)

    names = [" - ".join(d["headers"]) for d in definitions]
    wide = columns_per_definition(parsed, names, row_id, newest=reply_order())
    out = table.join(wide.select(F.col(row_id), *[named(n).alias(f"_value_{i}") for i, n in enumerate(names)]), row_id, "left")
    final = []
    for i, name in enumerate(names):
        final.append(F.coalesce(F.col(f"_value_{i}"), F.lit("")).alias(output_column_name(name, table.columns, names)))
    return out.select(*all_named(table.columns), *final)
