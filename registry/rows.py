"""Source columns, payloads, prompts, empty rows, and combining results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import MESSY_CUSTOMERS, messy_customers, sql_filled, sql_json, table
from rowloom.operators.combine import (
    align, append_remainder, columns_per_definition, one_row_per_definition, valid_definitions,
)
from rowloom.operators.payload import (
    CLOSING, CONTRACT, LABELS, TASK, approx_tokens, cells_as_text, prompt, row_payload, token_budget,
)
from rowloom.operators.rows import count_non_empty_rows, non_empty, non_empty_rows, select_sources

CELLS = ["name", "segment"]


def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_sources(table(spark, sf_dir, "orders"), "4-5,0,9", row_id=None)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a column of every kind."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        key,
        F.when(key % 5 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 4 == 0, price * 1e13).when(key % 4 == 1, price / 1e10).when(key % 4 == 2, price * 1000)
        .otherwise(price).alias("price"),
        (key % 2 == 0).alias("even"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(key % 3).cast("decimal(18,6)") / 4)).alias("moment"),
        F.to_date("o_orderdate").alias("day"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"),
    )


def canonical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixed(spark, sf_dir)
    return mixed.select(*[text.alias(name) for name, text in cells_as_text(mixed, mixed.columns)])


def payload_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", row_payload(docs, ["source", "text", "n_chars"]).alias("payload"))


def payload_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = messy_customers(spark, sf_dir)
    return customers.select("row_id", row_payload(customers, [*CELLS, "balance"], indent=None).alias("payload"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", approx_tokens(F.length("text")).alias("tokens")
    )


def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", token_budget(F.length("text"), F.length("source")).alias("budget")
    )


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = messy_customers(spark, sf_dir)
    text = prompt(row_payload(customers, CELLS), "Guess the industry.", F.col("segment"), "Row 1: none")
    return customers.select("row_id", text.alias("prompt"))


def filled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = messy_customers(spark, sf_dir)
    return customers.select("row_id", non_empty(customers, CELLS).alias("filled"))


def non_empty_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return non_empty_rows(messy_customers(spark, sf_dir), CELLS)


def non_empty_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return non_empty_rows(messy_customers(spark, sf_dir), CELLS, max_rows=50)


def non_empty_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_non_empty_rows(messy_customers(spark, sf_dir), [0, 1, 7])


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = non_empty_rows(messy_customers(spark, sf_dir), CELLS)
    return rows.where(F.col("balance") > 0).withColumn("value", F.concat(F.lit("v"), F.col("row_id").cast("string")))


def align_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(messy_customers(spark, sf_dir), _generated(spark, sf_dir), "value")


def remainder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append_remainder(_generated(spark, sf_dir), messy_customers(spark, sf_dir), "value")


DEFINITIONS = [
    {"headers": ["Segment", "short"], "instructions": "Shorten.", "example": "Row 1: x"},
    {"headers": ["Rating"], "instructions": "Rate it."},
]


def definition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns at once; the value tells which definition and row it was made for."""
    rows = non_empty_rows(messy_customers(spark, sf_dir), CELLS)
    each = one_row_per_definition(rows, DEFINITIONS)
    values = each.select(
        "row_id", F.col("definition.column").alias("column"),
        F.concat("definition.instructions", F.lit(" "), F.col("segment")).alias("value"),
    )
    return columns_per_definition(values, ["Segment - short", "Rating"])


def definition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions derived from parts, some without headers or instructions."""
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("def_id"),
        F.array(F.when(size % 3 == 0, F.lit("")).otherwise(F.col("p_name")),
                F.when(size % 2 == 0, F.lit("")).otherwise(F.col("p_brand"))).alias("headers"),
        F.when(size % 5 == 0, F.lit("")).when(size % 7 != 0, F.col("p_type")).alias("instructions"),
    )
    return valid_definitions(parts).select("def_id", F.array_join("headers", " - ").alias("column"), "instructions")


QUERIES = {
    "select_columns": select_columns,
    "canonical_cells": canonical_cells,
    "payload_pretty": payload_pretty,
    "payload_compact": payload_compact,
    "token_estimate": token_estimate,
    "token_budgets": token_budgets,
    "prompt_text": prompt_text,
    "filled_flags": filled_flags,
    "non_empty_all": non_empty_all,
    "non_empty_first": non_empty_first,
    "non_empty_count": non_empty_count,
    "align_values": align_values,
    "remainder_rows": remainder_rows,
    "definition_columns": definition_columns,
    "definition_filter": definition_filter,
}

FILLED = f"({sql_filled('name')} OR {sql_filled('segment')})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The prompt of a customer with the payload ``p``, as SQL.
def sql_prompt(payload: str, instructions: str, context: str, example: str) -> str:
    pieces = [_q(f"Task: {TASK}\n\n")]
    values = {"source_data": payload, "task_instructions": instructions, "context": context, "example": example}
    for name, value in values.items():
        pieces += [_q(f"{LABELS[name]}:\n"), value, _q("\n\n")]
    pieces.append(_q(f"Expected Output:\n- new_value: {LABELS['new_value']}\n\n{CLOSING}\n{CONTRACT}"))
    return " || ".join(pieces)


def sql_cell(column: str) -> str:
    return sql_json(f"coalesce({column}, 'null')")


SQL_PAYLOAD = (
    f"""'{{' || chr(10) || '  "name": ' || {sql_cell('name')} || ',' || chr(10) || '  "segment": ' || {sql_cell('segment')}"""
    " || chr(10) || '}'"
)

SQL = {
    "select_columns": "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders",
    "canonical_cells": """
        WITH mixed AS (
            SELECT *, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice * 1e13::DOUBLE WHEN 1 THEN o_totalprice / 1e10::DOUBLE
                          WHEN 2 THEN o_totalprice * 1000 ELSE o_totalprice END AS price,
                   o_orderdate + to_milliseconds(CAST(o_orderkey % 3 * 250 AS BIGINT)) AS moment
            FROM orders)
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'null' END AS status,
               CAST(price AS VARCHAR) AS price,
               CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS even,
               strftime(moment, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(moment) % 1000000 = 0 THEN ''
                   ELSE strftime(moment, '.%f') END AS moment,
               strftime(o_orderdate, '%Y-%m-%d') AS day,
               o_orderpriority AS raw
        FROM mixed""",
    "payload_pretty": f"""
        SELECT doc_id, '{{' || chr(10) || '  "source": ' || {sql_json('source')} || ',' || chr(10) || '  "text": '
               || {sql_json('text')} || ',' || chr(10) || '  "n_chars": "' || n_chars || '"' || chr(10) || '}}' AS payload
        FROM documents""",
    "payload_compact": f"""
        SELECT row_id, '{{"name": ' || {sql_cell('name')} || ', "segment": ' || {sql_cell('segment')}
               || ', "balance": "' || CAST(balance AS VARCHAR) || '"}}' AS payload
        FROM ({MESSY_CUSTOMERS})""",
    "token_estimate": "SELECT conv_id, turn, CAST(greatest(1, len(text) // 4) AS INTEGER) AS tokens FROM conversations",
    "token_budgets": """
        SELECT doc_id, CAST(200 + greatest(50, least(500, (len(text) + len(source)) // 4 * 2)) AS INTEGER) AS budget
        FROM documents""",
    "prompt_text": f"""
        SELECT row_id, {sql_prompt(SQL_PAYLOAD, "'Guess the industry.'", "coalesce(segment, '')", "'Row 1: none'")} AS prompt
        FROM ({MESSY_CUSTOMERS})""",
    "filled_flags": f"SELECT row_id, {FILLED} AS filled FROM ({MESSY_CUSTOMERS})",
    "non_empty_all": f"SELECT * FROM ({MESSY_CUSTOMERS}) WHERE {FILLED}",
    "non_empty_first": f"SELECT * FROM ({MESSY_CUSTOMERS}) WHERE {FILLED} ORDER BY row_id LIMIT 50",
    "non_empty_count": f"SELECT count(*) AS non_empty FROM ({MESSY_CUSTOMERS}) WHERE {FILLED}",
    "align_values": f"""
        SELECT *, CASE WHEN {FILLED} AND balance > 0 THEN 'v' || row_id ELSE '' END AS value FROM ({MESSY_CUSTOMERS})""",
    "remainder_rows": f"""
        SELECT *, 'v' || row_id AS value FROM ({MESSY_CUSTOMERS}) WHERE {FILLED} AND balance > 0
        UNION ALL
        SELECT *, '' AS value FROM ({MESSY_CUSTOMERS}) WHERE NOT ({FILLED} AND balance > 0)""",
    "definition_columns": f"""
        SELECT row_id, coalesce('Shorten. ' || segment, '') AS "Segment - short",
               coalesce('Rate it. ' || segment, '') AS "Rating"
        FROM ({MESSY_CUSTOMERS}) WHERE {FILLED}""",
    "definition_filter": """
        SELECT p_partkey AS def_id,
               concat_ws(' - ', CASE WHEN p_size % 3 <> 0 THEN p_name END, CASE WHEN p_size % 2 <> 0 THEN p_brand END)
                   AS column,
               p_type AS instructions
        FROM part
        WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND (p_size % 3 <> 0 OR p_size % 2 <> 0)""",
}
