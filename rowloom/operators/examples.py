"""Few-shot examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import strip
from rowloom.operators.payload import row_payload
from rowloom.plans.scale import ordered_pieces, salted_join


def example_text(payload: Column, expected: Column, document: Column | None = None) -> Column:
    """One example; without a payload (no such row) only the expected output."""
    shown = F.lit("")
    if document is not None:
        said = strip(F.coalesce(document, F.lit("")))
        shown = F.when(said != "", F.concat(F.lit("Document input: "), said, F.lit("\n"))).otherwise(F.lit(""))
    output = F.concat(F.lit("Expected output: "), strip(expected))
    full = F.concat(F.lit("Example:\nSource data: "), payload, F.lit("\n"), shown, output)
    return F.when(payload.isNull(), output).otherwise(full)


def build_examples(
    examples: DataFrame, rows: DataFrame, columns: Sequence[str], position: str = "row_no"
) -> DataFrame:
    """``examples`` (``def_id``, ``row_no``, ``text`` and maybe ``document``) with ``example``.

    ``rows`` carries its row number, from 1, in ``position``. Many definitions may take their
    example from one row, which the join allows for.
    """
    payloads = rows.select(F.col(position).alias("row_no"), row_payload(rows, columns, indent=2).alias("_payload"))
    joined = salted_join(examples, payloads, "row_no")
    document = F.col("document") if "document" in examples.columns else None
    return joined.withColumn("example", example_text(F.col("_payload"), F.col("text"), document)).drop("_payload")


#: Bytes of a piece of formatted examples.
PIECE_BYTES = 64 << 10


def format_examples(
    examples: DataFrame, definition: str = "def_id", text: str = "text", most_bytes: int = PIECE_BYTES
) -> DataFrame:
    """``(def_id, piece, example)``: all examples of a definition as ``Row n: text``, by row number, in pieces of about ``most_bytes``.

    What fits a prompt is one piece, number 0; a definition with very many examples goes on in further ones.
    """
    item = F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), F.col(text))
    joined = ordered_pieces(examples, [definition], "row_no", item, "\n\n", most_bytes)
    return joined.withColumnRenamed("folded", "example")
