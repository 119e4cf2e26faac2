"""Header rows that sit in the data as leading rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named, named
from rowloom.functions.text import canonical_string
from rowloom.sources.tables import ROW_ID, typed

# Rows needed for a judgement, columns looked at, and the three verdicts.
MIN_ROWS = 5
COLUMNS_CHECKED = 5
TOO_SHORT = (1, 0.5)
ONE_ROW = (1, 0.8)
TWO_ROWS = (2, 0.7)


def detect_header_rows(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """One row ``(header_rows, confidence)``.

    Two header rows when no filled cell among the first columns of the second row is a number
    (an entirely empty second row counts as such). Only the five leading rows leave the scan.
    """
    cells = [c for c in df.columns if c != row_id]
    texts = [
        F.when(named(c).isNull(), F.lit("")).otherwise(canonical_string(named(c), df.schema[c].dataType))
        for c in cells[:COLUMNS_CHECKED]
    ]
    leading = df.orderBy(row_id).limit(MIN_ROWS).select(F.col(row_id).alias("_at"), F.array(*texts).alias("_cells"))
    rows = leading.agg(F.array_sort(F.collect_list(F.struct("_at", "_cells"))).alias("rows"))
    second = F.get("rows", F.lit(1))["_cells"]
    no_number = F.forall(second, lambda x: (x == "") | ~F.regexp_replace(x, "[.-]", "").rlike(r"^\p{Nd}+$"))
    looks_like_header = (F.size(second) > 0) & no_number

    def verdict(position: int):
        return (
            F.when(F.size("rows") < MIN_ROWS, F.lit(TOO_SHORT[position]))
            .when(looks_like_header, F.lit(TWO_ROWS[position]))
            .otherwise(F.lit(ONE_ROW[position]))
        )

    return rows.select(verdict(0).alias("header_rows"), verdict(1).alias("confidence"))


def column_letter(index: int) -> str:
    """A, B, … Z, AA, AB, … as in spreadsheets."""
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return letters


def column_name(index: int, parts: list[str]) -> str:
    """``[A] part - part`` from the header cells of one column, ``[A] Column 1`` without any."""
    filled = [p for p in parts if p]
    return f"[{column_letter(index)}] " + (" - ".join(filled) if filled else f"Column {index + 1}")


def promote_headers(
    df: DataFrame, header_rows: int | None = None, row_id: str = ROW_ID, infer: bool = False
) -> DataFrame:
    """Folds the leading rows into the column names and keeps the other rows.

    ``header_rows=None`` detects the number; 0 returns the table as it is. Only the header
    rows come to the driver. With ``infer=True`` columns get their types from the remaining rows.
    """
    if header_rows is None:
        header_rows = int(detect_header_rows(df, row_id).first()["header_rows"])
    if header_rows <= 0:
        return df
    # The ids first: then the header rows are a filter that the file reader can use.
    last = df.select(row_id).orderBy(row_id).limit(header_rows).agg(F.max(row_id)).first()[0]
    if last is None:
        return df
    leading = df.where(F.col(row_id) <= F.lit(last)).orderBy(row_id).collect()
    cells = [c for c in df.columns if c != row_id]
    names = [
        column_name(i, ["" if row[c] is None else str(row[c]) for row in leading]) for i, c in enumerate(cells)
    ]
    data = df.where(F.col(row_id) > F.lit(last)).select(F.col(row_id), *all_named(cells))
    data = data.toDF(row_id, *names)
    if infer:
        data = typed(data, keep=(row_id,))
    return data
