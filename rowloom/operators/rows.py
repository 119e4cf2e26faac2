"""Choosing source columns, and finding the rows that hold something."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import named
from rowloom.functions.text import is_filled
from rowloom.session import written
from rowloom.sources.tables import ROW_ID

# Rows of a preview, its largest size, and the size offered without a table.
PREVIEW_ROWS = 5
PREVIEW_MAX = 50
PREVIEW_WITHOUT_TABLE = 10

#: Up to this many rows one task may merge a sorted limit; beyond it the last id is looked for.
SORTED_LIMIT = 100_000


def parse_column_indices(text: str | None, total: int) -> list[int]:
    """``"0-2,4"`` to ``[0, 1, 2, 4]``: sorted, unique, inside the table; nothing means all."""
    if not text:
        return list(range(total))
    chosen: set[int] = set()
    for part in text.split(","):
        first, dash, last = part.strip().partition("-")
        low = int(first)
        chosen.update(range(max(low, 0), min(int(last) if dash else low, total - 1) + 1))
    return sorted(i for i in chosen if i < total)


def select_sources(
    df: DataFrame, columns: str | Sequence[int] | None = None, row_id: str | None = ROW_ID
) -> DataFrame:
    """Source columns by position: a text of ranges (sorted) or a list (in the order given)."""
    keep = [row_id] if row_id and row_id in df.columns else []
    names = [c for c in df.columns if c not in keep]
    if columns is None or isinstance(columns, str):
        indices = parse_column_indices(columns, len(names))
    else:
        indices = list(dict.fromkeys(i for i in columns if 0 <= i < len(names)))
    return df.select(*[named(c) for c in keep], *[named(names[i]) for i in indices])


def non_empty(df: DataFrame, columns: Sequence[str]) -> Column:
    """True for a row with something in any of ``columns``."""
    known = [c for c in columns if c in df.columns]
    if not known:
        return F.lit(False)
    filled = [is_filled(named(c), df.schema[c].dataType) for c in known]
    out = filled[0]
    for cell in filled[1:]:
        out = out | cell
    return out


def non_empty_rows(
    df: DataFrame, columns: Sequence[str], max_rows: int | None = None, row_id: str = ROW_ID
) -> DataFrame:
    """The rows with something in ``columns``; with ``max_rows`` the first so many in row order.

    A small limit is a sorted limit (each task keeps its best rows). A large one would gather its rows in one task; then the id of the last
    row is looked for among ranges of ids, and the rows are filtered by it. Ids are unique, and of any type that can be ordered.
    """
    kept = df.where(non_empty(df, columns))
    if max_rows is None:
        return kept
    if max_rows <= SORTED_LIMIT:
        return kept.orderBy(row_id).limit(max(max_rows, 0))
    last = kth_smallest(kept.select(named(row_id).alias("key")), max_rows)
    return kept if last is None else kept.where(named(row_id) <= last)


def kth_smallest(keys: DataFrame, k: int) -> Column | None:
    """The k-th of the keys ``(key)`` in order, as a literal; None where there are no more than k.

    Keys are dealt into ranges; the counts of the ranges (a row each) tell in which one the k-th lies, and only that one is sorted.
    """
    ranged = keys.repartitionByRange("key").select("key", F.spark_partition_id().alias("range"))
    ranged = written(ranged, "ranges")
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    before = 0
    for number, count in counts:
        if before + count >= k:
            place = k - before
            # Of one range, the rows up to the wanted one.
            inside = ranged.where(F.col("range") == number).orderBy("key").limit(place)
            last = inside.agg(F.max("key").alias("key")).first()["key"]
            return F.lit(last).cast(keys.schema["key"].dataType)
        before += count
    return None


def last_row_to_process(
    df: DataFrame, columns: Sequence[str], max_rows: int, row_id: str = ROW_ID
) -> int | None:
    """The id of the ``max_rows``-th row with something in ``columns`` (the last one if there are fewer).

    With it a limited run is a plain filter over the table: no join, no shuffle.
    """
    wanted = non_empty_rows(df, columns, max_rows, row_id)
    return wanted.agg(F.max(row_id)).first()[0]


def count_non_empty_rows(df: DataFrame, columns: Sequence[int] | None = None, row_id: str | None = ROW_ID) -> DataFrame:
    """One row ``(non_empty)``; positions outside the table are ignored, no columns count nothing."""
    names = [c for c in df.columns if c != row_id]
    indices = range(len(names)) if columns is None else columns
    chosen = [names[i] for i in indices if 0 <= i < len(names)]
    return df.agg(F.count_if(non_empty(df, chosen)).alias("non_empty"))


def rows_to_process(non_empty_count: int, requested: int | None = None) -> int:
    return non_empty_count if requested is None else min(requested, non_empty_count)


def preview_size(non_empty_count: int | None) -> int:
    """Largest preview on offer: 1 to 50 rows, 10 when no table or columns are chosen."""
    if non_empty_count is None:
        return PREVIEW_WITHOUT_TABLE
    return max(1, min(non_empty_count, PREVIEW_MAX))
