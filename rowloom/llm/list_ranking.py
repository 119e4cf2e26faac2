"""Places in linked lists whose links lie in a table, without walking any list in one task.

In every round each element that draws a higher number than both its neighbours leaves, about a third of all: its
neighbours are linked to each other, and the gap between them grows. The draws are hashes, so no two neighbours leave
together, and a task that runs again decides alike. When no more than ``LOCAL`` elements are left, one task places them. Then the rounds
are undone from the last to the first: an element stands its gap behind the one that stood before it when it left. All
rounds together handle three times the elements; every round is one shuffle on the element, of which each has one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import discard, written

#: So many elements, whatever the size of the table, are placed by one task.
LOCAL = 1 << 14


def places(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """``(id, pos)`` for ``(id, prev, next)``: how many elements stand before it in its list.

    Ids are integers, each has one row, and ``prev`` and ``next`` agree; they are null at the ends. Several lists are
    ranked each by itself. An empty table gives an empty result.
    """
    gap = F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("gap")
    rows, gone = written(links.select("id", "prev", "next", gap), "list"), []
    while rows.count() > local:
        before, turn = rows, F.lit(len(gone))

        def draw(element: str, turn: Column = turn) -> Column:
            return F.when(F.col(element).isNotNull(), F.xxhash64(F.col(element), turn))

        leaves = F.coalesce((draw("id") > draw("prev")) & (draw("id") > draw("next")), F.lit(False))
        left = written(rows.where(leaves), "list-left")
        none = F.lit(None).cast("long")
        stay = rows.where(~leaves).select("*", none.alias("new_prev"), none.alias("new_next"))
        to_next = left.select(
            F.col("next").alias("id"), none.alias("prev"), none.alias("next"), "gap", F.col("prev").alias("new_prev"), none.alias("new_next")
        )
        to_prev = left.select(
            F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), F.lit(0).cast("long").alias("gap"),
            none.alias("new_prev"), F.col("next").alias("new_next"),
        )
        told = stay.unionByName(to_next).unionByName(to_prev).groupBy("id").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"),
            F.coalesce(F.max("new_next"), F.max("next")).alias("next"), F.sum("gap").alias("gap"),
        )
        rows = written(told, "list")
        gone.append(left)
        discard(before)
    found = written(rows.repartition(1).mapInArrow(_place, "id long, pos long"), "places")
    discard(rows)
    for left in reversed(gone):
        before = found
        back = left.select("id", "prev", "gap").join(found.select(F.col("id").alias("prev"), "pos"), "prev")
        found = written(found.unionByName(back.select("id", (F.col("pos") + F.col("gap")).alias("pos"))), "places")
        discard(before, left)
    return found


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles the steps back until all have arrived at the head of their list."""
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    held = pa.Table.from_batches(found)
    order = np.argsort(held["id"].to_numpy())
    ids, pos = held["id"].to_numpy()[order], held["gap"].to_numpy()[order]
    is_head = held["prev"].is_null().to_numpy()[order]
    prev = held["prev"].fill_null(0).to_numpy()[order]
    # The head is its own predecessor, at a distance of 0.
    back = np.where(is_head, np.arange(len(ids)), np.searchsorted(ids, prev))
    while not is_head[back].all():
        pos, back = pos + pos[back], back[back]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos)], names=["id", "pos"])
