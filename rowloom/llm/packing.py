"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are placed from long to short, one band of lengths after the other,
and every round of a band does the same. Pieces and the gaps of open sequences are range-sorted by size. Each range
is swept from large to small by a task of its own: a piece takes the smallest gap that holds it (its successor in the sorted
order), pieces of higher rank first, and the gap goes on with what is left of it. Pieces that find nothing in their range sweep on over the
ranges of larger gaps: the gaps that ranges leave over form a stack, each range takes off it as many as its pieces
want, and ranks tell which piece meets which gap. Gaps are updated, and the round is repeated with what is left; when few
pieces meet a gap any more, the others open sequences, each range for its own, and the band is done.

A task holds about ``SORT_ROWS`` rows, also of a length that a third of all rows has, since rows of one length are sorted by
their number. The driver sees a number per length and two numbers per range.

Defined results: a null text is an empty one and gives one piece that holds the end id alone. Rows with equal
doc_id are documents of their own. Only documents longer than ``capacity`` are cut; the first piece takes
the remainder. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import columns, tidy
from rowloom.llm.tokens import worker_encoder
from rowloom.session import written

CAPACITY = 1024
END_ID = 2
#: Rows per task when pieces and gaps are sorted.
SORT_ROWS = 100_000

_GAP, _PIECE, _PLACED = 0, 1, 2
_SWEPT = "kind int, size long, id long, sequence long, part int, at long, slots long"


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, ``doc_id`` under the name of ``key``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.concatenate([encoder.array(value.as_py() or ""), end])
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                if len(ids) <= capacity:
                    bounds = [0, len(ids)]
                for number, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    chosen = columns(docs, **{key: key, "_text": text})
    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(tidy(cut), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (any table with a ``length`` from 1 to ``capacity``).

    A sequence is named after the piece that opened it.
    """
    found = written(found.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    sizes = dict(found.groupBy("length").count().collect())  # at most ``capacity`` rows
    if any(not 1 <= size <= capacity for size in sizes):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    whole = found.where(F.col("length") == capacity).select("_uid", F.col("_uid").alias("sequence_id"))
    placed = reduce(DataFrame.unionByName, _place(found, sizes, capacity), whole)
    joined = found.join(placed, "_uid")
    # Pieces are at least one token long, so a sequence holds at most ``capacity`` of them.
    before = Window.partitionBy("sequence_id").orderBy("_uid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return joined.withColumn("offset", offset).select(
        *[c for c in found.columns if c != "_uid"], "sequence_id", "offset"
    )


def _place(found: DataFrame, sizes: dict[int, int], capacity: int) -> list[DataFrame]:
    """Tables of ``(_uid, sequence_id)`` that together hold all pieces shorter than ``capacity`` once."""
    pieces_left = {size: n for size, n in sizes.items() if size < capacity}
    gaps, room_left, placed = None, {}, []
    while pieces_left:
        high = max(pieces_left)
        low = _low(pieces_left, room_left, capacity)
        band = {size: n for size, n in pieces_left.items() if size > low}
        waiting = found.where((F.col("length") > low) & (F.col("length") <= high)).select(
            F.lit(_PIECE).alias("kind"), F.col("length").cast("long").alias("size"), F.col("_uid").alias("id")
        )
        n_waiting, few_met = sum(band.values()), False
        while n_waiting:
            n_gaps = sum(n for room, n in room_left.items() if room > low)
            tasks = -(-(n_waiting + n_gaps) // SORT_ROWS)
            # Where gaps may lie in another range, pieces first look there before they open sequences.
            opens = tasks == 1 or not n_gaps or few_met
            active = waiting if gaps is None else waiting.unionByName(gaps.where(F.col("size") > low))
            # By size from large to small, a gap before the pieces that just fill it. Never more tasks than the rows need,
            # also where a session deals keys to more partitions.
            order = [F.col("size").desc(), F.col("kind").asc(), F.col("id").asc()]
            ranges = active.repartitionByRange(tasks, *order).coalesce(tasks).sortWithinPartitions(*order)
            swept = ranges.mapInArrow(_sweep_task(capacity, high, opens), _SWEPT)
            if gaps is not None:
                parked = gaps.where(F.col("size") <= low).select(F.lit(_GAP).alias("kind"), "size", "id")
                swept = swept.unionByName(parked, allowMissingColumns=True)
            swept = written(swept, "swept")
            placed.append(swept.where(F.col("kind") == _PLACED).select(F.col("id").alias("_uid"), F.col("sequence").alias("sequence_id")))
            waiting = swept.where(F.col("kind") == _PIECE)
            gaps = swept.where(F.col("kind") == _GAP)
            ends = {} if opens else _summaries(swept)
            n_waiting, n_met = sum(p for p, _ in ends.values()), 0
            if n_waiting and any(slots for _, slots in ends.values()):
                depths, n_met = depths_of(ends)
                if n_met:
                    met, waiting, gaps = _meet(waiting, gaps, depths)
                    placed.append(met)
            few_met = n_met < n_waiting / 8
            n_waiting -= n_met
            waiting, gaps = waiting.select("kind", "size", "id"), gaps.select("kind", "size", "id")
            # Rooms are whole numbers below ``capacity``.
            room_left = dict(gaps.groupBy("size").count().collect())
        pieces_left = {size: n for size, n in pieces_left.items() if size <= low}
    return placed


def _low(pieces_left: dict[int, int], room_left: dict[int, int], capacity: int) -> int:
    """The band of pieces above it goes next: from half of the longest on, or all that one task sorts."""
    if sum(pieces_left.values()) + sum(room_left.values()) <= SORT_ROWS:
        return 0
    return min(max(pieces_left) - 1, capacity // 2 if max(pieces_left) > capacity // 2 else max(pieces_left) // 2)


def sweep(
    pieces_by_size: dict[int, np.ndarray], gaps_by_room: dict[int, np.ndarray], capacity: int, opens: bool
) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Best fit from large to small over arrays of ids: each piece takes the smallest gap that holds it.

    What is left of a gap is a gap again at once; a gap takes as many pieces of one size as it holds, and of pieces that want the same
    gap those of higher rank get it. With ``opens`` pieces that no gap holds open sequences, named after the first of
    them. Gives the placed ``(pieces, sequences)``, and the pieces and gaps that are left.
    """
    free: dict[int, list[np.ndarray]] = {room: [ids] for room, ids in gaps_by_room.items()}
    count = np.zeros(capacity + 1, np.int64)
    for room, ids in gaps_by_room.items():
        count[room] = len(ids)
    placed, left = [], {}

    def put(room: int, ids: np.ndarray) -> None:
        if room and len(ids):
            free.setdefault(room, []).append(ids)
            count[room] += len(ids)

    def take(room: int, n: int) -> np.ndarray:
        held = np.concatenate(free.pop(room)) if len(free[room]) > 1 else free.pop(room)[0]
        if n < len(held):
            free[room] = [held[n:]]
        count[room] -= n
        return held[:n]

    for size in sorted(pieces_by_size, reverse=True):
        ids = pieces_by_size[size]
        while len(ids):
            fits = np.flatnonzero(count[size:])
            if len(fits):
                room = int(fits[0]) + size
                each = room // size
                sequences = take(room, min(int(count[room]), -(-len(ids) // each)))
            elif opens:
                room, each = capacity, capacity // size
                sequences = ids[::each]
            else:
                left[size] = ids
                break
            n = min(len(ids), len(sequences) * each)
            placed.append((ids[:n], np.repeat(sequences, each)[:n]))
            full, rest = divmod(n, each)
            put(room - each * size, sequences[:full])
            put(room - rest * size, sequences[full : full + 1] if rest else sequences[:0])
            ids = ids[n:]
    return placed, left, {room: np.concatenate(parts) for room, parts in free.items()}


def _sweep_task(capacity: int, high: int, opens: bool):
    """The sweep over one range of the sorted order; its leftovers are numbered for the sweep over all ranges."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        # ``SORT_ROWS`` rows, more or less.
        kind, size, ids = (np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("kind", "size", "id"))

        def by_size(which: int) -> dict[int, np.ndarray]:
            own = np.flatnonzero(kind == which)
            starts = np.flatnonzero(np.diff(size[own], prepend=-1))
            return {int(size[own[s]]): part for s, part in zip(starts, np.split(ids[own], starts[1:]))}

        placed, left, free = sweep(by_size(_PIECE), by_size(_GAP), capacity, opens)
        task, smallest = TaskContext.get().partitionId(), int(size.min())

        def rows(what: int, sizes: np.ndarray, own: np.ndarray, sequence=None, at=None, slots=None) -> pa.RecordBatch:
            none = pa.nulls(len(own), pa.int64())
            arrays = [
                pa.array(np.full(len(own), what, np.int32)), pa.array(sizes.astype(np.int64)), pa.array(own),
                none if sequence is None else pa.array(sequence), pa.array(np.full(len(own), task, np.int32)),
                none if at is None else pa.array(at), none if slots is None else pa.array(slots),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["kind", "size", "id", "sequence", "part", "at", "slots"])

        for own, sequences in placed:
            yield rows(_PLACED, np.zeros(len(own)), own, sequences)
        for what, found in ((_PIECE, left), (_GAP, free)):
            order = sorted(found, reverse=True)
            if not order:
                continue
            own = np.concatenate([found[s] for s in order])
            sizes = np.repeat(order, [len(found[s]) for s in order])
            if what == _PIECE:
                yield rows(what, sizes, own, at=np.arange(len(own)))
            else:
                # A gap at least as large as all of this range holds any piece of the ranges behind it, a wide one several.
                slots = np.where(sizes >= smallest, np.maximum(1, sizes // high), 0)
                yield rows(what, sizes, own, at=np.cumsum(slots) - slots, slots=slots)

    return apply


def _summaries(swept: DataFrame) -> dict[int, tuple[int, int]]:
    """Pieces that wait and slots that are offered, by range: one row for each ``SORT_ROWS`` rows."""
    waiting = F.count(F.when(F.col("kind") == _PIECE, 1)).alias("waiting")
    found = swept.where(F.col("part").isNotNull()).groupBy("part").agg(waiting, F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"))
    return {part: (n, slots) for part, n, slots in found.collect()}


def depths_of(ends: dict[int, tuple[int, int]]) -> tuple[dict[int, int], int]:
    """How many slots of the ranges before are free at each range, and how many pieces take one.

    The sweep over all ranges is a stack: a range first takes slots off it for its pieces, then puts its own on it.
    """
    depths, depth, met = {}, 0, 0
    for part in sorted(ends):
        waiting, slots = ends[part]
        depths[part] = depth
        met += min(waiting, depth)
        depth = max(0, depth - waiting) + slots
    return depths, met


def _meet(waiting: DataFrame, gaps: DataFrame, depths: dict[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sweep over all ranges: pieces take the slot their range finds on top of the stack, as deep as their rank.

    Slots and pieces of one level of the stack alternate in the order of ranges, so a piece belongs to the slot before it. Gives the
    placed pieces, those that go on waiting, and all gaps with the room that is left.
    """
    spark = waiting.sparkSession
    known = F.broadcast(spark.createDataFrame(list(depths.items()), "part int, depth long"))
    n_waiting = waiting.groupBy("part").agg(F.count("*").alias("n"))
    base = F.greatest(F.lit(0), F.col("depth") - F.coalesce("n", F.lit(0)))
    slots = gaps.where("slots > 0").join(known, "part").join(F.broadcast(n_waiting), "part", "left").select(
        F.lit(1).alias("is_slot"), "part", F.col("id"), F.col("size"),
        F.explode(F.sequence(base + F.col("at"), base + F.col("at") + F.col("slots") - 1)).alias("level"),
    )
    deep = waiting.join(known, "part").withColumn("level", F.col("depth") - 1 - F.col("at"))
    taking = deep.where("level >= 0").select(F.lit(0).alias("is_slot"), "part", "id", "size", "level")
    in_level = Window.partitionBy("level").orderBy("part", "is_slot")
    before = F.lag("id").over(in_level)
    met = slots.unionByName(taking).withColumn("sequence", before).where("is_slot = 0")
    met = written(met.select("id", "size", "sequence"), "met")
    used = gaps.select(F.col("id"), "size").unionByName(met.select(F.col("sequence").alias("id"), (-F.col("size")).alias("size")))
    left = used.groupBy("id").agg(F.sum("size").alias("size")).where("size > 0").select(F.lit(_GAP).alias("kind"), "size", "id")
    placed = met.select(F.col("id").alias("_uid"), F.col("sequence").alias("sequence_id"))
    return placed, deep.where("level < 0"), written(left, "gaps")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Tokenises, cuts and packs: a row per piece with its place."""
    return pack(pieces(docs, tokenizer, capacity, end_id, key, text), capacity)
