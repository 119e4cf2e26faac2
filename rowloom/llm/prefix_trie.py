"""The trie of conversation prefixes: who shares which first turns, and what sharing them saves.

Turns are numbered by a range sort and running sums, so a conversation of any length is spread over tasks. The first ``d`` turns of a
conversation are named by ``d`` and sums of 32-bit pieces of 128 bits of hashes of place, role and text, which are running sums as
well; equal names of rows are one node. From there on a node is a row of its own with an integer id.

Sums over subtrees come from an Euler tour. Each node has an arc that enters it and one that leaves it; children and neighbours among
siblings give each arc the one before and the one behind it; ``list_ranking`` places all arcs; and a subtree is the difference of
running sums along the tour between its two arcs. No subtree, and no list of children, is ever gathered.

Ids of members that end at a node are joined to text in range-sorted chunks by many tasks; the only serial work per node is SHA-256 over its
chunks, which one task streams.

Defined results: a null role or text is empty. Turns are ordered by ``turn``, null first, then role, then text; repeated rows are turns
of their own. Rows without ``conv_id`` belong to no conversation and are left out. A conversation without turns after rebuilding ends at the
root. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import columns, words_of
from rowloom.llm.list_ranking import places
from rowloom.plans.scale import running_sums
from rowloom.session import discard, written

#: Conversations of a block share first turns with the first of the block, up to ``SHARED - 1`` of them.
BLOCK, SHARED = 20, 4
#: Places of the tour, and conversations, a task sums up at once, as a power of two.
TOUR_BITS = 12
#: SHA-256 of nothing.
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv, pos, a, b, words)`` of every turn: its place from 1, 128 bits that stand for role and text, words of the text."""
    wanted = columns(conversations, conv="conv_id", turn="turn", role="role", text="text").where(F.col("conv").isNotNull())
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = wanted.select(F.col("conv").cast("long").alias("conv"), "turn", *filled, F.monotonically_increasing_id().alias("row"))
    # The row's own number comes last: rows that agree in all else are spread as well.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    named = in_order.select(
        "conv", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(7), "role", "text").alias("b"), F.size(words_of(F.col("text"))).cast("long").alias("words"),
    )
    return running_sums(written(named, "turns"), ["conv"], "at", {"pos": F.lit(1).cast("long")}).drop("at")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("long")


def block_start(conv: Column) -> Column:
    return conv - conv % BLOCK


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv, depth, a, b, words)``: the block's first turns, then the conversation's own behind as many.

    A conversation meets at most ``SHARED - 1`` turns, a block's start at most two blocks of conversations.
    """
    firsts = turns.where((F.col("pos") < SHARED) & (F.col("conv") == block_start(F.col("conv"))))
    firsts = firsts.withColumnRenamed("conv", "start")
    wanted = convs.select("conv", block_start(F.col("conv")).alias("start"))
    copied = wanted.join(firsts, "start").where(F.col("pos") <= shared_turns(F.col("conv"))).drop("start")
    own = turns.where(F.col("pos") > shared_turns(F.col("conv")))
    both = written(copied.unionByName(own), "rebuilt")
    # Where the block's first conversation is shorter, places are missing between the two parts.
    return running_sums(both, ["conv"], "pos", {"depth": F.lit(1).cast("long")}, levels=2).drop("pos")


def _names(depth: Column, sums: list[Column], one: str, other: str) -> list[Column]:
    return [F.xxhash64(depth, *sums).alias(one), F.xxhash64(F.lit(7), *sums[::-1], depth).alias(other)]


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, words, k1, k2, p1, p2)``: the names of the first ``depth`` turns and of one fewer."""
    drawn = [F.xxhash64("depth", "a", "b"), F.xxhash64(F.lit(7), "b", "a", "depth")]
    pieces = [piece for d in drawn for piece in (F.shiftrightunsigned(d, 32), d.bitwiseAND(F.lit((1 << 32) - 1)))]
    split = turns.select("conv", "depth", "words", *[p.alias(f"m{i}") for i, p in enumerate(pieces)])
    summed = running_sums(split, ["conv"], "depth", {f"s{i}": F.col(f"m{i}") for i in range(4)}, levels=2)
    sums = [F.col(f"s{i}") for i in range(4)]
    fewer = [F.col(f"s{i}") - F.col(f"m{i}") for i in range(4)]
    return summed.select(
        "conv", "depth", "words", *_names(F.col("depth"), sums, "k1", "k2"), *_names(F.col("depth") - 1, fewer, "p1", "p2")
    )


def _root() -> list[Column]:
    zero = F.lit(0).cast("long")
    return _names(zero, [zero] * 4, "k1", "k2")


def tour_links(nodes: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The arcs ``(id, prev, next)`` of the tour, 2v into node v and 2v + 1 out of it, and ``(v, n_children)`` of inner nodes.

    ``nodes`` has a row per node ``v``, ``parents`` ``(v, p)`` for all but roots. Siblings are visited by their ids.
    """
    ends = parents.groupBy("p").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("n_children"))
    placed = written(running_sums(parents.select("v", "p"), ["p"], "v", {"place": F.lit(1).cast("long")}), "siblings")
    none = F.lit(None).cast("long")

    def seen(shift: int, role: str) -> DataFrame:
        found = [(F.col("v") if r == role else none).alias(r) for r in ("me", "before", "behind")]
        return placed.select("p", (F.col("place") + shift).alias("place"), *found)

    near = seen(0, "me").unionByName(seen(1, "before")).unionByName(seen(-1, "behind")).groupBy("p", "place").agg(
        *[F.max(c).alias(c) for c in ("me", "before", "behind")]
    )
    known = nodes.select("v").join(near.where("me IS NOT NULL").select(F.col("me").alias("v"), "p", "before", "behind"), "v", "left")
    known = known.join(ends.withColumnRenamed("p", "v"), "v", "left")
    into, out = F.col("v") * 2, F.col("v") * 2 + 1
    arcs = known.select(
        F.explode(
            F.array(
                F.struct(
                    into.alias("id"), F.coalesce(F.col("before") * 2 + 1, F.col("p") * 2).alias("prev"),
                    F.coalesce(F.col("first") * 2, out).alias("next"),
                ),
                F.struct(
                    out.alias("id"), F.coalesce(F.col("last") * 2 + 1, into).alias("prev"),
                    F.coalesce(F.col("behind") * 2, F.col("p") * 2 + 1).alias("next"),
                ),
            )
        ).alias("arc")
    ).select("arc.*")
    return arcs, ends.select(F.col("p").alias("v"), "n_children")


def subtree_sums(nodes: DataFrame, arcs: DataFrame, values: list[str]) -> DataFrame:
    """``v`` and, for each of ``values`` of ``nodes``, its sum over the subtree of ``v``, the node included."""
    found = places(arcs).select(F.shiftright("id", 1).alias("v"), (F.col("id") % 2 == 1).alias("out"), "pos")
    tour = written(found.join(nodes.select("v", *values), "v"), "tour")
    at = {f"sum_{c}": F.when(~F.col("out"), F.col(c)).otherwise(0).cast("long") for c in values}
    summed = running_sums(tour, [], "pos", at, span_bits=TOUR_BITS)
    # Up to the arc out of a node, less what came before the arc into it.
    inside = [
        F.sum(F.when(F.col("out"), F.col(f"sum_{c}")).otherwise(F.col(c) - F.col(f"sum_{c}"))).alias(c) for c in values
    ]
    return summed.groupBy("v").agg(*inside)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow each other in a batch become one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, conv = (batch.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        ends = np.r_[starts[1:], len(conv)]
        texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[starts]), pa.array(k2[starts]), pa.array(conv[starts]), pa.array(texts, pa.string())],
            names=["k1", "k2", "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of one node, which follow each other, joined by commas."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("digest", pa.string())])
    node, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
            if (k1, k2) == node:
                state.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, state.hexdigest()))
            node, state = (k1, k2), hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*node, state.hexdigest())))], schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(k1, k2, digest)`` for ``(k1, k2, conv)``: SHA-256 of the ids of each node in ascending order, joined by commas."""
    in_order = written(ends, "ends").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    chunks = written(in_order.mapInArrow(_joined, "k1 long, k2 long, first long, ids string"), "end-ids")
    by_node = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return by_node.mapInArrow(_digests, "k1 long, k2 long, digest string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: its smallest member, depth, parent, members, children, leaves and savings of its subtree, and a digest
    of the members that end there.

    ``saved_tokens`` adds up, over the subtree, the words of a node's last turn times its members but one.
    """
    turns = written(numbered_turns(conversations), "numbered")
    convs = written(turns.groupBy("conv").agg(F.count("*").alias("n")), "convs")
    rows = written(prefixes(written(rebuilt(turns, convs), "deep")), "prefixes")

    shared = rows.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *_root(), "conv", zero.alias("depth"), "n_convs", zero.alias("words"), none.alias("p1"), none.alias("p2")
    )
    nodes = written(shared.unionByName(top).withColumn("v", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("v").alias("p"), F.col("conv").alias("parent_conv_id"))
    # Both sides are written tables, so Spark can split a parent that very many nodes share.
    parents = written(nodes.join(above, ["p1", "p2"]).select("v", "p", "parent_conv_id"), "parents")
    arcs, inner = tour_links(nodes, parents)
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    is_leaf = F.col("n_children").isNull().cast("long").alias("n_leaves")
    valued = written(nodes.join(inner, "v", "left").select("*", is_leaf, saved), "valued")
    sums = subtree_sums(valued, arcs, ["n_leaves", "saved_tokens"])

    last = rows.groupBy("conv").agg(F.max_by("k1", "depth").alias("k1"), F.max_by("k2", "depth").alias("k2"))
    # A conversation without turns ends at the root.
    ends = convs.select("conv").join(last, "conv", "left").select(
        *[F.coalesce(F.col(k), r).alias(k) for k, r in zip(("k1", "k2"), _root())], "conv"
    )
    shown = valued.drop("n_leaves", "saved_tokens").join(sums, "v").join(parents.drop("p"), "v", "left")
    return shown.join(end_digests(ends), ["k1", "k2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(_EMPTY)).alias("ends_sha256"),
    )
