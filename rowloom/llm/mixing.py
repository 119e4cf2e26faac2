"""Mixing sources to target weights by hierarchical budgets.

Weights travel down a tree (domain, language, source): the token budget is split among children by weight. A leaf can
give its own tokens at most ``epochs`` times. What a leaf cannot give is a shortage, which goes to its siblings
first, and only what they cannot take goes up, to the siblings of their parent. Each leaf then gives its
budget as a prefix of its documents in an order seeded per epoch: every epoch is a full pass in an order of its
own, and the last one stops where the budget is reached.

The tree has a row per leaf, not per document, so budgets are computed on the driver over at most
``MAX_LEAVES`` leaves. Prefixes are found without sorting a leaf: token sums per leaf, epoch and hash bucket give the bucket
in which the budget ends, and only that bucket is ordered.

Defined results: a null or empty text has no tokens and is taken with its turn; null levels form a branch
named ``''``; without a weight a branch gets ``default_weight``. Repeated rows are documents of their own. An
empty table gives an empty result. All columns of the input are returned, with ``_epoch`` (from 0) added
or, where the input has one, replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.names import all_named
from rowloom.llm.common import exact, words_of
from rowloom.session import written

MAX_LEAVES = 200_000
#: Hash buckets per leaf and epoch; the bucket where a budget ends is the only one that is sorted.
BUCKETS = 4096


def budgets(
    tokens: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], total: int, epochs: int = 2,
    default_weight: float = 1.0,
) -> dict[tuple[str, ...], int]:
    """The budget of each leaf, in whole tokens; ``tokens`` maps a leaf's path to what it holds once.

    ``weights`` maps any path of the tree (inner nodes too) to its weight among its siblings.
    """
    if len(tokens) > MAX_LEAVES:
        raise ValueError(f"{len(tokens)} leaves; a tree may have {MAX_LEAVES}")
    room: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set] = {}
    for leaf, held in tokens.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] = room.get(leaf[:depth], 0) + held * epochs
            if depth:
                children.setdefault(leaf[: depth - 1], set()).add(leaf[:depth])
    out: dict[tuple[str, ...], int] = {}

    def give(node: tuple[str, ...], amount: int) -> None:
        below = sorted(children.get(node, ()))
        if not below:
            out[node] = amount
            return
        for child, part in zip(below, share(amount, [(weights.get(c, default_weight), room[c]) for c in below])):
            give(child, part)

    if tokens:
        # A node never gets more than all below it can give, so shortages are settled among siblings
        # before anything is passed to the ancestors' siblings.
        give((), min(total, room[()]))
    return out


def share(amount: int, parts: Sequence[tuple[float, int]]) -> list[int]:
    """Splits ``amount`` by weight among parts of ``(weight, room)``; what one cannot take goes to the others."""
    given = [0] * len(parts)
    open_parts = [i for i, (weight, room) in enumerate(parts) if weight > 0 and room > 0]
    left = min(amount, sum(parts[i][1] for i in open_parts))
    while left > 0 and open_parts:
        whole = sum(parts[i][0] for i in open_parts)
        full = [i for i in open_parts if left * parts[i][0] / whole >= parts[i][1] - given[i]]
        if full:
            for i in full:
                left -= parts[i][1] - given[i]
                given[i] = parts[i][1]
            open_parts = [i for i in open_parts if i not in full]
            continue
        exact_parts = {i: left * parts[i][0] / whole for i in open_parts}
        floors = {i: int(exact_parts[i]) for i in open_parts}
        # Largest remainders first; ties by position.
        spare = left - sum(floors.values())
        order = sorted(open_parts, key=lambda i: (floors[i] - exact_parts[i], i))
        for place, i in enumerate(order):
            given[i] += min(floors[i] + (place < spare), parts[i][1] - given[i])
        break
    return given


def word_tokens(text: Column) -> Column:
    """The default measure of a document: its words."""
    return F.size(words_of(text)).cast("long")


def mix(
    docs: DataFrame, levels: Sequence[Column], weights: Mapping[tuple[str, ...], float], total: int | float,
    epochs: int = 2, seed: int = 1, key: str = "doc_id", text: str = "text", tokens: Column | None = None,
    default_weight: float = 1.0,
) -> DataFrame:
    """The selected rows of ``docs``, once per epoch they are taken in.

    ``total`` is a number of tokens, or (as a float) a share of all tokens there are.
    """
    spark = docs.sparkSession
    count = word_tokens(exact(docs, text)) if tokens is None else tokens
    names = [f"_level{i}" for i in range(len(levels))]
    # The row's own hash tells rows of one key apart, so that ties are decided by content.
    row = F.xxhash64(exact(docs, key), exact(docs, text))
    # The columns of the table stay together in one, so none of them can clash with those made here.
    sized = docs.select(
        F.struct(*all_named(docs.columns)).alias("doc"), exact(docs, key).alias("_key"), row.alias("_row"),
        *[F.coalesce(level.cast("string"), F.lit("")).alias(n) for n, level in zip(names, levels)],
        F.coalesce(count, F.lit(0)).cast("long").alias("_tokens"),
    )
    slim = written(sized.select("_key", *names, "_tokens", "_row"), "mixing-sizes")
    leaves = slim.groupBy(*names).agg(F.sum("_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    held = {tuple(r[n] for n in names): r["n"] for r in leaves}
    amount = int(total * sum(held.values())) if isinstance(total, float) else total
    plan = budgets(held, weights, amount, epochs, default_weight)
    # One row per leaf and epoch: how many tokens the leaf gives in it; null when it gives all.
    asked = [
        (*leaf, epoch, None if budget >= held[leaf] * (epoch + 1) else budget - held[leaf] * epoch)
        for leaf, budget in plan.items() for epoch in range(epochs)
        if budget > held[leaf] * epoch
    ]
    schema = ", ".join(f"`{n}` string" for n in names) + ", _epoch int, _budget long"
    asked_rows = spark.createDataFrame(asked, schema)
    place = F.xxhash64(F.lit(seed), "_epoch", "_key", "_row")
    turns = slim.join(F.broadcast(asked_rows), names).withColumn("_place", place).withColumn(
        "_bucket", F.shiftright("_place", 64 - BUCKETS.bit_length() + 1)
    )
    whole = turns.where(F.col("_budget").isNull())
    partial = turns.where(F.col("_budget").isNotNull())
    group = [*names, "_epoch"]
    sums = partial.groupBy(*group, "_bucket").agg(F.sum("_tokens").alias("_in"), F.first("_budget").alias("_budget"))
    # At most ``BUCKETS`` rows per leaf and epoch.
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    started = written(started.where(F.col("_before") < F.col("_budget")).select(*group, "_bucket", "_before", "_in"), "mixing-buckets")
    reached = partial.join(started, [*group, "_bucket"])
    inside = reached.where(F.col("_before") + F.col("_in") <= F.col("_budget"))
    last = reached.where(F.col("_before") + F.col("_in") > F.col("_budget"))
    so_far = Window.partitionBy(*group).orderBy("_place", "_key", "_row").rowsBetween(Window.unboundedPreceding, -1)
    # A document starts while the budget is not used up: the prefix ends with the one that reaches it.
    ending = last.withColumn("_used", F.col("_before") + F.coalesce(F.sum("_tokens").over(so_far), F.lit(0))).where(
        F.col("_used") < F.col("_budget")
    )
    chosen = [x.select("_key", "_row", "_epoch") for x in (whole, inside, ending)]
    taken = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    # Rows that equal each other in key and text share all their places; one of them stands for all.
    taken = taken.distinct().groupBy("_key", "_row").agg(F.collect_set("_epoch").alias("_epochs"))
    rows = sized.select("doc", F.col("_key").alias("_own"), "_row")
    joined = rows.join(taken.withColumnRenamed("_row", "_row2"), F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_row2")))
    kept = [c for c in docs.columns if c != "_epoch"]
    return joined.select(*[F.col("doc").getField(c).alias(c) for c in kept], F.explode("_epochs").alias("_epoch"))
