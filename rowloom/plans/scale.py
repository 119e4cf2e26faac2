"""Shuffle plans that hold when one key owns a large share of all rows.

Everything ordered here relies on one fact: the order column holds integers that are
unique within a group, so a stretch of ``2**SPAN_BITS`` consecutive values holds at most
that many rows. Cutting a group into such stretches bounds every task, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.names import all_named

#: Rows per stretch: 2**20. Three levels cover 2**60 order values.
SPAN_BITS = 20
_LEVELS = 3

#: Tasks over which rows without a key are spread.
NULL_PIECES = 1024
#: Rows of one hot key that go to one task.
ROWS_PER_SALT = 1_000_000


def spread_small(df: DataFrame) -> DataFrame:
    """Spreads a small input over all cores before a stage that computes much per row.

    A small file is one split, so a model would run in one task. Inputs that fill the cluster
    by themselves (by the optimizer's estimate, or by their number of files) are left as they
    are: no shuffle at scale.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsc.sc().conf().getSizeAsBytes("spark.sql.files.maxPartitionBytes", "128m")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split and len(df.inputFiles()) < cores else df


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    sums: dict[str, Column],
    span_bits: int = SPAN_BITS,
    levels: int = _LEVELS,
) -> DataFrame:
    """Adds running sums (current row included) along ``order`` within ``group``.

    A plain window would put a whole group into one task. Here each stretch of ``order``
    is one window group, and the totals of the stretches before it are added. The totals are
    summed the same way one level up, so no window group at any level exceeds
    ``2**span_bits`` rows for order values below ``2**(span_bits * levels)``.

    The sums must be of integer or decimal type: a floating sum depends on its order. ``order`` is
    never null.
    """
    names = list(sums)
    values = df.select("*", *[value.alias(f"_v_{name}") for name, value in sums.items()])
    out = _running(values, list(group), order, names, span_bits, levels)
    return out.drop(*[f"_v_{name}" for name in names])


def _running(df: DataFrame, group: list[str], order: str, names: list[str], bits: int, levels: int) -> DataFrame:
    first = F.col(order).asc_nulls_first()
    if levels <= 1:
        window = Window.partitionBy(*group).orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(f"_v_{n}").over(window).alias(n) for n in names])

    span = f"_span{levels}"
    spanned = df.withColumn(span, F.shiftright(F.col(order).cast("long"), bits))
    totals = spanned.groupBy(*group, span).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
    upper = _running(totals, group, span, names, bits, levels - 1)
    # What the stretches before add up to enters each stretch as one more row, in front of the others:
    # no join, and one shuffle of the rows.
    carry = upper.select(*group, span, *[(F.col(n) - F.col(f"_v_{n}")).alias(f"_v_{n}") for n in names])
    carry = carry.withColumn("_carry", F.lit(True))
    rows = spanned.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    window = Window.partitionBy(*group, span).orderBy(first).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(f"_v_{n}").over(window).alias(n) for n in names])
    return summed.where(~F.col("_carry")).select(*all_named(df.columns), *names)


def with_position(df: DataFrame, order: str, name: str = "position", group: Sequence[str] = ()) -> DataFrame:
    """Numbers rows 1, 2, … along a unique integer column, without one global sort task."""
    return running_sums(df, group, order, {name: F.lit(1).cast("long")})


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    how: str = "left",
    right_unique: bool = True,
    left_counts: DataFrame | None = None,
    right_spread: Sequence[str] | None = None,
) -> DataFrame:
    """An equi-join that splits hot keys: every task gets about ``ROWS_PER_SALT`` rows of one key.

    Every key of ``left`` with more rows than that is dealt into pieces, and its matches in ``right`` are copied
    once per piece. The list of such keys holds at most one for each ``ROWS_PER_SALT`` rows, so
    a broadcast of it is small beside any one task. Where ``right``
    can repeat keys too (``right_unique=False``, inner joins only) its hot keys are dealt in the same way.
    The piece of a row is a hash of the row, so a task that runs again makes the same choice.

    Finding the hot keys takes one aggregate over the keys of ``left``; ``left_counts`` (the keys and
    ``rows``) saves it where the counts are at hand. ``right_spread`` names columns of ``right`` that tell the rows of a
    key apart; the others need not be read then to choose a piece.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not right_unique and how != "inner":
        raise ValueError("repeated keys on the right are only supported for inner joins")
    hot = _hot_keys(left, keys, left_counts)
    left, right = _deal(left, keys, hot, "_salt"), _copy(right, keys, hot, "_salt")
    salts = ["_salt"]
    if not right_unique:
        hot = _hot_keys(right.drop("_salt"), keys)
        right, left = _deal(right, keys, hot, "_salt2", right_spread), _copy(left, keys, hot, "_salt2")
        salts.append("_salt2")
    return left.join(right, [*keys, *salts], how).drop(*salts)


def _hot_keys(df: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    hot = counts.where(F.col("rows") > ROWS_PER_SALT)
    pieces = F.ceil(F.col("rows") / ROWS_PER_SALT).cast("int")
    return F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], pieces.alias("_pieces")))


def _with_pieces(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    match = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    return df.join(hot, match, "left").drop(*[f"_hot_{k}" for k in keys])


def _deal(df: DataFrame, keys: Sequence[str], hot: DataFrame, salt: str, spread: Sequence[str] | None = None) -> DataFrame:
    row = F.xxhash64(*all_named(spread or df.columns))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    # Rows without a key match nothing; they are spread so that an outer join does not gather them.
    piece = F.when(no_key, F.pmod(row, F.lit(NULL_PIECES))).otherwise(F.pmod(row, F.col("_pieces")))
    dealt = _with_pieces(df, keys, hot)
    return dealt.withColumn(salt, F.coalesce(piece, F.lit(0)).cast("int")).drop("_pieces")


def _copy(df: DataFrame, keys: Sequence[str], hot: DataFrame, salt: str) -> DataFrame:
    last = F.coalesce(F.col("_pieces"), F.lit(1)) - 1
    copied = _with_pieces(df, keys, hot)
    return copied.withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop("_pieces")


def ordered_fold(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    item: Column,
    fold: Callable[[Column], Column],
    span_bits: int = 12,
) -> DataFrame:
    """Folds the rows of a group in order, by stretches first and then over the stretches.

    ``fold`` turns an ordered array of items into one item of the same type, and must be
    associative. A task holds at most ``2**span_bits`` rows of a group at the first
    step, and one item per stretch at the second. Output: the group columns and ``folded``.
    """
    group = list(group)
    pieces = (
        df.select(*group, F.col(order).cast("long").alias("_order"), item.alias("_item"))
        .groupBy(*group, F.shiftright("_order", span_bits).alias("_span"))
        .agg(_folded(fold, "_order", "_item").alias("_item"))
    )
    return pieces.groupBy(*group).agg(_folded(fold, "_span", "_item").alias("folded"))


def _folded(fold: Callable[[Column], Column], order: str, item: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(item).alias("item"))))
    return fold(F.transform(ordered, lambda pair: pair["item"]))


def ordered_concat(df: DataFrame, group: Sequence[str], order: str, text: Column, separator: str) -> DataFrame:
    """Joins the texts of a group in order: columns ``group`` and ``folded``."""
    return ordered_fold(df, group, order, text, lambda items: F.array_join(items, separator))


def ordered_pieces(
    df: DataFrame, group: Sequence[str], order: str, text: Column, separator: str, most_bytes: int, **spans: int
) -> DataFrame:
    """Joins the texts of a group in order into numbered pieces: columns ``group``, ``piece`` (from 0) and ``folded``.

    A piece ends with the text that takes it to ``most_bytes`` or beyond, so no cell, and no task, holds more than that and one text, however
    long the group is.
    """
    sized = df.select(*group, F.col(order).cast("long").alias("_order"), text.alias("_text"))
    own = (F.octet_length("_text") + len(separator.encode())).cast("long")
    summed = running_sums(sized, group, "_order", {"_bytes": own}, **spans)
    piece = F.floor((F.col("_bytes") - own) / most_bytes).cast("long").alias("piece")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_order").alias("at"), F.col("_text").alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda pair: pair["text"]), separator)
    pieces = summed.select(*group, piece, "_order", "_text").groupBy(*group, "piece").agg(joined.alias("folded"))
    # Texts longer than a piece leave numbers out.
    return with_position(pieces, "piece", "_number", group).select(*group, (F.col("_number") - 1).alias("piece"), "folded")
