"""Checks on sets of files, from listings ``(name, size)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.plans.scale import salted_join


def parse_shards(listing: DataFrame, extension: str = "gguf") -> DataFrame:
    """Adds ``base``, ``part`` and ``total`` of names like ``base-00001-of-00003.gguf`` (else null)."""
    pattern = rf"^(.+)-(\d+)-of-(\d+)\.{extension}$"

    def piece(i: int):
        return F.regexp_extract("name", pattern, i)

    is_part = F.col("name").rlike(pattern)
    return listing.select(
        "*",
        F.when(is_part, piece(1)).alias("base"),
        F.when(is_part, piece(2).cast("bigint")).alias("part"),
        F.when(is_part, piece(3).cast("bigint")).alias("total"),
    )


def shard_sets(listing: DataFrame, extension: str = "gguf") -> DataFrame:
    """One row per base name: ``parts``, ``size`` (null if any is unknown) and ``complete``.

    A set is complete when all parts agree on the total and are exactly 1 to total. Counts,
    smallest and largest part tell that, so no list of parts is gathered.
    """
    parts = parse_shards(listing, extension).where(F.col("base").isNotNull())
    once = parts.groupBy("base", "part").agg(
        F.count("*").alias("n"), F.min("total").alias("low"), F.max("total").alias("high"),
        F.count("size").alias("known"), F.sum("size").alias("size"),
    )
    sets = once.groupBy("base").agg(
        F.sum("n").alias("parts"), F.count("*").alias("distinct_parts"),
        F.min("part").alias("first"), F.max("part").alias("last"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.when(F.sum("known") == F.sum("n"), F.sum("size")).alias("size"),
    )
    complete = (
        (F.col("low") == F.col("high")) & (F.col("parts") == F.col("low"))
        & (F.col("distinct_parts") == F.col("parts")) & (F.col("first") == 1) & (F.col("last") == F.col("parts"))
    )
    return sets.select("base", "parts", "size", complete.alias("complete"))


def group_shards(listing: DataFrame, extension: str = "gguf") -> DataFrame:
    """Every file with ``group_name``: its base when the set is complete, else its own name."""
    files = parse_shards(listing, extension)
    complete = shard_sets(listing, extension).where("complete").select("base", F.lit(True).alias("_complete"))
    joined = salted_join(files, complete, "base")
    return joined.select(
        *listing.columns,
        F.when(F.col("_complete"), F.col("base")).otherwise(F.col("name")).alias("group_name"),
        F.when(F.col("_complete"), F.col("part")).alias("part"),
    )


def set_sizes(listing: DataFrame, extension: str = "gguf") -> DataFrame:
    """Files and complete sets with their sizes, smallest first; unknown sizes last, by name.

    Complete sets show as ``<base>.<extension>``; files of other sets stand alone.
    """
    sized = _entries(listing, extension)
    unknown_name = F.when(F.col("size").isNull(), F.col("name"))
    return sized.orderBy(F.asc_nulls_last("size"), unknown_name, "name")


def _entries(listing: DataFrame, extension: str) -> DataFrame:
    sets = shard_sets(listing, extension).where("complete")
    grouped = sets.select(F.concat(F.col("base"), F.lit(f".{extension}")).alias("name"), "size", "parts")
    alone = (
        group_shards(listing, extension).where(F.col("part").isNull())
        .select("name", F.col("size").cast("long"), F.lit(1).cast("long").alias("parts"))
    )
    return grouped.unionByName(alone)


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files with ``remote_size``, ``reason`` and ``corrupted``; nothing is ever deleted.

    A file is flagged when the remote listing lacks it or gives another size. An unknown
    (null or zero) remote size flags nothing. Names are unique in each listing.
    """
    known = remote.select("name", F.col("size").alias("remote_size"), F.lit(True).alias("_listed"))
    joined = local.join(known, "name", "left")
    reason = (
        F.when(F.col("_listed").isNull(), F.lit("missing"))
        .when(F.coalesce(F.col("remote_size"), F.lit(0)) == 0, F.lit("unverified"))
        .when(~F.col("size").eqNullSafe(F.col("remote_size")), F.lit("size"))
        .otherwise(F.lit("ok"))
    )
    return joined.select(
        *local.columns, "remote_size", reason.alias("reason"), reason.isin("missing", "size").alias("corrupted")
    )
