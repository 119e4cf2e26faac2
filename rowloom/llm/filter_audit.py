"""How filters interact: what each removes in every order of application, from counts of surviving subsets.

Every document becomes a 32-bit word with one bit per subset of the five filters, set where the document survives all
filters of that subset. Inside a task carry-save adders count the set bits of many words at once, position by position:
three words become a word of sums and a word of carries, until few words are left at each power of two. The counts of a
batch are one row per part; sums of such rows give, for each part and label, how many documents survive each subset. All results
follow from these 32 counts: a step of an order keeps the survivors of the filters up to it.

Defined results: a null text is an empty one, a null part an empty string. A filter that compares with other documents
(``copies``) looks at the whole table: a document is a copy if a row with a smaller id has the same text, so rows without an
id, and rows that repeat both id and text, are no copies of each other. A document has a label if any row of the label table
with its id says so. An empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import columns, words_of
from rowloom.session import written

#: Filters by letter; the fifth needs the whole table and is bit 4.
FILTERS = "ABCDE"
_SUBSETS = 1 << len(FILTERS)
_ALL = _SUBSETS - 1

MIN_WORDS = 200
MIN_DISTINCT, MAX_CAPITALS = 50, 3


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails: few words, few distinct ones, many capitals, a symbol."""
    words = words_of(text)
    n, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def surviving_word(failed: int) -> int:
    """One bit for each subset of filters: set if a document that fails ``failed`` survives all of the subset."""
    return sum(1 << subset for subset in range(_SUBSETS) if not subset & failed)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits set."""
    counts, positions = np.zeros(32, np.int64), np.arange(32, dtype=np.uint32)
    words, weight = words.astype(np.uint32), 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            one, two, three = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = one ^ two
            carries.append((one & two) | (half & three))
            words = np.concatenate([half ^ three, words[3 * third :]])
        for word in words:
            counts += weight * ((word >> positions) & 1).astype(np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def failures(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """``(doc_id, part, failed)`` of every document: a bit for each filter that it fails, also where another one does."""
    own = columns(docs, doc_id=key, text=text, part=part).select(
        "doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = written(
        own.select(
            "doc_id", "part", text_failures(F.col("text")).alias("failed"),
            F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("t2"),
        ),
        "audit-rows",
    )
    # Written, so that the join deals both sides anew and Spark can split a text that very many rows share.
    texts = rows.groupBy("t", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copied = written(texts.where(F.col("n") > 1).drop("n"), "audit-copied")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failed = F.col("failed") + F.when(is_copy, F.lit(1 << 4)).otherwise(F.lit(0))
    return rows.join(copied, ["t", "t2"], "left").select("doc_id", "part", failed.cast("int").alias("failed"))


def survivors(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each part: ``every``, ``good`` and ``toxic``, arrays of how many documents survive each subset of the filters."""
    marks = columns(labels, doc_id=key, quality="quality", toxic="toxic").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = failed.join(written(marks.where("doc_id IS NOT NULL AND (good OR toxic)"), "audit-labels"), "doc_id", "left")
    table = np.array([surviving_word(f) for f in range(_SUBSETS)], np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pandas()
            words = table[found["failed"].to_numpy()]
            codes, parts = pd.factorize(found["part"])
            order = np.argsort(codes, kind="stable")
            ends = np.searchsorted(codes[order], np.arange(1, len(parts) + 1))
            good, toxic = found["good"].to_numpy(bool), found["toxic"].to_numpy(bool)
            rows = []
            for name, own in zip(parts, np.split(order, ends[:-1])):
                sets = (words[own], words[own[good[own]]], words[own[toxic[own]]])
                rows.append((name, *[positional_counts(s).tolist() for s in sets]))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    lists = pa.list_(pa.int64())
    schema = pa.schema([("part", pa.string()), ("every", lists), ("good", lists), ("toxic", lists)])
    no = F.lit(False)
    slim = marked.select("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    partial = slim.mapInArrow(count, "part string, every array<long>, good array<long>, toxic array<long>")
    each = partial.select("part", F.posexplode(F.arrays_zip("every", "good", "toxic")).alias("subset", "n"))
    sums = each.groupBy("part", "subset").agg(*[F.sum(f"n.{c}").alias(c) for c in ("every", "good", "toxic")])
    # 32 rows a part.
    ordered = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "every", "good", "toxic"))).alias("n"))
    return ordered.select("part", *[F.col(f"n.{c}").alias(c) for c in ("every", "good", "toxic")])


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; see ``audit``."""

    def at(name: str, subset: Column) -> Column:
        return F.get(F.col(name), subset)

    def lost(name: str) -> Column:
        return at(name, F.col("_before")) - at(name, F.col("_after"))

    def values(of) -> Column:
        return F.get(F.array(*[of(1 << i) for i in range(len(FILTERS))]), F.col("_filter"))

    def over_all_orders(bit: int) -> Column:
        terms = []
        for subset in range(_SUBSETS):
            if not subset & bit:
                before = subset.bit_count()
                orders = math.factorial(before) * math.factorial(len(FILTERS) - 1 - before)
                terms.append(F.lit(orders).cast("long") * (at("every", F.lit(subset)) - at("every", F.lit(subset | bit))))
        return sum(terms[1:], terms[0])

    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    place = [F.instr("filter_order", letter) for letter in FILTERS]
    first = [F.when(p < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(place)]
    filter_at = F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    placed = steps.withColumn("_before", sum(first[1:], first[0])).withColumn("_filter", filter_at)
    placed = placed.withColumn("_after", F.col("_before") + F.get(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), "_filter"))
    fails = values(lambda bit: at("every", F.lit(0)) - at("every", F.lit(bit)))
    return placed.select(
        "part", "filter_order", "step", at("every", F.col("_after")).alias("kept"), lost("every").alias("removed"),
        (fails - lost("every")).alias("redundant"),
        values(lambda bit: at("every", F.lit(_ALL ^ bit)) - at("every", F.lit(_ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), values(over_all_orders).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, per part.

    Documents of the part that are kept after the step and removed at it; that fail its filter but went before; that fail its filter
    and no other; good and toxic ones removed at the step; and the filter's removals summed over all orders.
    """
    return interactions(survivors(failures(docs), labels))
