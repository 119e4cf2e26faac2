"""Quality rules as a ledger of bits: each rule is evaluated once, policies and ablations read the bits.

``measure`` adds the measurements of a text, ``ledger`` turns them into one integer with a bit for each
failed rule, ``apply_policy`` decides by a bit mask, and ``ablation`` counts over the bits alone what each
rule of a policy costs. All of it is native: no Python runs in a task.

Defined results: a null text has no words (all measurements 0). Words are separated by space and the control
characters from tab to carriage return; lines by line feeds. Rows are judged one by one, so repeated
rows get equal verdicts, an empty table gives an empty one, and any other columns are left out or,
in ``apply_policy`` with ``keep_columns``, kept as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named
from rowloom.llm.common import columns, words_of

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: Rule -> condition of failure over the measurements. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "shouting": "100 * n_shouts > 50 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


def mask_of(*rules: str) -> int:
    return sum(BIT[r] for r in set(rules))


#: The rules that every policy includes.
BASE = mask_of("few_words", "repeated_words")

#: Versioned policies: a document is kept when none of the mask's bits is set.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": mask_of("few_words", "repeated_words", "symbols", "shouting", "repeated_lines"),
    "v3": mask_of(*RULES),
}
CURRENT = "v3"


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and one column per name in ``MEASURES`` (all long), for every row."""
    rows = columns(docs, _key=key, _text=text)
    # Arrays are named in a step of their own and used more than once, so they are computed once a row.
    with_words = rows.select("_key", "_text", words_of(F.col("_text")).alias("_words"))
    text_col = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text_col, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text_col) - F.length(F.translate(text_col, SYMBOLS, ""))
    shouts = F.length(text_col) - F.length(F.translate(text_col, "!", ""))
    counted = with_words.select(
        "_key",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        shouts.cast("long").alias("n_shouts"),
        lines.alias("_lines"),
        _windows(F.col("_words")).alias("_windows"),
    )
    sorted_windows = counted.select(
        "_key", "n_words", "word_chars", "n_symbols", "n_shouts",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array("_windows").alias("_sorted"),
    )
    starts = sorted_windows.withColumn("_starts", _repeated_starts(F.col("_sorted"))).drop("_sorted")
    repeated = starts.withColumn("n_repeat_words", _covered(F.col("_starts"))).drop("_starts")
    return repeated.select(F.col("_key").alias(key), *MEASURES)


def _windows(words: Column) -> Column:
    """The three-word windows as (64-bit hash of the words, start)."""
    first = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(
        first,
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")
        ),
    )
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    return F.when(F.size(words) >= 3, windows).otherwise(none)


def _repeated_starts(windows: Column) -> Column:
    """The starts, ascending, of windows that equal a neighbour in the sorted array."""
    kept = F.filter(
        windows,
        lambda w, i: F.coalesce(w["h"] == F.get(windows, i - 1)["h"], F.lit(False))
        | F.coalesce(w["h"] == F.get(windows, i + 1)["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(kept, lambda w: w["at"]))


def _covered(starts: Column) -> Column:
    """How many words three-word windows at ``starts`` cover together."""
    steps = F.transform(
        starts, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - at, F.lit(3)))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measurements and ``failed``, a long with the bit of every rule the document fails."""
    bits = F.lit(0).cast("long")
    for name, failure in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, key, text).withColumn("failed", bits)


def passes(failed: Column, mask: int) -> Column:
    return failed.bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(entries: DataFrame, mask: int = POLICIES[CURRENT], name: str = "kept") -> DataFrame:
    """Adds the verdict of a policy to ledger rows."""
    return entries.select(*all_named(entries.columns), passes(F.col("failed"), mask).alias(name))


def ablation(entries: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """What each rule of each policy costs: ``(policy, rule, n_docs, kept, failing, kept_without)``.

    One pass over the bits: patterns are counted first (at most 2^rules of them), then every policy and
    rule is a sum over patterns.
    """
    spark = entries.sparkSession
    patterns = entries.groupBy("failed").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame(
        [(p, r, mask, BIT[r]) for p, mask in policies.items() for r in RULES if mask & BIT[r]],
        "policy string, rule string, mask long, bit long",
    )
    # Both sides are bounded by the number of rules, not by the data.
    pairs = patterns.select(F.col("failed"), F.col("n"), F.lit(1).alias("_one")).join(
        F.broadcast(asked.withColumn("_one", F.lit(1))), "_one"
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    counted = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return pairs.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        counted(hit == 0).alias("kept"),
        counted(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        counted(hit.bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
