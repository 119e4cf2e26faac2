"""Token usage and speed of a run, from one row per reply.

Rows are ``(run_id, def_id, seq, prompt_tokens, completion_tokens, seconds, input_est)``; ``seq`` is
an integer that is unique within a run. A run may be most of the table, so nothing here
puts a run into one window group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.names import named
from rowloom.plans.scale import SPAN_BITS, running_sums, with_position
from rowloom.session import written

# Replies in the recent speed, bounds of the output/input ratio, slowest speed.
RECENT = 10
RATIO_MIN, RATIO_MAX = 0.2, 8.0
SPEED_MIN = 1e-6
SECONDS_MIN = 1e-6


def running_totals(usage: DataFrame, run: Sequence[str] = ("run_id",), order: str = "seq") -> DataFrame:
    """Adds ``total_prompt``, ``total_completion`` and ``total_tokens`` up to each reply."""
    sums = {"total_prompt": F.col("prompt_tokens"), "total_completion": F.col("completion_tokens")}
    totals = running_sums(usage, run, order, sums)
    return totals.withColumn("total_tokens", F.col("total_prompt") + F.col("total_completion"))


def usage_totals(usage: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    return usage.groupBy(*run).agg(
        F.sum("prompt_tokens").alias("total_prompt"),
        F.sum("completion_tokens").alias("total_completion"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def recent_speed(
    usage: DataFrame, run: Sequence[str] = ("run_id",), order: str = "seq", span_bits: int = SPAN_BITS
) -> DataFrame:
    """Replies that produced tokens, with ``recent_speed``: mean tokens per second of the last ten.

    Replies are numbered per run and cut into stretches; the last nine of a stretch are
    also shown to the next one, so each stretch is complete on its own.
    """
    spoken = usage.where((F.col("completion_tokens") > 0) & (F.col("seconds") > 0))
    numbered = with_position(spoken, order, "_n", run)
    width = 1 << span_bits
    own = F.shiftright(F.col("_n") - 1, span_bits)
    is_tail = F.pmod(F.col("_n") - 1, F.lit(width)) >= width - (RECENT - 1)
    shown = numbered.withColumn("_own", own).withColumn(
        "_span", F.explode(F.when(is_tail, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    window = Window.partitionBy(*run, "_span").orderBy("_n").rowsBetween(-(RECENT - 1), 0)
    speed = F.avg(F.col("completion_tokens") / F.col("seconds")).over(window)
    return (
        shown.withColumn("recent_speed", speed)
        .where(F.col("_own") == F.col("_span"))
        .drop("_n", "_own", "_span")
    )


def calibration(
    usage: DataFrame, definition: Sequence[str] = ("run_id", "def_id"), order: str = "seq"
) -> DataFrame:
    """Per definition, from its first reply: ``ratio`` of output to estimated input, and ``speed``."""
    first = F.min_by(F.struct("completion_tokens", "seconds", "input_est"), F.col(order))
    picked = usage.groupBy(*definition).agg(first.alias("first"))
    tokens = F.col("first.completion_tokens").cast("double")
    ratio = tokens / F.greatest(F.lit(1), F.col("first.input_est"))
    speed = tokens / F.greatest(F.lit(SECONDS_MIN), F.col("first.seconds"))
    return picked.select(
        *definition,
        F.greatest(F.lit(RATIO_MIN), F.least(F.lit(RATIO_MAX), ratio)).alias("ratio"),
        F.greatest(F.lit(SPEED_MIN), speed).alias("speed"),
    )


def remaining_time(
    usage: DataFrame, definition: Sequence[str] = ("run_id", "def_id"), order: str = "seq", span_bits: int = SPAN_BITS
) -> DataFrame:
    """Adds ``remaining_seconds``: the forecast for the rows of the definition that follow.

    One aggregate gives, for each stretch of replies, its estimates and its first reply. What the stretches before add up to, the
    definition's total and its calibration enter every stretch as one more row in front of the others, so the rows themselves are
    read once and shuffled once.
    """
    group = list(definition)
    estimate = F.greatest(F.lit(1), F.col("input_est")).cast("long")
    spanned = usage.withColumn("_span", F.shiftright(F.col(order).cast("long"), span_bits))
    stretches = written(
        spanned.groupBy(*group, "_span").agg(
            F.sum(estimate).alias("_own"), F.min(order).alias(order),
            *[F.min_by(c, order).alias(c) for c in ("completion_tokens", "seconds", "input_est")],
        ),
        "stretches",
    )
    totals = stretches.groupBy(*group).agg(F.sum("_own").alias("_all"))
    facts = calibration(stretches, group, order).join(totals, group)
    before = running_sums(stretches.select(*group, "_span", "_own"), group, "_span", {"_before": F.col("_own")}, levels=2)
    carried = before.join(facts, group).select(*group, "_span", (F.col("_before") - F.col("_own")).alias("_estimate"), "_all", "ratio", "speed")
    rows = spanned.withColumn("_estimate", estimate).unionByName(carried, allowMissingColumns=True)
    # The carried row has no place in the order, so it comes first.
    so_far = Window.partitionBy(*group, "_span").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    following = (F.max("_all").over(so_far) - F.sum("_estimate").over(so_far)).cast("double")
    forecast = F.floor(F.max("ratio").over(so_far) * following / F.max("speed").over(so_far))
    out = rows.select(*[named(c) for c in usage.columns], forecast.alias("remaining_seconds"), F.col("_all").isNotNull().alias("_carried"))
    return out.where(~F.col("_carried")).drop("_carried")
