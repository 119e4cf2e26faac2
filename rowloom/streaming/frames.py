"""Reassembling streamed replies from captured frames ``(request_id, frame_no, frame)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.payload import approx_tokens
from rowloom.plans.scale import ordered_fold

# The prefix of a data line, the end mark, and the fields that are read.
DATA = "data:"
DONE = "[DONE]"
FIELDS = (
    "choices array<struct<delta: struct<content: string>>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint>"
)


def data_lines(frame: Column) -> Column:
    """The data of a frame's ``data:`` lines, up to its end mark. Later frames are read all the same."""
    lines = F.filter(F.split(frame, "\n", -1), lambda line: line.startswith(DATA))
    data = F.transform(lines, lambda line: F.btrim(F.substring(line, len(DATA) + 1, 1 << 30), F.lit(" \t\n\r\x0b\x0c")))
    done = F.array_position(data, F.lit(DONE))
    return F.when(done > 0, F.slice(data, 1, F.greatest(done - 1, F.lit(0)).cast("int"))).otherwise(data)


def _is_one_value(line: Column) -> Column:
    """Whether a line is one JSON value and nothing else: inside brackets it is an array of one."""
    boxed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    return F.coalesce(F.schema_of_variant(boxed).startswith("ARRAY"), F.lit(False)) & F.try_variant_get(boxed, "$[1]", "string").isNull()


def assemble_replies(frames: DataFrame, prompt_tokens: Column | None = None) -> DataFrame:
    """``(request_id, reply, prompt_tokens, completion_tokens)`` per request.

    Lines that do not parse are skipped. Completion tokens are estimated from the pieces of
    text until the server reports usage; what it reports replaces the estimate so far. ``prompt_tokens``
    is the estimate to use when it never does.
    """
    estimate = F.lit(None).cast("bigint") if prompt_tokens is None else prompt_tokens.cast("bigint")
    # Each frame becomes one summary; summaries of neighbouring frames add up to one of both.
    strict = F.filter(data_lines(F.col("frame")), _is_one_value)
    parsed = F.transform(strict, lambda line: F.from_json(line, FIELDS, {"allowSingleQuotes": "false"}))
    events = F.transform(parsed, _summary)
    start = F.struct(F.lit("").alias("text"), *_nothing())
    item = F.aggregate(events, start, _add)
    with_estimate = frames.select("request_id", "frame_no", item.alias("s"), estimate.alias("_estimate"))
    folded = ordered_fold(
        with_estimate.select("request_id", "frame_no", F.struct("s.*", "_estimate").alias("item")),
        ["request_id"], "frame_no", F.col("item"), _fold,
    )
    return folded.select(
        "request_id",
        F.col("folded.text").alias("reply"),
        F.coalesce("folded.prompt", "folded._estimate").alias("prompt_tokens"),
        (F.coalesce("folded.completion", F.lit(0)) + F.col("folded.estimated")).alias("completion_tokens"),
    )


def _nothing() -> list[Column]:
    return [
        F.lit(None).cast("bigint").alias("prompt"),
        F.lit(None).cast("bigint").alias("completion"),
        F.lit(0).cast("bigint").alias("estimated"),
    ]


def _summary(event: Column) -> Column:
    """One event: its text, the usage it reports, and the estimate that is not covered by usage."""
    text = F.coalesce(F.get(event["choices"], F.lit(0))["delta"]["content"], F.lit(""))
    completion = event["usage"]["completion_tokens"]
    estimated = F.when(completion.isNotNull() | (text == ""), F.lit(0)).otherwise(approx_tokens(F.length(text)))
    return F.struct(
        text.alias("text"),
        event["usage"]["prompt_tokens"].alias("prompt"),
        completion.alias("completion"),
        estimated.cast("bigint").alias("estimated"),
    )


def _add(left: Column, right: Column) -> Column:
    """The summary of a stretch and the one after it: reported usage replaces what came before."""
    reported = right["completion"].isNotNull()
    return F.struct(
        F.concat(left["text"], right["text"]).alias("text"),
        F.coalesce(right["prompt"], left["prompt"]).alias("prompt"),
        F.coalesce(right["completion"], left["completion"]).alias("completion"),
        (F.when(reported, F.lit(0)).otherwise(left["estimated"]) + right["estimated"]).cast("bigint").alias("estimated"),
    )


def _fold(items: Column) -> Column:
    """Folds ordered summaries; texts are joined once, not appended piece by piece."""
    text = F.array_join(F.transform(items, lambda i: i["text"]), "")
    counts = F.aggregate(
        items,
        F.struct(*_nothing()),
        lambda acc, i: F.struct(
            F.coalesce(i["prompt"], acc["prompt"]).alias("prompt"),
            F.coalesce(i["completion"], acc["completion"]).alias("completion"),
            (F.when(i["completion"].isNotNull(), F.lit(0)).otherwise(acc["estimated"]) + i["estimated"])
            .cast("bigint").alias("estimated"),
        ),
    )
    estimate = F.get(items, F.lit(0))["_estimate"]
    return F.struct(
        text.alias("text"), counts["prompt"].alias("prompt"), counts["completion"].alias("completion"),
        counts["estimated"].alias("estimated"), estimate.alias("_estimate"),
    )
