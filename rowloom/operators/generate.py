"""Running a model over the requests of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.payload import END_MARKER, approx_tokens, token_budget
from rowloom.plans.scale import spread_small
from rowloom.session import written

# Request defaults, and how much of an error message is kept.
DEFAULT_MODEL = "openai/local-model"
TEMPERATURE = 0.7
ERROR_CHARS = 200

#: Requests (dicts with ``prompt``, ``model``, ``temperature``, ``max_tokens``, ``stop``) in, replies
#: out: a text, or a dict with ``text`` and, if known, ``prompt_tokens`` and ``completion_tokens``.
Generator = Callable[[Sequence[dict]], Sequence[object]]

REPLY_FIELDS = [
    T.StructField("reply", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("seconds", T.DoubleType()),
]


def with_request(
    rows: DataFrame,
    prompt: Column,
    payload_length: Column,
    context_length: Column | int = 0,
    model: str = DEFAULT_MODEL,
    temperature: float = TEMPERATURE,
    stop: Sequence[str] = (END_MARKER,),
) -> DataFrame:
    """Adds ``request``: everything one call to a model needs."""
    request = F.struct(
        prompt.alias("prompt"),
        F.lit(model).alias("model"),
        F.lit(temperature).alias("temperature"),
        token_budget(payload_length, context_length).alias("max_tokens"),
        F.array(*[F.lit(s) for s in stop]).alias("stop"),
    )
    return rows.withColumn("request", request)


def run_generator(
    requests: DataFrame,
    load_generator: Callable[[], Generator],
    batch: int = 32,
    max_tasks: int | None = None,
) -> DataFrame:
    """``requests`` with the reply to each: ``reply``, ``error``, tokens and seconds.

    The generator is loaded once per task and gets batches. A batch that fails is tried row
    by row, so one bad request costs one row: its ``error`` is set and the run goes on.
    ``max_tasks`` bounds how many tasks call the endpoint at a time.
    """
    schema = T.StructType([*requests.schema.fields, *REPLY_FIELDS])
    requests = spread_small(requests) if max_tasks is None else requests.repartition(max_tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        generate = load_generator()

        def ask(items: list[dict]) -> list[dict]:
            start = time.monotonic()
            try:
                replies = list(generate(items))
                if len(replies) != len(items):
                    raise ValueError(f"{len(replies)} replies to {len(items)} requests")
            except Exception as problem:  # noqa: BLE001 - any failure belongs to its row
                if len(items) > 1:
                    return [answer for item in items for answer in ask([item])]
                return [_answer(None, str(problem), start, 1, time.monotonic())]
            end = time.monotonic()
            return [_answer(r, None, start, len(items), end) for r in replies]

        for frame in frames:
            answers: list[dict] = []
            items = [_plain(r) for r in frame["request"]]
            for i in range(0, len(items), batch):
                answers += ask(items[i : i + batch])
            for field in REPLY_FIELDS:
                values = [a[field.name] for a in answers]
                frame[field.name] = pd.Series(values, index=frame.index, dtype=_DTYPES.get(field.name, "object"))
            yield frame

    out = requests.mapInPandas(run, schema)
    # Endpoints that report no usage: estimates from the lengths.
    return out.withColumns({
        "prompt_tokens": F.coalesce("prompt_tokens", approx_tokens(F.length("request.prompt")).cast("long")),
        "completion_tokens": F.coalesce(
            "completion_tokens", approx_tokens(F.length(F.coalesce("reply", error_text(F.col("error"))))).cast("long")
        ),
    })


_DTYPES = {"prompt_tokens": "Int64", "completion_tokens": "Int64", "seconds": "float64"}


def _plain(request) -> dict:
    items = request.asDict() if hasattr(request, "asDict") else dict(request)
    items["stop"] = list(items["stop"])
    return items


def _answer(reply, error: str | None, start: float, share: int, end: float) -> dict:
    fields = reply if isinstance(reply, dict) else {"text": reply}
    return {
        "reply": fields.get("text"),
        "error": error,
        "prompt_tokens": fields.get("prompt_tokens"),
        "completion_tokens": fields.get("completion_tokens"),
        "seconds": max((end - start) / share, 1e-6),
    }


def error_text(error: Column) -> Column:
    return F.concat(F.lit("Error: "), F.substring(error, 1, ERROR_CHARS))


def reply_or_error(reply: Column, error: Column, on_error: str = "message") -> Column:
    """A failed request gives its message or, with ``on_error="empty"``, an empty reply."""
    if on_error not in ("message", "empty"):
        raise ValueError("on_error is 'message' or 'empty'")
    instead = error_text(error) if on_error == "message" else F.lit("")
    return F.when(error.isNotNull(), instead).otherwise(F.coalesce(reply, F.lit("")))


#: What names a request: a digest of all of it, and the number of the run that sent it.
FINGERPRINT, COMMIT = "request_digest", "commit"


def fingerprint(request: Column) -> Column:
    """A digest of everything that is sent: prompt, model, temperature, budget and stop marks."""
    return F.sha2(F.to_json(request), 256)


def generate_once(
    requests: DataFrame,
    load_generator: Callable[[], Generator],
    path: str,
    request_id: Sequence[str],
    batch: int = 32,
    max_tasks: int | None = None,
) -> DataFrame:
    """Replies for all ``requests``, written to ``path``: calls cost money, so none is made twice.

    A reply belongs to a request by the digest of the whole request. Requests that have one at ``path`` already are not sent again,
    so a run that broke off is resumed by starting it again, also where the rows got other ids meanwhile; a request that
    changed in any part is new. Failed requests are sent again, and then have two rows (see ``reply_order``). Replies of earlier runs to
    other requests stay at ``path`` and are not returned. Equal requests of different rows are each sent in the run that meets them
    first; later rows share the newest reply.
    """
    spark = requests.sparkSession
    keys = list(request_id)
    # Prompts, and the search for their context, are made once.
    asked = written(requests.withColumn(FINGERPRINT, fingerprint(F.col("request"))), "requests")
    schema = T.StructType([
        *[requests.schema[k] for k in keys], T.StructField(FINGERPRINT, T.StringType()), T.StructField(COMMIT, T.LongType()), *REPLY_FIELDS,
    ])

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    todo, number = asked, 0
    try:
        last = stored().agg(F.max(COMMIT)).first()[0]
        number = 0 if last is None else last + 1
        todo = asked.join(stored().where(F.col("error").isNull()).select(FINGERPRINT).distinct(), FINGERPRINT, "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    replies = run_generator(todo, load_generator, batch, max_tasks).withColumn(COMMIT, F.lit(number).cast("long"))
    replies.select(*schema.names).write.mode("append").parquet(path)

    wanted = asked.select(*keys, FINGERPRINT)
    own = stored().join(wanted, [*keys, FINGERPRINT], "left_semi")
    newest = stored().groupBy(FINGERPRINT).agg(F.max_by(F.struct(COMMIT, *[f.name for f in REPLY_FIELDS]), reply_order()).alias("newest"))
    others = wanted.join(own.select(*keys, FINGERPRINT).distinct(), [*keys, FINGERPRINT], "left_anti").join(newest, FINGERPRINT)
    return own.select(*schema.names).unionByName(others.select(*keys, FINGERPRINT, "newest.*").select(*schema.names))


def reply_order() -> Column:
    """Of several replies to one request (a failed one and its repeat) the greatest counts."""
    return F.struct(F.col("error").isNull(), F.col(COMMIT), F.col("seconds"), F.col("reply"))
