"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A batch holds changes of documents: an insert counts +1 document and +n tokens, a delete the same with a minus sign, and a
revised count is the delete of the old one with the insert of the new. Each batch is summed before it is stored, and
totals are sums over batches, so a batch costs what changed and never a pass over the corpus.

Commits are idempotent: a batch is stored under its name, so sending it again, or repeating one that broke off, replaces
it by the same sums. ``compact`` folds the batches into one base and keeps the names of what is in it; a batch that
comes again after that is ignored.

Defined results: a null text counts 0 tokens; null sources and languages are a group of their own (null). Repeated rows count each
time. Groups whose documents and tokens are all gone are left out of totals. Other columns are ignored; an empty batch
changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import columns

_KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def changes(
    docs: DataFrame, tokenizer: str, count: Column, sign: int = 1, source: str = "source", lang: str = "lang",
) -> DataFrame:
    """One signed row per document; ``count`` is an expression over the columns of ``docs``."""
    if sign not in (1, -1):
        raise ValueError("a sign is 1 or -1")
    counted = docs.withColumn("_count", F.coalesce(count, F.lit(0)).cast("long"))
    rows = columns(counted, source=source, lang=lang, _count="_count")
    return rows.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"),
        (F.col("_count") * sign).alias("n_tokens"),
    )


class Rollup:
    """Totals in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Stores the sums of a batch of signed rows under the batch's name."""
        if not batch or any(c in batch for c in "/\\=:") or batch.startswith(("_", ".")):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self._folded().where(F.col("batch") == batch).limit(1).count():
            return
        summed = deltas.groupBy(*_KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)`` over all batches."""
        rows = self._read(f"{self.path}/batches", f"{_SCHEMA}, batch string")
        base = self._base()
        if base:
            rows = rows.join(self._folded(), "batch", "left_anti").drop("batch").unionByName(self._read(f"{self.path}/{base}/sums", _SCHEMA))
        out = rows.groupBy(*_KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Folds all batches into a new base; the name list is written last and makes it valid."""
        number = int((self._base() or "base-0").split("-")[1]) + 1
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base-{number}/sums")
        stored = self._read(f"{self.path}/batches", f"{_SCHEMA}, batch string").select("batch")
        listed = self._folded().unionByName(stored).distinct().withColumn("base", F.lit(number))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/names/number={number}")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _base(self) -> str | None:
        last = self._read(f"{self.path}/names", "batch string, base int, number int").agg(F.max("base")).first()[0]
        return f"base-{last}" if last else None

    def _folded(self) -> DataFrame:
        """The names of the batches that are in the base, one row each."""
        named = self._read(f"{self.path}/names", "batch string, base int, number int")
        last = named.agg(F.max("base")).first()[0]
        return named.where(F.col("base") == (last or 0)).select("batch")
