"""Embedding chunks, and the store that keeps embeddings by document content.

The store is four Parquet folders under one path. ``parts`` holds one row per chunk, in folders by the first digit of the content hash and
by write, so that a reader opens only the parts that can hold what it looks for. ``meta`` has one row per embedded document, with the
sizes counted at the write. ``commits`` has one numbered row per write, written last: what a write without one left behind is never read,
and ``vacuum`` frees it. ``empty`` names documents that gave no chunk, so that they are not cut again.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.chunks import chunk_documents
from rowloom.plans.scale import salted_join, spread_small
from rowloom.session import written

#: Texts in, one vector per text out.
Encoder = Callable[[Sequence[str]], np.ndarray]

# Texts per encoder call, the kind of chunks that is embedded, the shortest chunk.
BATCH = 32
CHUNK_TYPE = "sentence"
MIN_CHUNK_LENGTH = 10

CHUNK_SCHEMA = T.StructType([
    T.StructField("content_hash", T.StringType()),
    T.StructField("write_id", T.StringType()),
    T.StructField("chunk_ord", T.IntegerType()),
    T.StructField("chunk", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
META_SCHEMA = T.StructType([
    T.StructField("content_hash", T.StringType()),
    T.StructField("write_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("num_chunks", T.IntegerType()),
    T.StructField("dimension", T.IntegerType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("min_chunk_length", T.IntegerType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("cached_at", T.TimestampType()),
])

COMMIT_SCHEMA = "number long, write_id string, documents long, chunks long, size_bytes long, committed_at timestamp"
#: Rows of ``parts``, with the folders they lie in.
_PART_SCHEMA = T.StructType([
    *[f for f in CHUNK_SCHEMA if f.name != "write_id"], T.StructField("chunk_bytes", T.LongType()), T.StructField("dimension", T.IntegerType()),
    T.StructField("digit", T.StringType()), T.StructField("write_id", T.StringType()),
])
#: Contents to embed are named to all tasks up to this number; more are brought together with their texts by a shuffle.
BROADCAST_CONTENTS = 100_000

_WORD = re.compile(r"[^\W_]+")


def hashing_encoder(dimension: int = 64) -> Callable[[], Encoder]:
    """An encoder without a model: counts of words by hash bucket (first 16 bits of their MD5)."""

    def load() -> Encoder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            found = buckets.get(word)
            if found is None:
                if len(buckets) > 1_000_000:
                    buckets.clear()
                found = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:4], 16) % dimension
                buckets[word] = found
            return found

        def encode(texts: Sequence[str]) -> np.ndarray:
            words = [[bucket(w) for w in _WORD.findall(text.lower())] for text in texts]
            rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
            cells = rows * dimension + np.fromiter((b for w in words for b in w), dtype=np.int64, count=len(rows))
            return np.bincount(cells, minlength=len(texts) * dimension).reshape(len(texts), dimension)

        return encode

    return load


def encode_column(
    df: DataFrame, load_encoder: Callable[[], Encoder], text: str = "chunk", name: str = "embedding",
    batch: int = BATCH, spread: bool = True,
) -> DataFrame:
    """Adds one vector per row. The encoder is loaded once per task and called on small batches.

    Rows travel as Arrow batches: the other columns pass through untouched, and vectors go
    back as one flat buffer. Small inputs are spread over all cores unless ``spread`` is off.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder()
        for rows in batches:
            texts = rows.column(text).to_pylist()
            parts = [np.asarray(encode(texts[i : i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * vectors.shape[1]
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, name])

    return (spread_small(df) if spread else df).mapInArrow(run, schema)


def embed_documents(
    docs: DataFrame, load_encoder: Callable[[], Encoder], kind: str = CHUNK_TYPE, text: str = "text"
) -> DataFrame:
    """Chunks of ``docs`` with vectors; documents without text or chunks give no rows."""
    chunks = chunk_documents(spread_small(docs), kind, text)
    return encode_column(chunks, load_encoder, spread=False)


# --- store -----------------------------------------------------------------------------------


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder of the store; an empty table where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_meta(spark: SparkSession, store: str) -> DataFrame:
    """One row per stored document: of several writes of the same content the newest counts."""
    meta = _read(spark, f"{store}/meta", META_SCHEMA)
    newest = F.max_by(F.struct(*[c for c in meta.columns if c != "content_hash"]), F.struct("cached_at", "write_id"))
    return meta.groupBy("content_hash").agg(newest.alias("m")).select("content_hash", "m.*")


def commits(spark: SparkSession, store: str) -> DataFrame:
    """One row per write that was finished, with its number from 0, documents, chunks and bytes."""
    return _read(spark, f"{store}/commits", COMMIT_SCHEMA)


def complete_entries(spark: SparkSession, store: str, verify: bool = True) -> DataFrame:
    """Entries whose write was finished; others count as misses.

    Chunks are counted when they are written, and a write is committed after its chunks and its metadata, so no chunk is read here.
    ``verify=False`` trusts the metadata alone.
    """
    entries = read_meta(spark, store)
    if not verify:
        return entries
    return entries.join(commits(spark, store).select("write_id").distinct(), "write_id", "left_semi").select(*META_SCHEMA.names)


def has_cached(docs: DataFrame, store: str, verify: bool = True) -> DataFrame:
    """``docs`` with ``cached``: whether their content is stored completely.

    The store is asked by content, so copies of one document are found under any path.
    """
    known = complete_entries(docs.sparkSession, store, verify).select("content_hash", F.lit(True).alias("cached"))
    found = salted_join(docs, known, "content_hash")
    return found.withColumn("cached", F.coalesce("cached", F.lit(False)))


def _digit(content_hash: str = "content_hash"):
    return F.lower(F.substring(content_hash, 1, 1))


def _parts(spark: SparkSession, store: str, entries: DataFrame) -> DataFrame:
    """The chunks of the folders that entries ``(content_hash, write_id)`` point to: filters on folders, found by at most one row for each."""
    chunks = _read(spark, f"{store}/parts", _PART_SCHEMA)
    folders = [tuple(r) for r in entries.select(_digit().alias("digit"), "write_id").distinct().collect()]
    digits, writes = (sorted({f[i] for f in folders}) for i in (0, 1))
    return chunks.where(F.col("digit").isin(digits) & F.col("write_id").isin(writes)).select(*CHUNK_SCHEMA.names)


def get_cached(docs: DataFrame, store: str) -> DataFrame:
    """Stored chunks with vectors for every document of ``docs``; misses give no rows."""
    spark = docs.sparkSession
    entries = complete_entries(spark, store).select("content_hash", "write_id")
    hits = salted_join(docs, entries, "content_hash", "inner")
    chunks = _parts(spark, store, hits)
    # Both sides may repeat: many copies of one content, and many chunks in one document.
    pair = ["content_hash", "write_id"]
    return salted_join(hits, chunks, pair, "inner", right_unique=False, right_spread=[*pair, "chunk_ord"]).drop("write_id")


def missing(docs: DataFrame, store: str, force: bool = False) -> DataFrame:
    """One document per content that is not stored yet; with ``force`` per content at all.

    The choice is made on hashes and paths. Up to ``BROADCAST_CONTENTS`` of them are sent to the texts; beyond that
    the texts are shuffled once.
    """
    once = docs.groupBy("content_hash").agg(F.min("path").alias("path"))
    if not force:
        spark = docs.sparkSession
        known = complete_entries(spark, store).select("content_hash").unionByName(_read(spark, f"{store}/empty", "content_hash string"))
        once = once.join(known, "content_hash", "left_anti")
    once = written(once, "missing")
    few = once.count() <= BROADCAST_CONTENTS
    return docs.join(F.broadcast(once) if few else once, ["content_hash", "path"], "left_semi")


def embed_missing(
    docs: DataFrame,
    store: str,
    load_encoder: Callable[[], Encoder],
    model_name: str = "unknown",
    kind: str = CHUNK_TYPE,
    force: bool = False,
) -> str:
    """Embeds the documents ``(path, content_hash, text, …)`` that the store lacks; returns the write's id."""
    todo = missing(docs.select("path", "content_hash", "text"), store, force)
    write_id = cache_embeddings(embed_documents(todo, load_encoder, kind), store, model_name, kind)
    written_now = _read(docs.sparkSession, f"{store}/meta", META_SCHEMA).where(F.col("write_id") == write_id)
    empty = todo.select("content_hash").distinct().join(written_now, "content_hash", "left_anti")
    empty.write.mode("append").parquet(f"{store}/empty")
    return write_id


def cache_embeddings(
    chunks: DataFrame, store: str, model_name: str = "unknown", kind: str = CHUNK_TYPE
) -> str:
    """Appends chunks ``(path, content_hash, chunk_ord, chunk, embedding)``, then their metadata, then the commit."""
    write_id = uuid.uuid4().hex
    own = chunks.select("path", "content_hash", "chunk_ord", "chunk", "embedding").withColumns(_sizes())
    own.select("*", _digit().alias("digit"), F.lit(write_id).alias("write_id")).write.mode("append").partitionBy("digit", "write_id").parquet(
        f"{store}/parts"
    )
    # Metadata is computed from what was written, not from a second run of the encoder, and without reading the vectors.
    rows = _written_parts(chunks.sparkSession, store, write_id, "path string")
    meta = rows.groupBy("content_hash").agg(
        F.min("path").alias("file_path"), F.count("*").cast("int").alias("num_chunks"),
        F.max("dimension").alias("dimension"), F.sum("chunk_bytes").alias("size_bytes"),
    )
    _finish(
        meta.select(
            "content_hash", "file_path", F.substring_index("file_path", "/", -1).alias("file_name"), "num_chunks", "dimension",
            F.lit(model_name).alias("model_name"), F.lit(kind).alias("chunk_type"),
            F.lit(MIN_CHUNK_LENGTH).alias("min_chunk_length"), "size_bytes",
        ),
        store, write_id,
    )
    return write_id


def _sizes() -> dict:
    size = F.octet_length("chunk") + 4 * F.coalesce(F.size("embedding"), F.lit(0))
    return {"chunk_bytes": size.cast("long"), "dimension": F.size("embedding")}


def _written_parts(spark: SparkSession, store: str, write_id: str, *more: str) -> DataFrame:
    schema = ", ".join([*more, *[f"{f.name} {f.dataType.simpleString()}" for f in _PART_SCHEMA]])
    return _read(spark, f"{store}/parts", schema).where(F.col("write_id") == write_id)


def _finish(meta: DataFrame, store: str, write_id: str) -> None:
    """Writes the metadata of a write, and then the commit that makes it count."""
    spark = meta.sparkSession
    meta = meta.withColumns({"write_id": F.lit(write_id), "cached_at": F.current_timestamp()}).select(*META_SCHEMA.names)
    meta.write.mode("append").parquet(f"{store}/meta")
    last = commits(spark, store).agg(F.max("number")).first()[0]
    stored = _read(spark, f"{store}/meta", META_SCHEMA).where(F.col("write_id") == write_id)
    zero = F.lit(0).cast("long")
    commit = stored.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("num_chunks"), zero).alias("chunks"), F.coalesce(F.sum("size_bytes"), zero).alias("size_bytes")
    )
    number = F.lit(0 if last is None else last + 1).cast("long").alias("number")
    commit.select(
        number, F.lit(write_id).alias("write_id"), "documents", "chunks", "size_bytes", F.current_timestamp().alias("committed_at")
    ).write.mode("append").parquet(f"{store}/commits")


def compact(store: str, spark: SparkSession) -> str:
    """Brings the chunks of all entries that count into one write; returns its id. ``vacuum`` then frees the older ones."""
    write_id = uuid.uuid4().hex
    entries = written(complete_entries(spark, store), "entries")
    # What counts is told by what does not: the entries that a newer write replaced, which are few beside all. Chunks are shuffled once, for their
    # new folders.
    pairs = _read(spark, f"{store}/meta", META_SCHEMA).select("content_hash", "write_id").distinct()
    counting = entries.select("content_hash", "write_id")
    writes = [r[0] for r in counting.select("write_id").distinct().collect()]
    replaced = pairs.where(F.col("write_id").isin(writes)).join(counting, ["content_hash", "write_id"], "left_anti")
    replaced = written(replaced, "replaced")
    few = replaced.count() <= BROADCAST_CONTENTS
    chunks = _read(spark, f"{store}/parts", _PART_SCHEMA).where(F.col("content_hash").isNotNull() & F.col("write_id").isin(writes))
    chunks = chunks.join(F.broadcast(replaced) if few else replaced, ["content_hash", "write_id"], "left_anti")
    moved = chunks.withColumn("write_id", F.lit(write_id)).repartition("digit", "content_hash").sortWithinPartitions("digit", "content_hash")
    moved.write.mode("append").partitionBy("digit", "write_id").parquet(f"{store}/parts")
    _finish(entries.drop("write_id", "cached_at"), store, write_id)
    return write_id


def vacuum(store: str, spark: SparkSession) -> list[str]:
    """Frees the chunks of writes that no entry counts on, broken ones among them; returns their ids.

    Run it while nothing writes to the store.
    """
    used = complete_entries(spark, store).select("write_id").distinct()
    parts = _read(spark, f"{store}/parts", _PART_SCHEMA).select("digit", "write_id").distinct()
    # One row per folder.
    old = [tuple(r) for r in parts.join(used, "write_id", "left_anti").select("digit", "write_id").collect()]
    none = spark.createDataFrame([], T.StructType([f for f in _PART_SCHEMA if f.name not in ("digit", "write_id")]))
    for digit, write_id in old:
        none.write.mode("overwrite").parquet(f"{store}/parts/digit={digit}/write_id={write_id}")
    return sorted({write_id for _, write_id in old})


def cache_info(spark: SparkSession, store: str) -> DataFrame:
    """One row: documents, bytes of text and vectors, and the same in MB with two digits."""
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return read_meta(spark, store).agg(
        F.count("*").alias("num_cached_documents"),
        total.alias("total_size_bytes"),
        F.round(total / (1024 * 1024), 2).alias("total_size_mb"),
    )
