"""Chunks, embeddings and their store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import WS, table
from rowloom.operators.chunks import chunk_documents, concat_chunks, distinct_chunks, raw_context
from rowloom.operators.embed import (
    cache_info, commits, compact, embed_documents, embed_missing, get_cached, has_cached, hashing_encoder, read_meta, vacuum,
)
from rowloom.session import new_folder
from rowloom.sources.documents import content_hash

ENCODER = hashing_encoder(64)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: ``(doc_id, lang, path, content_hash, text)``."""
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", path.alias("path"), content_hash(F.encode("text", "UTF-8")).alias("content_hash"), "text"
    )


def _chunks(kind: str, distinct: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk_documents(texts(spark, sf_dir), kind, distinct=distinct)

    return query


def chunks_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_chunks(chunk_documents(texts(spark, sf_dir), "sentence", distinct=False))


def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_context(texts(spark, sf_dir))


def stored_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from chunk rows, as they come out of a store."""
    return concat_chunks(chunk_documents(texts(spark, sf_dir), "line"))


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_documents(texts(spark, sf_dir), ENCODER).select(
        "doc_id", "chunk_ord", F.array_join(F.transform("embedding", lambda x: x.cast("int")), " ").alias("vector")
    )


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "content_hash")


def _english_store(spark: SparkSession, sf_dir: str) -> str:
    """A store that holds the English documents (and so their copies in any language folder)."""
    store = new_folder(spark, "store")
    embed_missing(files(spark, sf_dir).where(F.col("lang") == "en"), store, ENCODER, "hashing")
    return store


def cache_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_folder(spark, "store")
    embed_missing(files(spark, sf_dir), store, ENCODER, "hashing")
    return read_meta(spark, store).select(
        "content_hash", "file_path", "file_name", "num_chunks", "dimension", "model_name", "chunk_type",
        "min_chunk_length", "size_bytes",
    )


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _english_store(spark, sf_dir)
    return has_cached(files(spark, sf_dir).select("doc_id", "content_hash"), store)


def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _english_store(spark, sf_dir)
    found = get_cached(files(spark, sf_dir).select("doc_id", "content_hash"), store)
    return found.select("doc_id", "chunk_ord", "chunk", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("words"))


def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run over all documents adds to a store of the English ones; a third adds nothing."""
    store = _english_store(spark, sf_dir)
    second = embed_missing(files(spark, sf_dir), store, ENCODER, "hashing")
    third = embed_missing(files(spark, sf_dir), store, ENCODER, "hashing")
    added = read_meta(spark, store).where(F.col("write_id").isin(second, third))
    return added.select(
        "content_hash", "num_chunks", F.when(F.col("write_id") == second, F.lit(2)).otherwise(F.lit(3)).alias("run")
    )


def cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_folder(spark, "store")
    embed_missing(files(spark, sf_dir), store, ENCODER, "hashing")
    return cache_info(spark, store)


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes brought into one: what each content's entry says, and how many chunks of it are read."""
    store = _english_store(spark, sf_dir)
    embed_missing(files(spark, sf_dir), store, ENCODER, "hashing")
    whole = compact(store, spark)
    vacuum(store, spark)
    entries = read_meta(spark, store).withColumn("whole", F.col("write_id") == whole)
    read = get_cached(entries.select("content_hash"), store).groupBy("content_hash").agg(F.count("*").cast("int").alias("read_chunks"))
    return entries.join(read, "content_hash").select("content_hash", "num_chunks", "size_bytes", "whole", "read_chunks")


def store_broken_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store in which a second write broke off before its commit: only the first one's contents count."""
    store = _english_store(spark, sf_dir)
    others = embed_documents(files(spark, sf_dir).where("lang <> 'en'").select("path", "content_hash", "text"), ENCODER)
    lost = others.select("content_hash", "chunk_ord", "chunk", "embedding", F.substring("content_hash", 1, 1).alias("digit"))
    lost.withColumn("write_id", F.lit("lost")).write.mode("append").partitionBy("digit", "write_id").parquet(f"{store}/parts")
    meta = read_meta(spark, store).withColumns({"write_id": F.lit("lost"), "content_hash": F.reverse("content_hash")})
    meta.write.mode("append").parquet(f"{store}/meta")
    vacuum(store, spark)
    probed = has_cached(files(spark, sf_dir).select("doc_id", "content_hash"), store)
    return probed.select("doc_id", "cached", F.lit(commits(spark, store).count()).alias("commits"))


QUERIES = {
    "store_compacted": store_compacted,
    "store_broken_write": store_broken_write,
    "chunks_sentence": _chunks("sentence"),
    "chunks_line": _chunks("line"),
    "chunks_paragraph": _chunks("paragraph"),
    "chunks_block": _chunks("block"),
    "chunks_sentence_all": _chunks("sentence", distinct=False),
    "chunks_distinct": chunks_distinct,
    "chunk_context": chunk_context,
    "stored_context": stored_context,
    "embed_chunks": embed_chunks,
    "content_hashes": content_hashes,
    "cache_write": cache_write,
    "cache_probe": cache_probe,
    "cache_read": cache_read,
    "embed_incremental": embed_incremental,
    "cache_totals": cache_totals,
}


def sql_pieces(pattern: str, least: int = 10, source: str = "SELECT doc_id, text FROM documents") -> str:
    """``(doc_id, pos, chunk)``: stripped pieces longer than ``least``, in order, repeats kept."""
    return f"""
        SELECT doc_id, pos, chunk
        FROM (SELECT doc_id, generate_subscripts(pieces, 1) AS pos, trim(unnest(pieces), {WS}) AS chunk
              FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS pieces FROM ({source})))
        WHERE len(chunk) > {least}"""


def sql_distinct(pieces: str) -> str:
    """``(doc_id, chunk_ord, chunk)``: each chunk once, numbered from 0 by first position."""
    return f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INTEGER) AS chunk_ord, chunk
        FROM ({pieces}) GROUP BY doc_id, chunk"""


SENTENCES = sql_pieces("[.!?]+")
SENTENCE_CHUNKS = sql_distinct(SENTENCES)

_PARAGRAPHS = f"""
    SELECT doc_id, p * 1000000 + pos AS pos, chunk
    FROM (SELECT doc_id, p, generate_subscripts(pieces, 1) AS pos, trim(unnest(pieces), {WS}) AS chunk
          FROM (SELECT doc_id, p, regexp_split_to_array(paragraph, '[.!?]+') AS pieces
                FROM (SELECT doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS paragraph
                      FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM documents))))
    WHERE len(chunk) > 10"""

#: Chunks with their hashed word counts as a list of doubles.
EMBEDDED = f"""
    SELECT doc_id, chunk_ord, chunk,
           list_transform(range(64), lambda i: CAST(len(list_filter(buckets, lambda b: b = i)) AS DOUBLE)) AS vector
    FROM (SELECT *, list_transform(regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{N}}]+'),
                 lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64) AS buckets
          FROM ({SENTENCE_CHUNKS}))"""

#: Per content: its hash, first path, and number of chunks and bytes, if it has any chunk.
_CONTENTS = f"""
    WITH firsts AS (
        SELECT text, sha256(text) AS content_hash, min('docs/' || doc_id || '.txt') AS file_path, min(doc_id) AS doc_id,
               bool_or(lang = 'en') AS english
        FROM documents GROUP BY text),
    counted AS (
        SELECT doc_id, CAST(count(*) AS INTEGER) AS num_chunks,
               CAST(sum(octet_length(encode(chunk)) + 256) AS BIGINT) AS size_bytes
        FROM ({SENTENCE_CHUNKS}) GROUP BY doc_id)
    SELECT f.*, c.num_chunks, c.size_bytes FROM firsts f JOIN counted c USING (doc_id)"""

SQL = {
    "store_compacted": f"""
        SELECT content_hash, num_chunks, size_bytes, true AS whole, num_chunks AS read_chunks FROM ({_CONTENTS})""",
    "store_broken_write": f"""
        SELECT d.doc_id, coalesce(c.english, false) AS cached, CAST(1 AS BIGINT) AS commits
        FROM documents d LEFT JOIN ({_CONTENTS}) c USING (text)""",
    "chunks_sentence": SENTENCE_CHUNKS,
    "chunks_line": sql_distinct(sql_pieces("\\n")),
    "chunks_paragraph": sql_distinct(_PARAGRAPHS),
    "chunks_block": f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_ord, chunk
        FROM ({sql_pieces(chr(10) * 2, 0)})""",
    "chunks_sentence_all": f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_ord, chunk
        FROM ({SENTENCES})""",
    "chunks_distinct": f"""
        SELECT doc_id, min(chunk_ord) AS chunk_ord, chunk
        FROM (SELECT doc_id, chunk,
                     CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS chunk_ord
              FROM ({SENTENCES}))
        GROUP BY doc_id, chunk""",
    "chunk_context": f"""
        SELECT d.doc_id, coalesce(c.context, '') AS context
        FROM documents d LEFT JOIN (
            SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_ord) AS context
            FROM ({SENTENCE_CHUNKS}) GROUP BY doc_id) c USING (doc_id)""",
    "stored_context": f"""
        SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY chunk_ord) AS context
        FROM ({sql_distinct(sql_pieces(chr(10)))}) GROUP BY doc_id""",
    "embed_chunks": f"""
        SELECT doc_id, chunk_ord, array_to_string(list_transform(vector, lambda x: CAST(x AS INTEGER)), ' ') AS vector
        FROM ({EMBEDDED})""",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "cache_write": f"""
        SELECT content_hash, file_path, regexp_extract(file_path, '[^/]+$') AS file_name, num_chunks, 64 AS dimension,
               'hashing' AS model_name, 'sentence' AS chunk_type, 10 AS min_chunk_length, size_bytes
        FROM ({_CONTENTS})""",
    "cache_probe": f"""
        SELECT d.doc_id, sha256(d.text) AS content_hash, coalesce(c.english, false) AS cached
        FROM documents d LEFT JOIN ({_CONTENTS}) c USING (text)""",
    "cache_read": f"""
        SELECT e.doc_id, e.chunk_ord, e.chunk, list_sum(e.vector) AS words
        FROM ({EMBEDDED}) e JOIN documents d USING (doc_id) JOIN ({_CONTENTS}) c USING (text)
        WHERE c.english""",
    "embed_incremental": f"SELECT content_hash, num_chunks, 2 AS run FROM ({_CONTENTS}) WHERE NOT english",
    "cache_totals": f"""
        SELECT count(*) AS num_cached_documents, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
               round(sum(size_bytes) / 1048576.0, 2) AS total_size_mb
        FROM ({_CONTENTS})""",
}
