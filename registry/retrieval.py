"""Similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import WS, sql_filled, table
from registry.documents import EMBEDDED, ENCODER, SENTENCE_CHUNKS, texts
from registry.rows import sql_cell, sql_prompt
from rowloom.functions.vectors import cosine, norm
from rowloom.operators.chunks import chunk_documents
from rowloom.operators.embed import embed_documents
from rowloom.operators.retrieve import (
    Limits, chunks_per_row, context_text, find_relevant_chunks, first_chunks, source_label, top_k, with_context,
)
from rowloom.plans.enrich import generate_columns
from rowloom.plans.scale import salted_join
from rowloom.session import new_folder, written

#: Sizes so small that the plan for two large sides runs on test data too.
_LARGE = Limits(broadcast_rows=0, broadcast_queries=0, block_chunks=256, block_queries=128)


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the first one of its label."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("size", norm(F.col("embedding")))
    firsts = vectors.groupBy("label").agg(F.min_by(F.struct("embedding", "size"), "vec_id").alias("first"))
    score = cosine(F.col("embedding"), F.col("first.embedding"), F.col("size"), F.col("first.size"))
    # A label may hold most vectors.
    joined = salted_join(vectors, written(firsts, "label-firsts"), "label", "inner")
    return joined.select("vec_id", "label", F.round(score, 6).alias("score"))


def _top(spark: SparkSession, sf_dir: str, limits: Limits) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    chunks = vectors.select(F.col("label").alias("doc_ord"), F.col("vec_id").alias("chunk_ord"), "embedding")
    hits = top_k(queries, chunks, k=5, limits=limits)
    return hits.withColumn("score", F.round("score", 6))


def top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, Limits())


def top_chunks_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with floors and parts of queries, the plan for two large sides."""
    return _top(spark, sf_dir, _LARGE)


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "line")
    path = F.concat(F.lit("a/b/"), F.col("source"), F.lit(".md"))
    return chunks.select("doc_id", "chunk_ord", source_label(path, F.col("chunk")).alias("label"))


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(texts(spark, sf_dir)).select(
        F.col("doc_id").alias("doc_ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_name"),
        "chunk_ord", "chunk",
    )


def fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _document_chunks(spark, sf_dir)
    found = first_chunks(chunks, k=25)
    return found.select("rank", source_label(F.col("doc_name"), F.col("chunk")).alias("label"))


def _stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = embed_documents(texts(spark, sf_dir), ENCODER)
    return written(
        embedded.select(
            F.col("doc_id").alias("doc_ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_name"),
            "chunk_ord", "chunk", "embedding",
        ),
        "chunks",
    )


def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 chunks nearest to each benchmark text."""
    queries = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return find_relevant_chunks(queries, _stored_chunks(spark, sf_dir), ENCODER)


def _asking_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as rows of two cells; the second cell has several lines, or is blank or null."""
    item = F.col("item_id")
    lines = F.regexp_replace("text", "[.] *", "\n")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("row_id"),
        F.when(item % 4 == 0, F.lit("null")).otherwise(F.split("text", "[.]", 2)[0]).alias("title"),
        F.when(item % 3 == 0, F.lit(" \n ")).otherwise(lines).alias("body"),
    )


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _asking_rows(spark, sf_dir)
    return rows, chunks_per_row(rows, _stored_chunks(spark, sf_dir), ["title", "body"], ENCODER, "row_id")


def row_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _found(spark, sf_dir)
    return found.select("row_id", F.posexplode("chunks").alias("place", "label"))


def row_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = _found(spark, sf_dir)
    prompts = with_context(rows.select("row_id"), found, "row_id")
    plain = found.select("row_id", context_text(F.col("chunks"), "plain").alias("plain"))
    return prompts.join(plain, "row_id", "left").select("row_id", "context", F.coalesce("plain", F.lit("")).alias("plain"))


def _measure():
    def generate(requests):
        return [{"text": f"new_value: {len(r['prompt'])}"} for r in requests]

    return generate


def generated_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the chunks they ask for and an example in their prompts; replies to other instructions lie in the store already."""
    rows, chunks, path = _asking_rows(spark, sf_dir), _stored_chunks(spark, sf_dir), new_folder(spark, "replies")

    def answered(instructions: str) -> DataFrame:
        definition = {"headers": ["Answer", "long"], "instructions": instructions, "example": "Row 1: yes"}
        return generate_columns(rows, ["title", "body"], [definition], _measure, path=path, chunks=chunks, load_encoder=ENCODER)

    answered("Say it in one word.").count()
    return answered("Answer what the row asks for.")


QUERIES = {
    "generated_with_context": generated_with_context,
    "cosine_scores": cosine_scores,
    "top_chunks": top_chunks,
    "top_chunks_large": top_chunks_large,
    "source_labels": source_labels,
    "fallback_chunks": fallback_chunks,
    "relevant_chunks": relevant_chunks,
    "row_chunks": row_chunks,
    "row_context": row_context,
}

_DOUBLES = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"

_TOP = f"""
    SELECT query_id, doc_ord, chunk_ord, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_ord, chunk_ord) AS rank
          FROM (SELECT q.vec_id AS query_id, CAST(c.label AS BIGINT) AS doc_ord, c.vec_id AS chunk_ord,
                       round(list_cosine_similarity(q.v, c.v), 9) AS score
                FROM ({_DOUBLES}) q CROSS JOIN ({_DOUBLES}) c))
    WHERE rank <= 5"""


def _sql_hits(queries: str, k: int) -> str:
    """The k best sentence chunks ``(query_id, rank, label)`` for queries ``(query_id, text)``."""
    vector = """list_transform(range(64), lambda i: CAST(len(list_filter(buckets, lambda b: b = i)) AS DOUBLE))"""
    return f"""
        SELECT query_id, CAST(rank AS INTEGER) AS rank, '[d' || doc_id || '] ' || chunk AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_ord) AS rank
              FROM (SELECT q.query_id, c.doc_id, c.chunk_ord, c.chunk,
                           CASE WHEN q.size * c.size > 0
                                THEN round(list_inner_product(q.vector, c.vector) / (q.size * c.size), 9)
                                ELSE 0 END AS score
                    FROM (SELECT query_id, vector, sqrt(list_inner_product(vector, vector)) AS size
                          FROM (SELECT query_id, {vector} AS vector
                                FROM (SELECT query_id, list_transform(
                                          regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'),
                                          lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64) AS buckets
                                      FROM ({queries})))) q
                    CROSS JOIN (SELECT *, sqrt(list_inner_product(vector, vector)) AS size FROM ({EMBEDDED})) c))
        WHERE rank <= {k}"""


_ROWS = """
    SELECT item_id AS row_id, CASE WHEN item_id % 4 = 0 THEN 'null' ELSE regexp_extract(text, '^[^.]*') END AS title,
           CASE WHEN item_id % 3 = 0 THEN ' ' || chr(10) || ' ' ELSE regexp_replace(text, '[.] *', chr(10), 'g') END AS body
    FROM benchmark"""

_LINES = f"""
    SELECT * FROM (
        SELECT row_id, col_ord, generate_subscripts(string_split(cell, chr(10)), 1) AS line_ord,
               trim(unnest(string_split(cell, chr(10))), {WS}) AS line
        FROM (SELECT row_id, 0 AS col_ord, title AS cell FROM ({_ROWS})
              UNION ALL SELECT row_id, 1, body FROM ({_ROWS}))
        WHERE trim(cell, {WS}) NOT IN ('', 'null'))
    WHERE line <> ''"""

_ROW_CHUNKS = f"""
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY min(place)) - 1 AS place, label
    FROM (SELECT l.row_id, h.label, col_ord * 100000000 + line_ord * 1000 + rank AS place
          FROM ({_LINES}) l JOIN ({_sql_hits(f"SELECT DISTINCT line AS query_id, line AS text FROM ({_LINES})", 5)}) h
               ON l.line = h.query_id)
    GROUP BY row_id, label"""

_CONTEXT = f"""
    SELECT r.row_id, any_value(r.title) AS title, any_value(r.body) AS body,
           coalesce(chr(10) || chr(10) || 'Relevant context from documents:' || chr(10) || string_agg(c.label, chr(10) ORDER BY c.place), '') AS context
    FROM ({_ROWS}) r LEFT JOIN ({_ROW_CHUNKS}) c USING (row_id) GROUP BY r.row_id"""

_ASKING_PAYLOAD = (
    f"""'{{' || chr(10) || '  "title": ' || {sql_cell('title')} || ',' || chr(10) || '  "body": ' || {sql_cell('body')}"""
    " || chr(10) || '}'"
)

SQL = {
    "generated_with_context": f"""
        SELECT row_id, title, body, CASE WHEN {sql_filled('title')} OR {sql_filled('body')}
               THEN CAST(len({sql_prompt(_ASKING_PAYLOAD, "'Answer what the row asks for.'", 'context', "'Row 1: yes'")}) AS VARCHAR)
               ELSE '' END AS "Answer - long"
        FROM ({_CONTEXT})""",
    "cosine_scores": f"""
        WITH v AS ({_DOUBLES}), firsts AS (SELECT label, arg_min(v, vec_id) AS f FROM v GROUP BY label)
        SELECT vec_id, label, round(list_cosine_similarity(v, f), 6) AS score FROM v JOIN firsts USING (label)""",
    "top_chunks": _TOP,
    "top_chunks_large": _TOP,
    "source_labels": f"""
        SELECT c.doc_id, c.chunk_ord, '[' || d.source || '.md] ' || c.chunk AS label
        FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS INTEGER) AS chunk_ord, chunk
              FROM (SELECT doc_id, generate_subscripts(ls, 1) AS pos, trim(unnest(ls), {WS}) AS chunk
                    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
              WHERE len(chunk) > 10 GROUP BY doc_id, chunk) c
        JOIN documents d USING (doc_id)""",
    "fallback_chunks": f"""
        SELECT CAST(row_number() OVER (ORDER BY doc_id, chunk_ord) AS INTEGER) AS rank,
               '[d' || doc_id || '] ' || chunk AS label
        FROM ({SENTENCE_CHUNKS}) WHERE chunk_ord < 5 ORDER BY doc_id, chunk_ord LIMIT 25""",
    "relevant_chunks": _sql_hits("SELECT item_id AS query_id, text FROM benchmark", 25),
    "row_chunks": f"SELECT row_id, CAST(place AS INTEGER) AS place, label FROM ({_ROW_CHUNKS})",
    "row_context": f"""
        SELECT r.row_id,
               coalesce(chr(10) || chr(10) || 'Relevant context from documents:' || chr(10)
                        || string_agg(c.label, chr(10) ORDER BY c.place), '') AS context,
               coalesce(string_agg(c.label, chr(10) || chr(10) ORDER BY c.place), '') AS plain
        FROM ({_ROWS}) r LEFT JOIN ({_ROW_CHUNKS}) c USING (row_id) GROUP BY r.row_id""",
}
