"""Exact top-k chunks by cosine similarity.

No plan here builds all pairs as rows: scores exist only inside a task, as blocks of a matrix
product, and at most k rows per query leave a block. Which plan runs depends on checked sizes:

* few chunks: their matrix is broadcast, and queries are scored where they are;
* few queries: they are broadcast, and every task sends k candidates per query;
* both large: a sample of the chunks gives every query a floor that its k best reach, queries are
  broadcast part by part, and chunks are scored where they are (see ``_through_parts``).

Ranking is by score (rounded to nine digits, finer than the float32 vectors), then by the
place of the chunk: ``doc_ord``, ``chunk_ord``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.names import all_named
from rowloom.functions.text import strip
from rowloom.operators.embed import Encoder, encode_column
from rowloom.plans.scale import salted_join, spread_small
from rowloom.session import new_folder, written

# Chunks per query by default, chunks per line of a cell, chunks per document without vectors.
DEFAULT_TOP_K = 25
LINE_TOP_K = 5
FALLBACK_PER_DOCUMENT = 5
CONTEXT_LEAD = "\n\nRelevant context from documents:\n"

SCORE_DIGITS = 9


@dataclass(frozen=True)
class Limits:
    """Sizes that choose the plan."""

    #: Chunks, or queries, that may be broadcast; with ``broadcast_bytes`` the tighter one counts.
    broadcast_rows: int = 200_000
    broadcast_queries: int = 20_000
    broadcast_bytes: int = 128 << 20
    #: Chunks that are scored at a time, and queries that are broadcast together where both sides are large.
    block_chunks: int = 8_192
    block_queries: int = 20_000
    #: Chunks whose scores give every query its first floor. Their matrix travels with the tasks.
    pivots: int = 8_192


def source_label(path: Column, chunk: Column) -> Column:
    """``[file name] chunk``."""
    return F.concat(F.lit("["), F.substring_index(path, "/", -1), F.lit("] "), chunk)


def top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_TOP_K,
    query_id: str = "query_id",
    limits: Limits = Limits(),
) -> DataFrame:
    """``(query_id, doc_ord, chunk_ord, score, rank)`` for queries ``(query_id, embedding)``
    and chunks ``(doc_ord, chunk_ord, embedding)``.

    The chunks are counted first, so pass a table that is stored. Chunks without a vector
    take no part.
    """
    queries = queries.select(query_id, "embedding").where(F.col("embedding").isNotNull())
    chunks = chunks.select(
        F.col("doc_ord").cast("long"), F.col("chunk_ord").cast("long"), "embedding"
    ).where(F.col("embedding").isNotNull())
    schema = T.StructType([
        queries.schema[query_id],
        T.StructField("doc_ord", T.LongType()),
        T.StructField("chunk_ord", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ])
    n_chunks = chunks.count()
    if n_chunks <= limits.broadcast_rows and _fits(chunks, limits):
        return _chunks_broadcast(queries, chunks, k, query_id, schema)
    queries = written(queries, "query-vectors")
    n_queries = queries.count()
    if n_queries <= limits.broadcast_queries and _fits(queries, limits):
        found = _queries_broadcast(queries, chunks, k, query_id, schema)
    else:
        found = _through_parts(queries, chunks, k, query_id, schema, limits, n_queries)
    return _best(found, k, query_id)


def _best(found: DataFrame, k: int, query_id: str) -> DataFrame:
    window = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_ord", "chunk_ord")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _fits(side: DataFrame, limits: Limits, row_bytes: Column | None = None) -> bool:
    """Whether a side of few rows is also small enough in bytes to be broadcast."""
    each = F.lit(8) * F.coalesce(F.size("embedding"), F.lit(0)) if row_bytes is None else row_bytes
    return (side.agg(F.sum(each)).first()[0] or 0) <= limits.broadcast_bytes


# --- inside a task -----------------------------------------------------------------------------


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows of a matrix, in the precision they are stored in."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], flat.type)
    count = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if values.dtype not in (np.float32, np.float64):
        values = values.astype(np.float64)
    return values.reshape(count, -1 if count else 0)


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def _norms_and_units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norms of the rows, and the rows divided by them in single precision; some rows at a time are held in double precision."""
    norms, unit = np.zeros(len(matrix)), np.zeros(matrix.shape, dtype=np.float32)
    for start in range(0, len(matrix), _COLUMNS):
        some = matrix[start : start + _COLUMNS].astype(np.float64)
        norms[start : start + _COLUMNS] = _norms(some)
        each = norms[start : start + _COLUMNS, None]
        unit[start : start + _COLUMNS] = np.divide(some, each, out=np.zeros_like(some), where=each > 0)
    return norms, unit


#: Queries and chunks of one matrix product; candidates that are scored exactly at a time.
_ROWS, _COLUMNS, _CANDIDATES = 512, 8_192, 65_536


def _block_top_k(
    queries: _Side, chunks: _Side, k: int, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, chunk numbers and scores of the k best chunks per query.

    The chunks are in ranking order. Scores below a query's floor are left out. Products in
    single precision pick the candidates: what their rounding error could hide is let through, and
    every candidate is scored in double precision.
    """
    dimension = chunks.matrix.shape[1]
    slack = 4 * (dimension + 4) * 2.0**-24 + 2 * 10.0**-SCORE_DIGITS
    found = []
    for start in range(0, len(queries.matrix), _ROWS):
        unit = queries.unit[start : start + _ROWS]
        floor = np.full(len(unit), -np.inf) if floors is None else floors[start : start + _ROWS].copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for left in range(0, len(chunks.matrix), _COLUMNS):
            scores = unit @ chunks.unit[left : left + _COLUMNS].T
            width = scores.shape[1]
            open_rows = np.flatnonzero(~np.isfinite(floor))
            least = floor.copy()
            if len(open_rows) and width > k:
                least[open_rows] = np.partition(scores[open_rows], width - k, axis=1)[:, width - k]
            hits = np.flatnonzero(scores >= (least - slack).astype(np.float32)[:, None])
            for piece in range(0, len(hits), _CANDIDATES):
                rows, columns = np.divmod(hits[piece : piece + _CANDIDATES], width)
                columns += left
                exact = _exact(queries, rows + start, chunks, columns)
                keep = exact >= floor[rows]
                best = _k_best([*zip(best, (rows[keep], columns[keep], exact[keep]))], k, floor)
        found.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _exact(queries: _Side, rows: np.ndarray, chunks: _Side, columns: np.ndarray) -> np.ndarray:
    product = np.einsum("ij,ij->i", queries.matrix[rows].astype(np.float64), chunks.matrix[columns].astype(np.float64))
    scale = queries.norms[rows] * chunks.norms[columns]
    return np.round(np.divide(product, scale, out=np.zeros_like(product), where=scale > 0), SCORE_DIGITS)


def _k_best(parts: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray):
    """The k best of both parts per row, best first; raises the floors of rows that have k."""
    rows, columns, scores = (np.concatenate(part) for part in parts)
    order = np.lexsort((columns, -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    last = place == k - 1
    floor[rows[last]] = np.maximum(floor[rows[last]], scores[last])
    keep = place < k
    return rows[keep], columns[keep], scores[keep]


_PLACE = ("doc_ord", "chunk_ord")


class _Side:
    """Vectors of one side as stored and as units, with their norms and identifying columns."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, names: Sequence[str], copies: int | None = None):
        """``copies`` keeps the rows of ``_ranking_order``."""
        if copies is not None:
            rows = _ranking_order(rows, names, copies)
        self.matrix = _matrix(rows.column("embedding"))
        self.ids = {name: rows.column(name) for name in names}
        self.norms, self.unit = _norms_and_units(self.matrix)


def _ranking_order(rows: pa.Table | pa.RecordBatch, names: Sequence[str], copies: int) -> pa.Table | pa.RecordBatch:
    """The rows in the order of ``names``, and so many of equal vectors: a copy after k others in front of it is
    never among the k best."""
    rows = rows.take(pc.sort_indices(rows, [(name, "ascending") for name in names]))
    if len(rows) > copies:
        kept = np.flatnonzero(_copy_number(_matrix(rows.column("embedding"))) < copies)
        if len(kept) < len(rows):
            rows = rows.take(pa.array(kept))
    return rows


def _copy_number(matrix: np.ndarray) -> np.ndarray:
    """How many equal rows come before each row.

    Rows are sorted by a hash and held against the one before; if the hashes of different rows agree, some copies count as rows of
    their own, which keeps more of them than needed.
    """
    flat = np.ascontiguousarray(matrix)
    parts = flat.view(np.uint32)
    odd = np.random.default_rng(1).integers(0, 1 << 62, parts.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    name = np.zeros(len(flat), dtype=np.uint64)
    for start in range(0, len(flat), _COLUMNS):
        some = (parts[start : start + _COLUMNS] + np.uint64(1)) * odd
        name[start : start + _COLUMNS] = (some ^ (some >> np.uint64(29))).sum(axis=1, dtype=np.uint64)
    order = np.argsort(name, kind="stable")
    fresh = np.ones(len(order), dtype=bool)
    for start in range(1, len(order), _COLUMNS):
        ends = order[start : start + _COLUMNS]
        fresh[start : start + len(ends)] = (parts[ends] != parts[order[start - 1 : start - 1 + len(ends)]]).any(axis=1)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order)) - first
    return number


def _score(queries: _Side, chunks: _Side, k: int, floors: np.ndarray | None = None) -> pa.Table:
    """The k best chunks of this block for every query, best first within a query."""
    rows = columns = np.zeros(0, dtype=np.int64)
    scores = np.zeros(0)
    if len(queries.matrix) and len(chunks.matrix):
        rows, columns, scores = _block_top_k(queries, chunks, k, floors)
    out = {name: values.take(pa.array(rows)) for name, values in queries.ids.items()}
    out.update({name: values.take(pa.array(columns)) for name, values in chunks.ids.items()})
    return pa.table({**out, "score": scores})


def _ranks(found: pa.Table, query_id: str) -> np.ndarray:
    """Rank within a query, from 1, for rows that are grouped by query and in order."""
    if not len(found):
        return np.zeros(0, dtype=np.int32)
    ids = found.column(query_id).combine_chunks()
    starts = np.r_[True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)]
    at = np.arange(len(found))
    return (at - np.maximum.accumulate(np.where(starts, at, 0)) + 1).astype(np.int32)


# --- plans -------------------------------------------------------------------------------------


def _chunks_broadcast(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, schema) -> DataFrame:
    """Every query meets all chunks in its own task: no shuffle, and ranks are final.

    Chunks are put in order and copies dropped before they are sent, so a task holds them as they came and as units, in single precision.
    """
    shared = queries.sparkSession.sparkContext.broadcast(_ranking_order(chunks.toArrow().combine_chunks(), _PLACE, k))
    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(shared.value, _PLACE)
        for batch in batches:
            best = _score(_Side(batch, [query_id]), side, k)
            yield from best.append_column("rank", pa.array(_ranks(best, query_id))).to_batches()

    return spread_small(queries).mapInArrow(run, ranked)


def _queries_broadcast(
    queries: DataFrame, chunks: DataFrame, k: int, query_id: str, schema, block: int | None = None
) -> DataFrame:
    """Every task keeps the k best of its chunks per query; only these are shuffled.

    Queries may bring a ``floor``: chunks that score less are left out.
    """
    shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        numbers = pa.array(np.arange(len(asked)))
        side = _Side(asked.append_column("_query", numbers), ["_query"])
        floors = np.full(len(asked), -np.inf)
        if "floor" in asked.column_names:
            floors = asked.column("floor").fill_null(-np.inf).to_numpy().copy()
        best, fresh, fresh_rows = None, [], 0
        for whole in batches:
            for batch in (whole.slice(i, block) for i in range(0, len(whole), block)) if block else (whole,):
                fresh.append(_score(side, _Side(batch, _PLACE, copies=k), k, floors))
                fresh_rows += len(fresh[-1])
                # Merging is put off until it halves the rows; a query's k-th score then sorts out most of what follows.
                if best is None or fresh_rows >= len(best):
                    best = _trim(pa.concat_tables(([best] if best else []) + fresh), k, floors)
                    fresh, fresh_rows = [], 0
        if fresh:
            best = _trim(pa.concat_tables(([best] if best else []) + fresh), k, floors)
        if best is not None:
            found = asked.column(query_id).take(best.column("_query"))
            yield from best.set_column(0, query_id, found).to_batches()

    return spread_small(chunks).mapInArrow(run, schema)


def _trim(found: pa.Table, k: int, floors: np.ndarray) -> pa.Table:
    """The k best rows per query; raises the floors of the queries that have k."""
    order = [("_query", "ascending"), ("score", "descending"), ("doc_ord", "ascending"), ("chunk_ord", "ascending")]
    found = found.take(pc.sort_indices(found, order))
    ranks = _ranks(found, "_query")
    last = found.filter(pa.array(ranks == k))
    floors[last.column("_query").to_numpy()] = last.column("score").to_numpy()
    return found.filter(pa.array(ranks <= k))


#: Queries of several blocks go to the chunks together up to so many bytes, as every part reads all chunks.
_PART_BYTES = 32 << 20


def _through_parts(
    queries: DataFrame, chunks: DataFrame, k: int, query_id: str, schema, limits: Limits, n_queries: int
) -> DataFrame:
    """Both sides are large: chunks stay where they are, queries come to them part by part, with floors.

    A sample of ``limits.pivots`` chunks is scored against every query first. The k-th score there is a floor that the k best of
    all chunks reach, so a task gives back only chunks that reach it: of n chunks about k * n / ``pivots`` per query over all
    tasks, instead of k per query from every task. The result is exact, as every chunk meets every query as
    a row of a matrix product. Neither chunks nor queries are shuffled by key; only the rows that reach a floor are.

    A part holds ``limits.block_queries`` queries, or more where ``_PART_BYTES`` hold them, and no more bytes than may be broadcast. Few chunks
    are spread over the cores once, not for every part: what the parts read is never shuffled.
    """
    spread = spread_small(chunks)
    chunks = chunks if spread is chunks else written(spread, "chunk-vectors")
    picked = chunks.withColumn("at", F.xxhash64("doc_ord", "chunk_ord")).orderBy("at").limit(limits.pivots).drop("at")
    floored = _with_floors(queries, _first_copies(picked, k), k, query_id)
    size = queries.agg(F.sum(F.lit(8) * F.size("embedding"))).first()[0] or 0
    blocks = min(-(-n_queries // max(1, limits.block_queries)), -(-size // _PART_BYTES))
    parts = max(1, blocks, -(-size // limits.broadcast_bytes))
    asked, found = new_folder(queries.sparkSession, "asked"), new_folder(queries.sparkSession, "found")
    part = F.pmod(F.xxhash64(query_id), F.lit(parts)).alias("part")
    floored.select("*", part).write.partitionBy("part").parquet(asked)
    spark = queries.sparkSession
    stored = spark.read.schema(T.StructType([*floored.schema.fields, T.StructField("part", T.LongType())])).parquet(asked)
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{found}/part=-1")
    for number in range(parts):
        some = stored.where(F.col("part") == number).drop("part")
        _queries_broadcast(some, chunks, k, query_id, schema, limits.block_chunks).write.parquet(f"{found}/part={number}")
    return spark.read.schema(schema).parquet(found).select(*schema.names)


def _with_floors(queries: DataFrame, sample: DataFrame, k: int, query_id: str) -> DataFrame:
    """Adds ``floor``: the k-th best score among the sample, null where it has fewer chunks."""
    shared = queries.sparkSession.sparkContext.broadcast(sample.toArrow())
    schema = T.StructType([*queries.schema.fields, T.StructField("floor", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(shared.value, _PLACE, copies=k)
        for batch in batches:
            numbers = pa.array(np.arange(len(batch)))
            best = _score(_Side(batch.append_column("_query", numbers), ["_query"]), side, k)
            last = best.filter(pa.array(_ranks(best, "_query") == k))
            floors = np.full(len(batch), np.nan)
            floors[last.column("_query").to_numpy()] = last.column("score").to_numpy()
            yield batch.append_column("floor", pa.array(floors, from_pandas=True))

    return queries.mapInArrow(run, schema)


def _first_copies(chunks: DataFrame, k: int) -> DataFrame:
    """The first k chunks of every distinct vector; each task drops most copies before the shuffle."""
    same = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy(*_PLACE)
    return chunks.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")


# --- what the rows of a table ask ----------------------------------------------------------------


def first_chunks(chunks: DataFrame, k: int = DEFAULT_TOP_K, per_document: int = FALLBACK_PER_DOCUMENT) -> DataFrame:
    """Without vectors: the first chunks of each document, in document order, until there are k.

    Chunks are ``(doc_ord, chunk_ord, …)``; adds ``rank``. Only the k leading rows reach one task.
    """
    by_document = Window.partitionBy("doc_ord").orderBy("chunk_ord")
    leading = chunks.withColumn("_n", F.row_number().over(by_document)).where(F.col("_n") <= per_document).drop("_n")
    best = leading.orderBy("doc_ord", "chunk_ord").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("doc_ord", "chunk_ord")))


def find_relevant_chunks(
    queries: DataFrame,
    chunks: DataFrame,
    load_encoder: Callable[[], Encoder],
    k: int = DEFAULT_TOP_K,
    query_id: str = "query_id",
    text: str = "text",
    strict_fallback: bool = False,
    limits: Limits = Limits(),
) -> DataFrame:
    """The k best chunks ``(query_id, rank, label)`` for each query text; blank queries get none.

    Chunks are ``(doc_ord, doc_name, chunk_ord, chunk, embedding)``. Documents without any vector
    are left out of the ranking; where no document has one, every query gets the first chunks.
    With ``strict_fallback`` one document without vectors is enough for that.
    """
    asked = queries.where(F.length(strip(F.col(text))) > 0)
    state = chunks.agg(
        F.count_if(F.col("embedding").isNull()).alias("without"), F.count("embedding").alias("with_vector")
    ).first()
    label = source_label(F.col("doc_name"), F.col("chunk")).alias("label")
    if state["with_vector"] == 0 or (strict_fallback and state["without"]):
        fallback = first_chunks(chunks, k).select("rank", label)
        packed = [(r["rank"], r["label"]) for r in fallback.collect()]
        return _same_for_all(asked, packed, query_id)
    vectors = encode_column(asked.select(query_id, text), load_encoder, text)
    hits = top_k(vectors, chunks, k, query_id, limits)
    return _labelled(hits, chunks, label, limits).select(query_id, "rank", "label")


def _same_for_all(asked: DataFrame, packed: Sequence[tuple[int, str]], query_id: str) -> DataFrame:
    if not packed:
        return asked.limit(0).select(query_id, F.lit(0).alias("rank"), F.lit("").alias("label"))
    array = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("label")) for r, t in packed])
    return asked.select(query_id, F.explode(array).alias("hit")).select(query_id, "hit.rank", "hit.label")


def _labelled(hits: DataFrame, chunks: DataFrame, label: Column, limits: Limits) -> DataFrame:
    """Fetches the text of the chosen chunks; one chunk may be the answer to very many queries."""
    texts = chunks.select(F.col("doc_ord").cast("long"), F.col("chunk_ord").cast("long"), label)
    if texts.count() <= limits.broadcast_rows and _fits(texts, limits, F.octet_length("label")):
        return hits.join(F.broadcast(texts), list(_PLACE))
    return salted_join(written(hits, "hits"), texts, _PLACE, "inner")


def row_lines(cells: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """``(row_id, col_ord, line_ord, line)``: every non-blank line of every cell that says something.

    ``cells`` holds the cells as canonical strings.
    """
    array = F.array(*all_named(columns))
    exploded = cells.select(row_id, F.posexplode(array).alias("col_ord", "cell"))
    told = exploded.where(~strip(F.col("cell")).isin("", "null"))
    lines = told.select(row_id, "col_ord", F.posexplode(F.split("cell", "\n", -1)).alias("line_ord", "line"))
    return lines.withColumn("line", strip(F.col("line"))).where(F.col("line") != "")


def chunks_per_row(
    cells: DataFrame,
    chunks: DataFrame,
    columns: Sequence[str],
    load_encoder: Callable[[], Encoder],
    row_id: str,
    k: int = LINE_TOP_K,
    limits: Limits = Limits(),
) -> DataFrame:
    """``(row_id, chunks)``: the labels found for a row's lines, in order, each once.

    Every distinct line is encoded and looked up once. The answers come back as one row per
    line, over a join that splits frequent lines.
    """
    lines = row_lines(cells, columns, row_id)
    counted = written(lines.groupBy("line").agg(F.count("*").alias("rows")), "lines")
    distinct = counted.select("line", F.col("line").alias("query_id"))
    found = find_relevant_chunks(distinct, chunks, load_encoder, k, "query_id", "line", limits=limits)
    answers = found.groupBy(F.col("query_id").alias("line")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda h: h["label"]).alias("labels")
    )
    matched = salted_join(lines, answers, "line", "inner", left_counts=counted)
    # A group is the lines of one row, so it is as small as the row itself.
    per_row = matched.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("col_ord", "line_ord", "labels"))).alias("hits")
    )
    labels = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["labels"])))
    return per_row.select(row_id, labels.alias("chunks"))


def context_text(chunks: Column, style: str = "prompt") -> Column:
    """The chunks of a row as text: ``plain`` joins by blank lines, ``prompt`` adds a lead line.

    No chunks give ``''``.
    """
    if style == "plain":
        return F.coalesce(F.array_join(chunks, "\n\n"), F.lit(""))
    joined = F.concat(F.lit(CONTEXT_LEAD), F.array_join(chunks, "\n"))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) > 0, joined).otherwise(F.lit(""))


def with_context(rows: DataFrame, found: DataFrame, row_id: str, style: str = "prompt") -> DataFrame:
    """``rows`` with ``context``; rows without hits keep an empty one."""
    joined = rows.join(found, row_id, "left")
    return joined.withColumn("context", context_text(F.col("chunks"), style)).drop("chunks")
