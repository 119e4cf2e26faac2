"""All plans for the similarity join against brute force, and what is built on them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.vectors import cosine
from rowloom.operators.embed import embed_documents, hashing_encoder
from rowloom.operators.retrieve import (
    Limits, chunks_per_row, context_text, find_relevant_chunks, first_chunks, row_lines, source_label, top_k,
)

from rowloom.session import written
from tests.conftest import plan_of

PLANS = {
    "chunks_broadcast": Limits(),
    "queries_broadcast": Limits(broadcast_rows=0),
    "blocks": Limits(broadcast_rows=0, broadcast_queries=0, block_chunks=16, block_queries=8, pivots=7),
    "one_block": Limits(broadcast_rows=0, broadcast_queries=0),
}


def brute(queries, chunks, k):
    """``queries`` and ``chunks`` are lists of (id, …, vector)."""
    out = {}
    for qid, q in queries:
        scored = []
        for doc, place, c in chunks:
            if c is None:
                continue
            scale = np.linalg.norm(q) * np.linalg.norm(c)
            score = round(float(np.dot(q, c)) / scale, 9) if scale else 0.0
            scored.append((-score, doc, place))
        out[qid] = sorted(scored)[:k]
    return out


def vectors(kind):
    pick = np.random.default_rng(11)
    if kind == "clustered":
        centres = pick.normal(size=(6, 8)) * 4
        cloud = centres[pick.integers(0, 6, 240)] + pick.normal(size=(240, 8)) * 0.3
    elif kind == "copies":
        cloud = np.repeat(pick.normal(size=(4, 8)), 60, axis=0)
    else:
        cloud = pick.integers(0, 3, size=(240, 8)).astype(float)
        cloud[::40] = 0
    return cloud.astype(np.float32)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("kind", ["clustered", "copies", "counts"])
def test_top_k_is_exact(spark, plan, kind):
    cloud = vectors(kind)
    chunks = [(i % 5, i, v) for i, v in enumerate(cloud)] + [(9, 0, None)]
    queries = [(f"q{i}", v) for i, v in enumerate(cloud[::9])]
    want = brute(queries, chunks, 4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id string, embedding array<float>")
    c = spark.createDataFrame(
        [(d, o, None if v is None else v.tolist()) for d, o, v in chunks],
        "doc_ord long, chunk_ord long, embedding array<float>",
    ).repartition(3)
    rows = top_k(q, c, 4, limits=PLANS[plan]).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["doc_ord"], r["chunk_ord"]))
    assert set(got) == set(want)
    for qid, hits in want.items():
        assert [(d, o) for _, d, o in got[qid]] == [(d, o) for _, d, o in hits], qid
        assert [s for s, _, _ in got[qid]] == pytest.approx([s for s, _, _ in hits])


@pytest.mark.parametrize("plan", PLANS)
def test_fewer_chunks_than_k(spark, plan):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(0, 0, [0.0, 1.0]), (0, 1, [1.0, 1.0])], "doc_ord int, chunk_ord int, embedding array<float>")
    rows = top_k(q, c, 5, limits=PLANS[plan]).orderBy("rank").collect()
    assert [(r["chunk_ord"], r["rank"]) for r in rows] == [(1, 1), (0, 2)]
    assert top_k(q, c.limit(0), 5, limits=PLANS[plan]).count() == 0


def test_two_large_sides_shuffle_candidates_only(spark):
    """Chunks are not exchanged, and floors keep candidates far below k for every task and query."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4_000, 8)).astype(np.float32)
    c = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors)], "doc_ord long, chunk_ord long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:200])], "query_id long, embedding array<float>")
    limits = Limits(broadcast_rows=0, broadcast_queries=0, block_chunks=64, block_queries=100, pivots=2_000)
    chunks = written(c.repartition(40), "chunks")
    tasks = chunks.rdd.getNumPartitions()
    from rowloom.operators import retrieve

    schema = "query_id long, doc_ord long, chunk_ord long, score double"
    found = retrieve._through_parts(q, chunks, 5, "query_id", T._parse_datatype_string(schema), limits, 200)
    assert 200 * 5 <= found.count() < 200 * 5 * tasks / 2
    some = retrieve._queries_broadcast(q, chunks, 5, "query_id", T._parse_datatype_string(schema))
    assert "Exchange" not in plan_of(some)
    assert top_k(q, chunks, 5, limits=limits).count() == 1_000


def test_copies_are_cut_before_the_shuffle(spark):
    from rowloom.operators.retrieve import _first_copies

    rows = [(i % 3, i, [1.0, 2.0]) for i in range(30)] + [(7, 7, [2.0, 4.0])]
    c = spark.createDataFrame(rows, "doc_ord long, chunk_ord long, embedding array<float>").repartition(4)
    kept = _first_copies(c, 2)
    assert sorted((r[0], r[1]) for r in kept.collect()) == [(0, 0), (0, 3), (7, 7)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    c = spark.createDataFrame([(0, 0, [0.0, 1.0])], "doc_ord int, chunk_ord int, embedding array<float>")
    plan = top_k(q, c, 5, limits=PLANS["queries_broadcast"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = top_k(q, c, 5)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])],
                               "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.0, -1.0])


DOCS = [
    (0, "x/one.txt", "the red apple tree. the green apple tree. a blue river flows. a blue river flows."),
    (1, "y/two.md", "mountains are very high! the red apple tree. rivers of the north"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    docs = spark.createDataFrame(DOCS, "doc_ord long, doc_name string, text string")
    return embed_documents(docs, hashing_encoder(32))


def labels(df, key="query_id"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(r["label"])
    return out


@pytest.mark.parametrize("plan", PLANS)
def test_relevant_chunks(spark, chunks, plan):
    queries = spark.createDataFrame([(1, "red apple tree"), (2, " \n"), (3, "a blue river flows")], "query_id long, text string")
    got = labels(find_relevant_chunks(queries, chunks, hashing_encoder(32), 2, limits=PLANS[plan]))
    assert got == {
        1: ["[one.txt] the red apple tree", "[two.md] the red apple tree"],
        3: ["[one.txt] a blue river flows", got[3][1]],
    }


def test_fallback_without_vectors(spark, chunks):
    bare = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    queries = spark.createDataFrame([(1, "red apple tree")], "query_id long, text string")
    encoder = hashing_encoder(32)
    first = ["[one.txt] the red apple tree", "[one.txt] the green apple tree", "[one.txt] a blue river flows",
             "[two.md] mountains are very high"]
    assert labels(find_relevant_chunks(queries, bare, encoder, 4)) == {1: first}
    half = chunks.where("doc_ord = 0").unionByName(bare.where("doc_ord = 1"))
    assert all("one.txt" in x for x in labels(find_relevant_chunks(queries, half, encoder, 9))[1])
    assert labels(find_relevant_chunks(queries, half, encoder, 4, strict_fallback=True)) == {1: first}
    assert [r["rank"] for r in first_chunks(chunks, 9, 2).orderBy("rank").collect()] == [1, 2, 3, 4]
    none = find_relevant_chunks(queries, chunks.limit(0), encoder)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "label"]


def test_lines_of_rows(spark):
    cells = spark.createDataFrame([(1, "a\n\n b ", "null"), (2, " ", "c"), (3, "null", "")], "row_id long, x string, y string")
    got = sorted(tuple(r) for r in row_lines(cells, ["x", "y"], "row_id").collect())
    assert got == [(1, 0, 0, "a"), (1, 0, 2, "b"), (2, 1, 0, "c")]


@pytest.mark.parametrize("plan", PLANS)
def test_chunks_of_rows(spark, chunks, plan):
    cells = spark.createDataFrame(
        [(1, "a blue river flows\nred apple tree", "green apple tree"), (2, "null", "  "), (3, "null", "red apple tree")],
        "row_id long, x string, y string",
    )
    found = chunks_per_row(cells, chunks, ["x", "y"], hashing_encoder(32), "row_id", 2, PLANS[plan])
    got = {r["row_id"]: r["chunks"] for r in found.collect()}
    assert set(got) == {1, 3}
    assert got[1][0] == "[one.txt] a blue river flows" and len(set(got[1])) == len(got[1])
    assert got[3] == ["[one.txt] the red apple tree", "[two.md] the red apple tree"]


def test_context_text(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(context_text(F.col("c"))).collect()] == [
        "\n\nRelevant context from documents:\na\nb", "", "",
    ]
    assert [r[0] for r in df.select(context_text(F.col("c"), "plain")).collect()] == ["a\n\nb", "", ""]
    assert df.select(source_label(F.lit("/a/b.txt"), F.lit("c"))).first()[0] == "[b.txt] c"


def test_parts_read_chunks_that_are_spread_once(spark, monkeypatch):
    """However many blocks of queries there are, chunks are exchanged once at most."""
    from rowloom.operators import retrieve

    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((300, 8)).astype(np.float32)
    c = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors)], "doc_ord long, chunk_ord long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, embedding array<float>")
    chunks, plans, own = written(c.coalesce(1), "chunks"), [], retrieve._queries_broadcast

    def seen(*args):
        plans.append(plan_of(own(*args)))
        return own(*args)

    monkeypatch.setattr(retrieve, "_queries_broadcast", seen)
    limits = Limits(broadcast_rows=0, broadcast_queries=0, block_chunks=64, block_queries=10, pivots=100)
    found = top_k(q, chunks, 5, limits=limits).where("rank = 1").collect()
    assert all(r["chunk_ord"] == r["query_id"] for r in found) and len(found) == 300
    assert len(plans) == 1 and not any("Exchange" in p for p in plans)


def test_a_side_holds_vectors_in_single_precision():
    """Beside the vectors as they came a side holds them once more, and little else while it is made."""
    import tracemalloc

    import pyarrow as pa

    from rowloom.operators.retrieve import _PLACE, _copy_number, _ranking_order, _Side

    values = np.random.default_rng(7).standard_normal((100_000, 16)).astype(np.float32)
    values[50_000:] = values[:50_000]
    ids = np.arange(len(values))
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * 16)
    vectors = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
    rows = pa.table({"doc_ord": ids, "chunk_ord": ids, "embedding": vectors})
    tracemalloc.start()
    side = _Side(rows, _PLACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * values.nbytes
    assert np.array_equal(side.matrix, values)
    assert np.array_equal(_copy_number(values), np.repeat([0, 1], 50_000))
    assert len(_ranking_order(rows, _PLACE, 1)) == 50_000
