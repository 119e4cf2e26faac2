from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowloom.operators import rows as rows_module
from rowloom.operators.chunks import block_chunks, chunk_array, chunk_documents, concat_chunks, distinct_chunks
from rowloom.operators.combine import (
    align, align_in_place, append_remainder, columns_per_definition, one_row_per_definition, valid_definitions,
)
from rowloom.operators.examples import build_examples, format_examples
from rowloom.operators.manifest import group_shards, reconcile, set_sizes, shard_sets
from rowloom.operators.rows import (
    count_non_empty_rows, last_row_to_process, non_empty_rows, parse_column_indices, preview_size, rows_to_process,
    select_sources,
)
from tests.conftest import plan_of


@pytest.mark.parametrize("text,want", [
    ("", [0, 1, 2, 3]), (None, [0, 1, 2, 3]), ("0-2", [0, 1, 2]), ("3, 1,1", [1, 3]), ("2-9", [2, 3]), ("3-1", []), ("7", []),
])
def test_column_indices(text, want):
    assert parse_column_indices(text, 4) == want


@pytest.mark.parametrize("text", ["-1", "a", "1-2-3", "1,"])
def test_wrong_column_indices(text):
    with pytest.raises(ValueError):
        parse_column_indices(text, 4)


@pytest.fixture(scope="module")
def people(spark):
    data = [(0, "N/A", None), (1, "x", ""), (2, " ", "null"), (3, None, "y"), (4, "z", "z"), (5, "", ""), (6, "w", None)]
    return spark.createDataFrame(data, "row_id long, a string, b string")


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


def test_source_selection(people):
    assert select_sources(people, "1,0").columns == ["row_id", "a", "b"]
    assert select_sources(people, [1, 0, 1, 9]).columns == ["row_id", "b", "a"]


@pytest.mark.parametrize("limit", [rows_module.SORTED_LIMIT, 0])
def test_first_non_empty_rows(people, monkeypatch, limit):
    monkeypatch.setattr(rows_module, "SORTED_LIMIT", limit)
    assert ids(non_empty_rows(people, ["a", "b"])) == [1, 3, 4, 6]
    assert ids(non_empty_rows(people, ["a", "b"], 2)) == [1, 3]
    assert ids(non_empty_rows(people, ["b"], 5)) == [3, 4]
    assert ids(non_empty_rows(people, ["a"], 0)) == []
    assert ids(non_empty_rows(people, [])) == [] and non_empty_rows(people, []).columns == people.columns
    assert last_row_to_process(people, ["a", "b"], 3) == 4
    assert last_row_to_process(people, ["a", "b"], 99) == 6


def test_first_rows_by_any_key_that_has_an_order(spark, monkeypatch):
    """Two sides of the limit of a sorted limit give the same rows, also for text keys and for keys of many ranges."""
    df = spark.range(3_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("row_id"), F.lit("x").alias("a"))
    df = df.repartition(7)
    monkeypatch.setattr(rows_module, "SORTED_LIMIT", 1_000)
    want = [f"k{i:06}" for i in range(3_000)]
    for n in (1_000, 1_001, 2_999, 3_000, 3_001):
        assert ids(non_empty_rows(df, ["a"], n)) == want[:n]
    dated = df.withColumn("row_id", F.date_add(F.lit("2020-01-01").cast("date"), F.substring("row_id", 2, 6).cast("int")))
    assert non_empty_rows(dated, ["a"], 2_000).agg(F.max("row_id")).first()[0].isoformat() == "2025-06-22"


def test_a_table_of_very_many_definitions(spark, monkeypatch):
    from rowloom.operators import combine

    definitions = spark.createDataFrame([(2 * i, ["h", str(i)], f"do {i}") for i in range(12)], "def_id int, headers array<string>, instructions string")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "row_id long, `_number` string")
    few = sorted(map(tuple, one_row_per_definition(rows, definitions).collect()))
    monkeypatch.setattr(combine, "LITERAL_DEFINITIONS", 5)
    assert sorted(map(tuple, one_row_per_definition(rows, definitions).collect())) == few and len(few) == 24


def test_first_rows_are_a_sorted_limit(people):
    assert "TakeOrderedAndProject" in plan_of(non_empty_rows(people, ["a", "b"], 2))


def test_a_typed_column_is_a_null_check(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "PushedFilters: [IsNotNull(o_totalprice)]" in plan_of(non_empty_rows(df, ["o_totalprice"]))


def test_counts_and_sizes(people):
    assert count_non_empty_rows(people).first()[0] == 4
    assert count_non_empty_rows(people, [1, 8]).first()[0] == 2
    assert count_non_empty_rows(people, [8]).first()[0] == 0
    assert rows_to_process(4, None) == rows_to_process(4, 9) == 4 and rows_to_process(4, 2) == 2
    assert [preview_size(n) for n in (None, 0, 7, 99)] == [10, 1, 7, 50]


def test_alignment_keeps_every_row(people):
    generated = non_empty_rows(people, ["a", "b"], 3).select("row_id", F.concat(F.lit("v"), "row_id").alias("new"))
    out = align(people, generated, "new")
    assert out.columns == [*people.columns, "new"]
    assert {r["row_id"]: r["new"] for r in out.collect()} == {0: "", 1: "v1", 2: "", 3: "v3", 4: "v4", 5: "", 6: ""}
    assert sorted(map(tuple, out.drop("new").collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
    whole = append_remainder(non_empty_rows(people, ["a", "b"], 3).withColumn("new", F.lit(None).cast("string")), people, "new")
    assert ids(whole) == list(range(7)) and all(r["new"] == "" for r in whole.collect())
    assert append_remainder(people.limit(0).withColumn("new", F.lit("x")), people, "new").count() == 7
    assert "Exchange" not in plan_of(align_in_place(people, F.col("a") == "x", F.lit("v"), "new"))


def test_definitions(spark, people):
    given = spark.createDataFrame(
        [(0, ["A", "", "b"], "do"), (1, ["", ""], "do"), (2, ["C"], ""), (3, ["C"], None), (4, [None, "D"], "do")],
        "def_id int, headers array<string>, instructions string",
    )
    kept = valid_definitions(given)
    assert [(r["def_id"], r["headers"]) for r in kept.orderBy("def_id").collect()] == [(0, ["A", "b"]), (4, ["D"])]
    each = one_row_per_definition(people, kept)
    assert each.count() == 14 and "Join" not in plan_of(each)
    values = each.where("row_id < 5").select(
        "row_id", F.col("definition.column").alias("column"),
        F.when(F.col("row_id") != 2, F.concat("definition.column", F.lit("!"))).alias("value"),
    )
    wide = columns_per_definition(values, ["D", "A - b"])
    assert wide.columns == ["row_id", "D", "A - b"]
    assert {tuple(r) for r in wide.collect()} == {(i, "D!", "A - b!") for i in (0, 1, 3, 4)} | {(2, "", "")}


TEXT = "One is short. One is long enough! One is long enough? \n\nNext block\nhas two lines. Tiny.\n \n\n  Last one here..."


def chunks_of(spark, column):
    df = spark.createDataFrame([(TEXT,), ("",), (" \n",), (None,)], "t string")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


def test_chunk_kinds(spark):
    want = {
        "sentence": ["One is short", "One is long enough", "Next block\nhas two lines", "Last one here"],
        "line": ["One is short. One is long enough! One is long enough?", "has two lines. Tiny.", "Last one here..."],
        "paragraph": ["One is short", "One is long enough", "Next block\nhas two lines", "Last one here"],
        "block": ["One is short. One is long enough! One is long enough?", "Next block\nhas two lines. Tiny.",
                  "Last one here..."],
    }
    for kind, chunks in want.items():
        got = chunks_of(spark, lambda t, k=kind: chunk_array(t, k))
        if kind == "block":
            chunks = chunks_of(spark, block_chunks)[0]
        assert got[0] == chunks, kind
        assert got[1:] == [[], [], None], kind


def test_paragraphs_end_sentences(spark):
    df = spark.createDataFrame([("no full stop here\n\t\nand a new paragraph",)], "t string")
    assert df.select(chunk_array(F.col("t"), "paragraph")).first()[0] == ["no full stop here", "and a new paragraph"]
    assert df.select(chunk_array(F.col("t"), "sentence")).first()[0] == ["no full stop here\n\t\nand a new paragraph"]


def test_chunking_needs_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    plan = plan_of(chunk_documents(docs))
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_distinct_chunks_in_long_form(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "abcdefghijkl. abcdefghijkl.")], "doc_id long, text string")
    long = distinct_chunks(chunk_documents(docs, distinct=False))
    short = chunk_documents(docs)
    for doc in (1, 2):
        def texts(df, doc=doc):
            return [r["chunk"] for r in df.where(F.col("doc_id") == doc).orderBy("chunk_ord").collect()]
        assert texts(long) == texts(short)
    joined = {r["doc_id"]: r["context"] for r in concat_chunks(short).collect()}
    assert joined[2] == "abcdefghijkl" and joined[1].split("\n\n")[1] == "One is long enough"


def test_examples(spark):
    rows = spark.createDataFrame([(1, "é", 2.0), (2, None, None)], "row_no long, a string, b double")
    examples = spark.createDataFrame(
        [(0, 10, " x ", None), (0, 2, "y\nz", " "), (1, 1, "w", " first\nsecond ")],
        "def_id int, row_no long, text string, document string",
    )
    built = {(r["def_id"], r["row_no"]): r["example"] for r in build_examples(examples, rows, ["b", "a"]).collect()}
    assert built == {
        (0, 10): "Expected output: x",
        (0, 2): 'Example:\nSource data: {\n  "b": "null",\n  "a": "null"\n}\nExpected output: y\nz',
        (1, 1): 'Example:\nSource data: {\n  "b": "2.0",\n  "a": "é"\n}\nDocument input: first\nsecond\nExpected output: w',
    }
    formatted = {r["def_id"]: r["example"] for r in format_examples(examples).collect()}
    assert formatted == {0: "Row 2: y\nz\n\nRow 10:  x ", 1: "Row 1: w"}


def test_shard_sets(spark):
    names = [
        ("m-00001-of-00002.gguf", 5), ("m-00002-of-00002.gguf", 7), ("gap-1-of-3.gguf", 1), ("gap-3-of-3.gguf", 1),
        ("odd-1-of-2.gguf", 1), ("odd-2-of-3.gguf", 1), ("same-1-of-2.gguf", 1), ("same-01-of-2.gguf", 1),
        ("one.gguf", None), ("m-x-of-2.gguf", 3), ("u-1-of-1.gguf", None), ("z-0-of-1.gguf", 2),
    ]
    listing = spark.createDataFrame(names, "name string, size long")
    sets = {r["base"]: (r["parts"], r["size"], r["complete"]) for r in shard_sets(listing).collect()}
    assert sets == {
        "m": (2, 12, True), "gap": (2, 2, False), "odd": (2, 2, False), "same": (2, 2, False), "u": (1, None, True),
        "z": (1, 2, False),
    }
    groups = group_shards(listing)
    assert groups.count() == len(names)
    assert {r["name"]: r["group_name"] for r in groups.collect() if r["part"] is not None} == {
        "m-00001-of-00002.gguf": "m", "m-00002-of-00002.gguf": "m", "u-1-of-1.gguf": "u",
    }
    ordered = [(r["name"], r["size"]) for r in set_sizes(listing).collect()]
    assert ordered[-3:] == [("m.gguf", 12), ("one.gguf", None), ("u.gguf", None)]
    assert [s for _, s in ordered[:-2]] == sorted(s for _, s in ordered[:-2])


def test_reconciliation(spark):
    local = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 0)], "name string, size long")
    remote = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("e", 0), ("f", 1)], "name string, size long")
    assert {r["name"]: (r["reason"], r["corrupted"]) for r in reconcile(local, remote).collect()} == {
        "a": ("ok", False), "b": ("size", True), "c": ("unverified", False), "d": ("missing", True), "e": ("unverified", False),
    }
