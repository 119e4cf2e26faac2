from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators.embed import embed_documents, hashing_encoder
from rowloom.operators.generate import generate_once, reply_or_error, run_generator, with_request
from rowloom.plans.enrich import add_column, generate_columns
from tests.conftest import plan_of

DEFINITIONS = [{"headers": ["A", "b"], "instructions": "do a"}, {"headers": ["x"], "instructions": "do x", "example": "Row 1: e"}]


def logging_generator(log, fail=""):
    def load():
        def generate(requests):
            with open(log, "a") as out:
                out.writelines(json.dumps(r) + "\n" for r in requests)
            if fail and any(fail in r["prompt"] for r in requests):
                raise RuntimeError("no: " + "z" * 300)
            return [{"text": json.dumps({"new_value": f"len {len(r['prompt'])}"}), "completion_tokens": 5} for r in requests]

        return generate

    return load


@pytest.fixture(scope="module")
def people(spark):
    data = [(0, "head", "x"), (1, "ann", None), (2, " ", "NA"), (3, "bob", "b"), (4, "cy", "c")]
    return spark.createDataFrame(data, "row_id long, x string, name string")


def test_requests_and_usage(spark, people, tmp_path):
    log = tmp_path / "log"
    requests = with_request(people, F.concat(F.lit("p "), "x"), F.length("x") * 100, 8, temperature=0.1)
    rows = {r["row_id"]: r for r in run_generator(requests, logging_generator(log), batch=2, max_tasks=1).collect()}
    assert rows[1]["reply"] == '{"new_value": "len 5"}' and rows[1]["error"] is None
    assert (rows[1]["prompt_tokens"], rows[1]["completion_tokens"]) == (1, 5) and rows[1]["seconds"] > 0
    sent = [json.loads(line) for line in log.read_text().splitlines()]
    assert {s["max_tokens"] for s in sent} == {254, 304, 354, 404}
    assert all(s["temperature"] == 0.1 and s["stop"] == ["[[ ## completed ## ]]"] for s in sent)


def test_a_failure_costs_one_row(spark, people, tmp_path):
    requests = with_request(people, F.concat(F.lit("p "), "x"), F.lit(1))
    out = run_generator(requests, logging_generator(tmp_path / "log", fail="bob"), batch=32, max_tasks=1)
    shown = out.select(
        "row_id", reply_or_error(F.col("reply"), F.col("error")).alias("m"),
        reply_or_error(F.col("reply"), F.col("error"), "empty").alias("e"),
    )
    rows = {r["row_id"]: r for r in shown.collect()}
    assert rows[3]["m"] == "Error: " + ("no: " + "z" * 300)[:200] and rows[3]["e"] == ""
    assert all(r["m"].startswith("{") for i, r in rows.items() if i != 3)


def test_a_run_goes_on_where_it_stopped(spark, people, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "replies")
    requests = with_request(people, F.concat(F.lit("p "), "x"), F.lit(1)).select("row_id", "request")
    generate_once(requests.where("row_id < 2"), logging_generator(log), path, ["row_id"])
    generate_once(requests, logging_generator(log, fail="bob"), path, ["row_id"])
    calls = len(log.read_text().splitlines())
    replies = generate_once(requests, logging_generator(log), path, ["row_id"])
    again = log.read_text().splitlines()[calls:]
    assert [json.loads(a)["prompt"] for a in again] == ["p bob"]
    assert replies.where("error is null").count() == 5


def test_replies_belong_to_whole_requests(spark, people, tmp_path):
    """Other instructions are asked again, other row ids are not, and old replies do not come back."""
    log, path = tmp_path / "log", str(tmp_path / "replies")

    def run(table, instructions):
        before = len(log.read_text().splitlines()) if log.exists() else 0
        out = generate_columns(table, ["x"], [{"headers": ["v"], "instructions": instructions}], logging_generator(log), path=path)
        got = {r["x"]: r["v"] for r in out.collect()}
        return got, len(log.read_text().splitlines()) - before

    first, calls = run(people, "short")
    assert calls == 4 and len({v for v in first.values() if v}) >= 1
    longer, calls = run(people, "rather longer instructions")
    assert calls == 4 and all(first[x] != longer[x] for x in ("head", "ann", "bob", "cy")) and longer[" "] == ""
    again, calls = run(people, "short")
    assert calls == 0 and again == first
    moved, calls = run(people.withColumn("row_id", F.col("row_id") + 1000), "short")
    assert calls == 0 and moved == first


def test_columns_end_to_end(spark, people, tmp_path):
    log = tmp_path / "log"
    out = generate_columns(people, ["x", "name"], DEFINITIONS, logging_generator(log), max_rows=3)
    # "x" exists already, so the second column gets a number.
    assert out.columns == ["row_id", "x", "name", "A - b", "generated_2"]
    rows = {r["row_id"]: r for r in out.collect()}
    assert [i for i, r in sorted(rows.items()) if r["A - b"]] == [0, 1, 3]
    assert all((r["A - b"] == "") == (r["generated_2"] == "") for r in rows.values())
    assert len(log.read_text().splitlines()) == 6
    with pytest.raises(ValueError):
        generate_columns(people, [], DEFINITIONS, logging_generator(log))


def test_context_reaches_the_prompt(spark, people, tmp_path):
    log = tmp_path / "log"
    docs = spark.createDataFrame([(0, "d.txt", "ann lives in the north. bob lives in the south.")],
                                 "doc_ord long, doc_name string, text string")
    chunks = embed_documents(docs, hashing_encoder(16))
    generate_columns(
        people, ["x"], DEFINITIONS[:1], logging_generator(log), chunks=chunks, load_encoder=hashing_encoder(16), max_rows=2,
    ).collect()
    prompts = [json.loads(line)["prompt"] for line in log.read_text().splitlines()]
    ann = next(p for p in prompts if '"x": "ann"' in p)
    assert "Relevant context from documents:\n[d.txt] ann lives in the north\n[d.txt] bob lives in the south\n" in ann


def test_native_column_is_one_pass(spark, people):
    out = add_column(people, ["x"], "say", lambda p: F.concat(F.lit("new_value: "), F.length(p).cast("string")), "n", max_rows=2)
    rows = {r["row_id"]: r["n"] for r in out.collect()}
    assert rows[0].isdigit() and rows[1].isdigit() and [rows[i] for i in (2, 3, 4)] == ["", "", ""]
    assert "Exchange" not in plan_of(out) and "Join" not in plan_of(out)


def test_any_column_name_will_do(spark, tmp_path):
    odd = "[A] No. of `x` - é"
    df = spark.createDataFrame([(0, "a", "b"), (1, "", None)], "row_id long, c0 string, c1 string").toDF("row_id", odd, "b.c")
    out = generate_columns(df, [odd, "b.c"], [{"headers": ["v1.0"], "instructions": "i"}] * 2, logging_generator(tmp_path / "log"))
    assert out.columns == ["row_id", odd, "b.c", "v1.0"]
    assert {r["row_id"]: bool(r["v1.0"]) for r in out.collect()} == {0: True, 1: False}
    native = add_column(df, [odd], "say", lambda p: p, "n.m", max_rows=1)
    assert native.columns[-1] == "n.m" and native.count() == 2
    from rowloom.operators.combine import align
    from rowloom.plans.scale import with_position

    assert with_position(align(df, out, "v1.0"), "row_id").columns == ["row_id", odd, "b.c", "v1.0", "position"]


def test_a_limited_run_over_many_files_is_spread(spark, tmp_path):
    folder = str(tmp_path / "many")
    spark.range(400).select(F.col("id").alias("row_id"), F.lit("x").alias("x")).repartition(40).write.parquet(folder)
    log = str(tmp_path / "tasks")

    def load():
        from pyspark import TaskContext

        def generate(requests):
            with open(log, "a") as out:
                out.write(f"{TaskContext.get().partitionId()}\n")
            return [{"text": "{}", "completion_tokens": 1} for _ in requests]

        return generate

    out = generate_columns(spark.read.parquet(folder), ["x"], DEFINITIONS[:1], load, max_rows=100, batch=5)
    assert out.count() > 0
    with open(log) as found:
        assert len(set(found.read().split())) > 1
