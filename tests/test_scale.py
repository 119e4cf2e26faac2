"""The skew-safe plans, with bounds so small that hot groups really are cut."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators.usage import calibration, recent_speed, remaining_time, running_totals
from rowloom.plans import scale
from rowloom.plans.scale import ordered_concat, running_sums, salted_join, with_position


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    keys = ["hot"] * 60 + ["warm"] * 7 + [None] * 9 + ["cold"]
    at = pick.sample([*range(40), *range(1000, 1030), 2**40, 2**59, -5, -70, *range(2**33, 2**33 + 30)], len(keys))
    return [(k, a, pick.randint(0, 9)) for k, a in zip(keys, at)]


@pytest.mark.parametrize("bits,levels", [(20, 3), (2, 3), (3, 2), (1, 4)])
def test_running_sums(spark, rows, bits, levels):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r["k"], r["at"]): r["s"] for r in running_sums(df, ["k"], "at", {"s": F.col("v")}, bits, levels).collect()}
    want, total = {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + v
        want[k, at] = total[k]
    assert got == want


def test_positions(spark, rows):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = sorted((r["at"], r["position"]) for r in with_position(df, "at").collect())
    assert [p for _, p in got] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("piece", [1, 4, 1_000_000])
def test_salted_join(spark, rows, monkeypatch, piece):
    monkeypatch.setattr(scale, "ROWS_PER_SALT", piece)
    left = spark.createDataFrame(rows, "k string, at long, v long")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3), (None, 4)], "k string, w int")
    got = sorted((r["k"] or "", r["at"], r["w"]) for r in salted_join(left, right, "k").collect())
    names = {"hot": 1, "cold": 2}
    assert got == sorted((k or "", at, names.get(k)) for k, at, _ in rows)
    assert salted_join(left, right, "k", "inner").count() == 61
    many = left.select("k", F.col("at").alias("at2"))
    assert salted_join(left, many, "k", "inner", right_unique=False).count() == 60 * 60 + 49 + 1


def test_every_hot_key_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_SALT", 1)
    hot = scale._hot_keys(spark.range(6000).selectExpr("id div 2 AS k"), ["k"])
    assert hot.count() == 3000 and {r["_pieces"] for r in hot.collect()} == {2}


@pytest.mark.parametrize("bits", [12, 1])
def test_ordered_concat(spark, rows, bits):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    joined = scale.ordered_fold(df, ["k"], "at", F.col("at").cast("string"), lambda i: F.array_join(i, ","), bits)
    for r in joined.collect():
        assert r["folded"] == ",".join(str(a) for a in sorted(at for k, at, _ in rows if k == r["k"]))
    assert ordered_concat(df, ["k"], "at", F.col("v").cast("string"), "").count() == 4


@pytest.fixture(scope="module")
def usage_rows():
    pick = random.Random(5)
    out = []
    for seq in range(300):
        run = "hot" if seq % 5 else "small"
        out.append((run, seq % 2, seq, pick.randint(1, 90), pick.choice([0, 0, 5, 17, 80]), pick.choice([0.5, 1.0, 2.0]),
                    pick.randint(0, 30)))
    return out


def test_usage(spark, usage_rows):
    df = spark.createDataFrame(
        usage_rows,
        "run_id string, def_id int, seq long, prompt_tokens long, completion_tokens long, seconds double, input_est long",
    ).repartition(5)
    totals = {r["seq"]: (r["total_prompt"], r["total_completion"], r["total_tokens"]) for r in running_totals(df).collect()}
    speeds = {r["seq"]: r["recent_speed"] for r in recent_speed(df, span_bits=4).collect()}
    facts = {(r["run_id"], r["def_id"]): (r["ratio"], r["speed"]) for r in calibration(df).collect()}
    left = {r["seq"]: r["remaining_seconds"] for r in remaining_time(df).collect()}

    for run in ("hot", "small"):
        prompt = completion = 0
        history = []
        mine = [u for u in usage_rows if u[0] == run]
        for _, _, seq, p, c, dt, _ in mine:
            prompt, completion = prompt + p, completion + c
            assert totals[seq] == (prompt, completion, prompt + completion)
            if c:
                history = [*history, c / dt][-10:]
                assert speeds[seq] == pytest.approx(sum(history) / len(history))
            else:
                assert seq not in speeds
        for definition in (0, 1):
            own = [u for u in mine if u[1] == definition]
            _, _, _, _, c, dt, est = own[0]
            ratio, speed = max(0.2, min(8.0, c / max(1, est))), max(1e-6, c / dt)
            assert facts[run, definition] == (pytest.approx(ratio), pytest.approx(speed))
            for i, u in enumerate(own):
                following = sum(max(1, x[6]) for x in own[i + 1 :])
                assert left[u[2]] == int(ratio * following / speed)
            assert left[own[-1][2]] == 0


@pytest.mark.parametrize("bits", [2, 20])
def test_forecast_over_many_stretches(spark, usage_rows, bits):
    schema = "run_id string, def_id int, seq long, prompt_tokens long, completion_tokens long, seconds double, input_est long"
    df = spark.createDataFrame(usage_rows, schema).repartition(5)
    got = {r["seq"]: r["remaining_seconds"] for r in remaining_time(df, span_bits=bits).collect()}
    assert got == {r["seq"]: r["remaining_seconds"] for r in remaining_time(df).collect()} and len(got) == len(usage_rows)


def test_forecast_reads_the_table_once(spark, usage_rows, tmp_path):
    schema = "run_id string, def_id int, seq long, prompt_tokens long, completion_tokens long, seconds double, input_est long"
    path = str(tmp_path / "usage")
    spark.createDataFrame(usage_rows, schema).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = remaining_time(spark.read.parquet(path))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sum("FileScan" in line and f"{path}]" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("bits", [2, 20])
def test_ordered_pieces(spark, rows, bits):
    df = spark.createDataFrame(rows, "k string, at long, v long")
    found = scale.ordered_pieces(df, ["k"], "at", F.col("at").cast("string"), ", ", 40, span_bits=bits)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (str(r["k"]), r["piece"])):
        own = got.setdefault(r["k"], [])
        assert r["piece"] == len(own) and len(r["folded"]) < 40 + 22
        own.append(r["folded"])
    for key, pieces in got.items():
        assert ", ".join(pieces) == ", ".join(str(a) for a in sorted(at for k, at, _ in rows if k == key))
