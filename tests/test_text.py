from __future__ import annotations

import datetime
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import WHITESPACE, canonical_string, is_filled, json_quote, strip
from rowloom.operators.payload import approx_tokens, output_column_name, row_payload, token_budget

TEXTS = [
    "", " ", "plain", "tab\tand \"quotes\" \\ back\\slash", "line\nbreak\r\n", "\x00\x01\x08\x0b\x0c\x1f\x7f",
    "é ü 漢字 😀", "  \x85", "\\u001f", "</script>", "\x1c x \x1f", WHITESPACE + "core" + WHITESPACE,
]


def values(spark, column, data, dtype):
    df = spark.createDataFrame([(v,) for v in data], T.StructType([T.StructField("v", dtype)]))
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_strip_like_python(spark):
    assert values(spark, strip, TEXTS, T.StringType()) == [t.strip() for t in TEXTS]


def test_json_like_python(spark):
    assert values(spark, json_quote, TEXTS, T.StringType()) == [json.dumps(t, ensure_ascii=False) for t in TEXTS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), min_size=1, max_size=30))
def test_json_and_strip_of_any_text(spark, texts):
    assert values(spark, json_quote, texts, T.StringType()) == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert values(spark, strip, texts, T.StringType()) == [t.strip() for t in texts]


DOUBLES = [
    0.0, -0.0, 1.0, -1.5, 0.1, 1e7, 12345678.9, 1e15, 9.999e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, 1e100,
    5e-324, 1.7976931348623157e308, 2.1952932999999997e18, 1 / 3, 2 / 3 * 1e10, 123456789012345680.0, 0.00012345678901234567,
    math.inf, -math.inf, math.nan, 100.0, 2.0e-3, 9007199254740993.0, 1.0e23, 4.35, 1234567890123456.7,
]


def test_doubles_like_python(spark):
    got = values(spark, lambda c: canonical_string(c, T.DoubleType()), DOUBLES, T.DoubleType())
    assert got == [str(d) for d in DOUBLES]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_any_double_reads_back(spark, doubles):
    got = values(spark, lambda c: canonical_string(c, T.DoubleType()), doubles, T.DoubleType())
    assert [float(g) for g in got] == doubles
    assert [len(g) for g in got] == [len(str(d)) for d in doubles]


def test_other_types_like_python(spark):
    at = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 120000)]
    cases = [
        (T.BooleanType(), [True, False, None], ["True", "False", "null"]),
        (T.LongType(), [1, -5, None], ["1", "-5", "null"]),
        (T.BinaryType(), [b"ab", b"a\xffb", "é".encode()], ["ab", "a�b", "é"]),
        (T.TimestampNTZType(), at, [str(a) for a in at]),
        (T.DateType(), [datetime.date(2024, 1, 2)], ["2024-01-02"]),
        (T.FloatType(), [0.5, 0.10000000149011612], ["0.5", "0.10000000149011612"]),
        (T.StringType(), [None, "x"], ["null", "x"]),
        (T.ArrayType(T.IntegerType()), [[1, 2]], ["[1,2]"]),
    ]
    for dtype, data, want in cases:
        assert values(spark, lambda c, d=dtype: canonical_string(c, d), data, dtype) == want


@pytest.mark.parametrize("cell,filled", [
    (None, False), ("", False), ("  ", False), ("null", False), (" Na ", False), ("N/A", False), ("NULL\n", False),
    ("0", True), ("none", True), ("n / a", True), ("false", True),
])
def test_filled_cells(spark, cell, filled):
    assert values(spark, lambda c: is_filled(c, T.StringType()), [cell], T.StringType()) == [filled]


def test_nan_and_bytes_are_filled(spark):
    assert values(spark, lambda c: is_filled(c, T.DoubleType()), [math.nan, None], T.DoubleType()) == [True, False]
    assert values(spark, lambda c: is_filled(c, T.BinaryType()), [b"", None], T.BinaryType()) == [True, False]


def test_payload_layouts(spark):
    row = {'na"me': "é\n", "n": 1.0, "z": None}
    df = spark.createDataFrame([tuple(row.values())], 'struct<`na"me`: string, n: double, z: string>')
    want = {'na"me': "é\n", "n": "1.0", "z": "null"}
    for indent in (2, None):
        got = df.select(row_payload(df, list(row), indent)).first()[0]
        assert got == json.dumps(want, indent=indent, ensure_ascii=False)
    assert df.select(row_payload(df, [])).first()[0] == json.dumps({}, indent=2)


def test_budget_stays_in_range(spark):
    lengths = list(range(0, 1200, 7))
    got = values(spark, lambda c: token_budget(c, 13), lengths, T.IntegerType())
    assert got == [min(800, 200 + max(50, min(500, (n + 13) // 4 * 2))) for n in lengths]
    assert min(got) == 250 and max(got) == 700
    assert values(spark, approx_tokens, [0, 3, 4, 9], T.IntegerType()) == [1, 1, 1, 2]


def test_output_column_names():
    assert output_column_name(None) == "generated_column"
    assert output_column_name(["a", "b"]) == "a - b"
    assert output_column_name("b", ["b"], ["a", "b", "c"]) == "generated_2"
