"""String rules shared by all operators, as native Column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The cells that count as empty, after strip and lower-casing.
EMPTY_WORDS = ("", "null", "na", "n/a")

# The cells that become null while a delimited file is read.
NULL_TOKENS = ("", "NULL", "null", "NA", "na", "N/A", "n/a")

_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_RARE_ESCAPES = tuple(
    (chr(code), json.dumps(chr(code))[1:-1]) for code in range(32) if chr(code) not in "\n\r\t"
)


def strip(text: Column) -> Column:
    """``str.strip()``: Spark's own trim removes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def whitespace_class(negated: bool = False) -> str:
    """The strip characters as a Java regex class (``\\s`` covers only the ASCII ones)."""
    body = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"[^{body}]" if negated else f"[{body}]"


def is_filled(column: Column, dtype: T.DataType) -> Column:
    """True when a cell holds something.

    Only text can spell an empty word, so other types need no string work and the
    predicate reaches the Parquet reader as a plain null check.
    """
    if not isinstance(dtype, T.StringType):
        return column.isNotNull()
    return F.coalesce(~F.lower(strip(column)).isin(*EMPTY_WORDS), F.lit(False))


def _float_text(value: Column) -> Column:
    """A double the way Python prints it (``10000000.0``, ``1e+16``, ``1e-05``)."""
    size = F.abs(value)
    java = value.cast("string")
    # Older Java versions print some doubles with more digits than needed; only long texts can be
    # such, and the tiniest numbers.
    long = (F.length(java) >= 17) & (F.length(F.regexp_replace(java, "E.*|[^0-9]", "")) >= 16)
    shortest = F.when(long | (size < _SMALLEST_NORMAL), _shortest(value, java)).otherwise(java)
    plain = F.when(long, _as_plain(shortest)).when((size >= 1e-3) & (size < 1e7), java).otherwise(
        F.call_function("format_number", value, F.lit("0.0" + "#" * 20))
    )
    return (
        F.when((size >= 1e-3) & (size < 1e7) & (F.length(java) < 17), java)
        .when(F.isnan(value), F.lit("nan"))
        .when(size == F.lit(float("inf")), F.lower(F.replace(java, F.lit("Infinity"), F.lit("inf"))))
        .when(value == 0, java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(_as_scientific(shortest))
    )


_SMALLEST_NORMAL = 2.2250738585072014e-308


def _shortest(value: Column, java: Column) -> Column:
    """The scientific form with the fewest digits that reads back as the same number.

    Fewer than 15 digits that do so appear as 15 with zeros at the end, except for the tiniest numbers.
    """
    least = F.when(F.abs(value) < _SMALLEST_NORMAL, F.lit(0)).otherwise(F.lit(14))
    forms = F.transform(
        F.sequence(least, F.lit(16)),
        lambda n: F.call_function("format_string", F.concat(F.lit("%."), n.cast("string"), F.lit("e")), value),
    )
    return F.coalesce(F.get(F.filter(forms, lambda form: form.cast("double") == value), F.lit(0)), java)


def _as_plain(number: Column) -> Column:
    digits = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), "0+$", "")
    return F.regexp_replace(digits, r"\.$", ".0")


def _as_scientific(number: Column) -> Column:
    text = F.regexp_replace(F.upper(number), r"\.?0*E", "E")
    text = F.regexp_replace(F.regexp_replace(text, r"E\+?(?=\d)", "e+"), "E", "e")
    return F.regexp_replace(text, r"(?<=e[+-])(?=\d$)", "0")


def _time_text(value: Column, zone: bool) -> Column:
    seconds = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    text = F.concat(seconds, F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)))
    return F.concat(text, F.date_format(value, "xxx")) if zone else text


def canonical_string(column: Column, dtype: T.DataType) -> Column:
    """A cell as text: null is ``null``, bytes are UTF-8 with replacement, else Python's ``str``.

    Nested values become JSON.
    """
    if isinstance(dtype, T.StringType):
        text = column
    elif isinstance(dtype, T.BinaryType):
        text = F.make_valid_utf8(column.cast("string"))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(column, F.lit("True")).when(~column, F.lit("False"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(column.cast("double"))
    elif isinstance(dtype, T.TimestampType):
        text = _time_text(column, zone=True)
    elif isinstance(dtype, T.TimestampNTZType):
        text = _time_text(column, zone=False)
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("null"))


def json_quote(text: Column) -> Column:
    """``json.dumps(text, ensure_ascii=False)`` for one string.

    Spark's own JSON differs only in the rare control characters, which it writes with capital
    hex digits; texts that may have one take the longer way.
    """
    quoted = F.to_json(F.array(text))
    usual = F.btrim(quoted, F.lit("[]"))
    return F.when(
        text.isNotNull(), F.when(F.contains(quoted, F.lit("\\u00")), _escaped(text)).otherwise(usual)
    )


def _escaped(text: Column) -> Column:
    for char, escape in _SHORT_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    rare = F.array(*[F.struct(F.lit(c).alias("char"), F.lit(e).alias("escape")) for c, e in _RARE_ESCAPES])
    out = F.aggregate(rare, text, lambda acc, pair: F.replace(acc, pair["char"], pair["escape"]))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_object(pairs: Sequence[tuple[str, Column]], indent: int | None = None) -> Column:
    """A flat JSON object of string values, keys in the given order.

    ``indent=None`` gives the compact form (``", "`` and ``": "``), ``indent=2`` the
    layout used in prompts.
    """
    if not pairs:
        return F.lit("{}")
    pad = "" if indent is None else "\n" + " " * indent
    parts: list[Column] = []
    for number, (key, value) in enumerate(pairs):
        lead = "{" if number == 0 else ("," if indent is not None else ", ")
        parts += [F.lit(lead + pad + json.dumps(key, ensure_ascii=False) + ": "), json_quote(value)]
    parts.append(F.lit("}" if indent is None else "\n}"))
    return F.concat(*parts)
