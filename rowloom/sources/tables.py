"""Table sources: Parquet, JSON and delimited text in its three forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.names import all_named, named
from rowloom.functions.text import NULL_TOKENS, strip
from rowloom.session import written
from rowloom.sources.detect import decoded_delimiters, file_formats, from_latin, head_of
from rowloom.sources.sinks import header_of

ROW_ID = "row_id"
#: Where a row stands: file, start of its split, and a number that grows within the split.
_PLACE = "__rowloom_place"

#: How the cells of a delimited file are told apart.
PLAIN, QUOTED_LINES, RAGGED = "plain", "quoted line ends", "ragged"

Paths = str | list[str]


def load_table(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    delimiter: str | None = None,
    infer: bool = False,
    row_id: bool = False,
    multi_line: bool | None = None,
    columns: int | None = None,
) -> DataFrame:
    """Reads a table by the suffix of ``path``; anything unknown is delimited text.

    Encoding, delimiter and form of text are found for each file by itself unless given; files that agree are read together. A
    delimited file in which a quoted cell holds line ends is read whole (``multi_line`` settles it for all files); one with a quote
    that nothing closes is split at every delimiter, so that no cell swallows the rest. ``columns`` cuts and fills rows.
    A folder that ``save_table`` wrote gives its header once, as the first row.
    ``row_id=True`` numbers the rows from 0 in the order of the files' names and of the rows in them.
    """
    if path.endswith(".parquet"):
        parts = [_placed(read_parquet(spark, path), row_id)]
    elif path.endswith(".json"):
        groups = _format_groups(spark, path, True, encoding, delimiter)
        parts = _json_parts(spark, groups, row_id)
    else:
        known = header_of(spark, path)
        header = known and known["columns"]
        if known:
            encoding, delimiter = encoding or known["encoding"], delimiter or known["delimiter"]
        if encoding is None or delimiter is None:
            groups = _format_groups(spark, path, False, encoding, delimiter)
        else:
            groups = {(encoding, delimiter, False): path}
        parts = [
            part for (charset, sep, _), paths in groups.items()
            for part in _delimited_parts(spark, paths, sep, charset, multi_line, columns, header, row_id)
        ]
        if len(parts) > 1:
            parts = [_plain_names(part) for part in parts]
        if header:
            titles = spark.createDataFrame([tuple(header)], T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))]))
            place = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("at"))
            parts = [titles.select(place.alias(_PLACE), "*") if row_id else titles, *parts]
    df = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), parts)
    if infer and not path.endswith((".parquet", ".json")):
        df = typed(df, keep=[_PLACE])
    return _numbered(df) if row_id else df


def _placed(df: DataFrame, wanted: bool = True) -> DataFrame:
    """A table as it was read, with the place of every row in front."""
    if not wanted:
        return df
    meta = df.metadataColumn("_metadata")
    place = F.struct(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at")
    )
    return df.select(place.alias(_PLACE), "*")


def _numbered(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Numbers rows with a place from 0: splits in the order of file and start, rows by their place in the split.

    What is summed up and joined has a row per split, as many as the scan has tasks at most.
    """
    split = [F.xxhash64(f"{_PLACE}.file").alias("_file"), F.col(f"{_PLACE}.start").alias("_start")]
    splits = df.groupBy(f"{_PLACE}.file", f"{_PLACE}.start").agg(F.count("*").alias("n"), F.min(f"{_PLACE}.at").alias("_first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        F.xxhash64("file").alias("_file"), F.col("start").alias("_start"), "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")
    )
    kept = [c for c in df.columns if c != _PLACE]
    rows = df.select(*split, F.col(f"{_PLACE}.at").alias("_at"), F.struct(*all_named(kept)).alias("_row"))
    joined = rows.join(F.broadcast(offsets), ["_file", "_start"])
    number = (F.col("_offset") + F.col("_at") - F.col("_first")).alias(name)
    return joined.select(number, *[F.col("_row").getField(c).alias(c) for c in kept])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(
    spark: SparkSession, path: str | list[str], lines: bool = False, encoding: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """An array of records per file, or one record per line with ``lines=True``.

    A file that is one array is read by one task; large data belongs in JSON Lines.
    """
    reader = spark.read.option("multiLine", not lines)
    if encoding:
        reader = reader.option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _format_groups(
    spark: SparkSession, path: str, is_json: bool, encoding: str | None, delimiter: str | None
) -> dict[tuple[str, str, bool], Paths]:
    """The files by (encoding, delimiter, whether JSON Lines); ``path`` itself where all agree."""
    formats = file_formats(spark, path)
    first = F.trim("first_line")
    # An array, or an object over several lines, does not begin with a line that is a whole object.
    lines = first.startswith("{") & F.try_parse_json(first).isNotNull() if is_json else F.lit(False)
    formats = formats.select(
        "path", "partitioned", F.coalesce(lines, F.lit(False)).alias("lines"),
        (F.lit(encoding) if encoding else F.col("encoding")).alias("encoding"),
        (F.lit(delimiter or ",") if delimiter or is_json else F.col("delimiter")).alias("delimiter"),
    )
    formats = written(formats, "formats")
    kinds = [tuple(r) for r in formats.select("encoding", "delimiter", "lines", "partitioned").distinct().collect()]
    if not kinds:
        head_of(spark, path)  # says that there is no data
    marked = not is_json and not delimiter and any(k[0].startswith(("utf-16", "utf-32")) for k in kinds)
    if len(kinds) == 1 and not marked:
        return {kinds[0][:3]: path}
    if len(kinds) > 1 and any(k[3] for k in kinds):
        raise ValueError(f"files of several formats in a partitioned folder: {path}")
    rows = {r["path"]: (r["encoding"], r["delimiter"], r["lines"]) for r in formats.collect()}
    if marked:
        paths = [_literal(p) for p, found in rows.items() if found[0].startswith(("utf-16", "utf-32"))]
        for p, sep in decoded_delimiters(spark, paths).collect():
            rows[p] = (rows[p][0], sep, rows[p][2])
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for p in sorted(rows):
        groups.setdefault(rows[p], []).append(_literal(p))
    return dict.fromkeys(groups, path) if len(groups) == 1 else groups


def _literal(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _json_parts(spark: SparkSession, groups: dict[tuple[str, str, bool], Paths], place: bool) -> list[DataFrame]:
    parts = [(paths, lines, "iso-8859-1" if charset == "windows-1252" else charset) for (charset, _, lines), paths in groups.items()]
    found = [read_json(spark, *part) for part in parts]
    if len(found) > 1:
        schema = reduce(_common, [df.schema for df in found])
        found = [read_json(spark, *part, schema=schema) for part in parts]
    return [_placed(df, place) for df in found]


def _plain_names(part: DataFrame) -> DataFrame:
    return part.withColumnsRenamed({c: "_c" + c.removeprefix("column_") for c in part.columns if c.startswith("column_")})


def _delimited_parts(
    spark: SparkSession, paths: Paths, delimiter: str, charset: str, multi_line: bool | None, columns: int | None,
    header: list[str] | None, place: bool,
) -> list[DataFrame]:
    """The files of one format, by how their cells are told apart."""
    western = charset == "windows-1252"
    encoding = "iso-8859-1" if western else charset
    routes: dict[str, tuple[Paths, int]]
    if multi_line is not None or encoding.lower().startswith(("utf-16", "utf-32")):
        whole = bool(multi_line) or encoding.lower().startswith(("utf-16", "utf-32"))
        width = columns or _width(spark, paths, delimiter, encoding, whole)
        routes = {QUOTED_LINES if whole else PLAIN: (paths, width)}
    else:
        routes = _routes(spark, paths, delimiter, encoding)
    if header:
        # One writer wrote all parts.
        routes = {PLAIN if set(routes) == {PLAIN} else QUOTED_LINES: (paths, len(header))}
    parts = []
    for route, (own, width) in routes.items():
        if route == RAGGED:
            part = read_ragged(spark, own, delimiter, encoding, place=place)
        else:
            wide = width or _width(spark, own, delimiter, encoding, True)
            part = read_delimited(
                spark, own, delimiter, encoding, columns=columns or wide, multi_line=route == QUOTED_LINES, place=place, header=bool(header)
            )
        if western:
            cells = [c for c in part.columns if c != _PLACE]
            part = part.select(*[c for c in part.columns if c == _PLACE], *[from_latin(named(c)).alias(c) for c in cells])
        parts.append(part)
    return parts


def _routes(spark: SparkSession, paths: Paths, delimiter: str, encoding: str) -> dict[str, tuple[Paths, int]]:
    """How the files of one format have to be read, each with the most cells of any line.

    One scan: a line whose last quoted cell stays open, in a file whose quotes pair up, has line ends inside quotes; in
    a file whose quotes do not, a quote was never closed. Quotes inside of cells open nothing.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("name"), "value")
    bare = F.regexp_replace("value", _QUOTED, "")
    opens = bare.rlike(f'(^|{re.escape(delimiter)})[ \t]*"')
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    facts = lines.select("name", opens.alias("opens"), quotes.alias("quotes"), _cells(bare, delimiter).alias("cells")).groupBy("name").agg(
        F.bool_or("opens").alias("opens"), (F.sum("quotes") % 2 == 1).alias("odd"), F.max("cells").alias("cells")
    )
    route = F.when(~F.col("opens"), PLAIN).when(F.col("odd"), RAGGED).otherwise(QUOTED_LINES)
    facts = written(facts.select("name", route.alias("route"), "cells"), "routes")
    found = {r["route"]: r["cells"] for r in facts.groupBy("route").agg(F.max("cells").alias("cells")).collect()}
    # The width of rows over several lines is counted over whole files.
    widths = {route: 0 if route == QUOTED_LINES else cells for route, cells in found.items()}
    if len(found) <= 1:
        return {route: (paths, widths[route]) for route in found} or {PLAIN: (paths, 1)}
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("name"))
    by_route: dict[str, list[str]] = {}
    for p, r in files.join(facts, "name").select("path", "route").orderBy("path").collect():
        by_route.setdefault(r, []).append(_literal(p))
    return {route: (own, widths[route]) for route, own in sorted(by_route.items())}


def _common(one: T.DataType, other: T.DataType) -> T.DataType:
    """The type that holds values of both without loss; text where nothing else does."""
    if one == other:
        return one
    if isinstance(one, T.StructType) and isinstance(other, T.StructType):
        left, right = ({f.name: f.dataType for f in kind.fields} for kind in (one, other))
        both = {**right, **left, **{n: _common(left[n], right[n]) for n in left.keys() & right.keys()}}
        return T.StructType([T.StructField(n, both[n]) for n in sorted(both)])
    if isinstance(one, T.ArrayType) and isinstance(other, T.ArrayType):
        return T.ArrayType(_common(one.elementType, other.elementType))
    if {one, other} == {T.LongType(), T.DoubleType()}:
        return T.DoubleType()
    return T.StringType()


def read_delimited(
    spark: SparkSession,
    path: Paths,
    delimiter: str = ",",
    encoding: str = "utf-8",
    infer: bool = False,
    columns: int | None = None,
    multi_line: bool = False,
    place: bool = False,
    header: bool = False,
) -> DataFrame:
    """Header-less delimited text; null tokens become null, short rows are filled with null.

    The table is as wide as its widest line, found by one pass; ``columns`` saves the pass, and cuts what
    is wider. All columns are strings by default. With ``infer=True`` all rows decide the types, and a
    column with a cell that does not fit stays a string, so nothing is lost. ``multi_line=True`` allows line ends inside quotes, at the price of one task
    per file; UTF-16 and UTF-32 files are always read that way. ``header=True`` leaves out the first record of every file.
    """
    whole_files = multi_line or encoding.lower().startswith(("utf-16", "utf-32"))
    if columns is None:
        columns = _width(spark, path, delimiter, encoding, whole_files)
    reader = spark.read.options(
        header=str(header).lower(), enforceSchema="true", sep=delimiter, encoding=encoding, mode="PERMISSIVE",
        quote='"', escape='"', multiLine=str(whole_files).lower(), maxColumns=str(max(20_480, columns)),
    )
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(columns)])
    cells = _without_tokens(_placed(reader.schema(schema).csv(path), place))
    return typed(cells, keep=[_PLACE]) if infer else cells


#: A quoted cell, or the part of one up to a doubled quote.
_QUOTED = '"[^"]*"'


def _cells(bare: Column, delimiter: str) -> Column:
    """How many cells the longest line of a text without quoted cells has."""
    if len(delimiter) == 1 and delimiter.isascii():
        each = F.split(bare, r"\r\n|\r|\n")
        return F.array_max(F.transform(each, lambda line: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(delimiter), F.lit(""))))) + 1
    return F.array_max(F.transform(F.split(bare, r"\r\n|\r|\n"), lambda line: F.size(F.split(line, re.escape(delimiter), -1))))


def _width(spark: SparkSession, path: Paths, delimiter: str, encoding: str, whole_files: bool) -> int:
    """The most cells of any line: its delimiters outside quotes, and one."""
    if encoding.lower().startswith(("utf-16", "utf-32")):
        content = spark.read.format("binaryFile").load(path).select("content")
        lines = content.select(F.decode("content", encoding).alias("value"))
    else:
        # Delimiters, quotes and line ends are single bytes in all other charsets.
        lines = spark.read.option("wholetext", str(whole_files).lower()).text(path)
    cells = _cells(F.regexp_replace("value", _QUOTED, ""), delimiter)
    return lines.select(cells.alias("n")).agg(F.max("n")).first()[0] or 1


def _without_tokens(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(c) if c == _PLACE else F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in df.columns]
    )


def typed(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Casts each column to the first of long, double, boolean that all of its cells fit."""
    cells = [c for c in df.columns if c not in keep]
    checks = []
    for i, c in enumerate(cells):
        value = named(c)
        number = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        checks += [
            F.every(value.isNull() | value.try_cast("bigint").isNotNull()).alias(f"{i}_bigint"),
            F.every(value.isNull() | number).alias(f"{i}_double"),
            F.every(value.isNull() | value.isin("true", "false")).alias(f"{i}_boolean"),
            F.count(value).alias(f"{i}_seen"),
        ]
    fits = df.agg(*checks).first()
    kinds = {
        c: next((k for k in ("bigint", "double", "boolean") if fits[f"{i}_{k}"]), "string")
        for i, c in enumerate(cells)
        if fits[f"{i}_seen"]
    }
    return df.select(
        *[named(c).try_cast(kinds.get(c, "string")).alias(c) if c in cells else named(c) for c in df.columns]
    )


def read_ragged(spark: SparkSession, path: Paths, delimiter: str = ",", encoding: str = "utf-8", place: bool = False) -> DataFrame:
    """Lines split at every delimiter, without quoting; blank lines skipped, short rows padded with ``''``.

    The width is the longest row, found by one aggregate over the split sizes.
    """
    if encoding.lower().startswith(("utf-16", "utf-32")):
        raise ValueError("ragged text must be in a charset whose line ends are single bytes")
    line = F.col("value")
    if encoding.lower() not in ("utf-8", "utf8"):
        line = F.decode(line.cast("binary"), encoding)
    lines = _placed(spark.read.text(path), place)
    own = [F.col(_PLACE)] if place else []
    lines = lines.select(*own, line.alias("line"))
    cells = lines.where(F.length(strip(F.col("line"))) > 0).select(
        *own, F.split("line", re.escape(delimiter), -1).alias("cells")
    )
    width = cells.agg(F.max(F.size("cells"))).first()[0] or 0
    return cells.select(
        *own, *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"column_{i}") for i in range(width)]
    )


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Adds an increasing id to any table, in the order in which Spark deals its rows to tasks.

    ``load_table(row_id=True)`` numbers rows by the order of the files instead; for consecutive numbers along a column see
    ``rowloom.plans.scale.with_position``.
    """
    return df.select(F.monotonically_increasing_id().alias(name), "*")
