"""Sources, sinks and header rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import WS, table
from rowloom.operators.headers import detect_header_rows, promote_headers
from rowloom.session import new_folder
from rowloom.sources.detect import detect_formats, encoding_of, guess_encoding
from rowloom.sources.documents import documents
from rowloom.sources.sinks import save_column, save_table
from rowloom.sources.tables import load_table, read_delimited, read_json, read_ragged


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority")


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that hold one array each, of at most 50,000 customers."""
    path = new_folder(spark, "json-arrays")
    record = F.struct("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    arrays = (
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(F.col("c_custkey") / 50_000).alias("file"))
        .agg(F.to_json(F.collect_list(record)).alias("value"))
    )
    arrays.write.partitionBy("file").text(path)
    return read_json(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "json-lines")
    table(spark, sf_dir, "part").write.json(path)
    return read_json(spark, path, lines=True)


def _dirty_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.when(key % 7 == 0, F.lit("NA")).when(key % 7 == 1, F.lit("N/A")).when(key % 7 == 2, F.lit("Na"))
    return table(spark, sf_dir, "supplier").select(
        key,
        name.otherwise(F.concat("s_name", F.lit(', "the" supplier'))).alias("name"),
        F.when(key % 3 == 0, F.lit("null")).otherwise(F.col("s_acctbal").cast("string")).alias("balance"),
        F.when(key % 2 == 0, F.lit("true")).otherwise(F.lit("false")).alias("even"),
    )


_DIRTY_SUPPLIERS = """
    SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 2 THEN 'Na'
                           WHEN s_suppkey % 7 > 2 THEN s_name || ', "the" supplier' END AS name,
           CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS balance, s_suppkey % 2 = 0 AS even
    FROM supplier"""


def _write_delimited(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "delimited")
    _dirty_suppliers(spark, sf_dir).write.options(header="false", sep=";", escape='"').csv(path)
    return path


def delimited_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_delimited(spark, sf_dir)
    return load_table(spark, path, infer=True).toDF("s_suppkey", "name", "balance", "even")


def delimited_string_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_delimited(spark, sf_dir)
    return read_delimited(spark, path, delimiter=";").toDF("s_suppkey", "name", "balance", "even")


def ragged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two to five fields, some blank."""
    path = new_folder(spark, "ragged")
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand", F.lit(" "), F.lit('"x'))
    line = F.array_join(F.slice(cells, 1, (F.col("p_partkey") % 4 + 2).cast("int")), "|")
    blank = F.when(F.col("p_partkey") % 6 == 0, F.lit("\n \t")).otherwise(F.lit(""))
    table(spark, sf_dir, "part").select(F.concat(line, blank).alias("value")).write.text(path)
    return read_ragged(spark, path, "|")


def _encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes: plain UTF-8, UTF-16 with a mark, and with a byte that UTF-8 does not allow."""
    key, text = F.col("doc_id"), F.col("text")
    plain = F.encode(text, "UTF-8")
    content = (
        F.when(key % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(key % 4 == 2, F.concat(plain, F.unhex(F.lit("E9"))))
        .otherwise(plain)
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", content.alias("content"))


def encoding_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded_documents(spark, sf_dir).select("doc_id", encoding_of(F.col("content")).alias("encoding"))


def delimiter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _encoded_documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "content")
    return detect_formats(files)


def encoding_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four charsets, with how sure the guess is."""
    key, text = F.col("doc_id"), F.col("text")
    # What lies beyond ISO-8859-1 becomes a question mark.
    latin = F.encode(F.regexp_replace(text, r"[^\x00-\xff]", "?"), "ISO-8859-1")
    content = (
        F.when(key % 4 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(key % 4 == 2, latin)
        .when(key % 4 == 3, F.concat(F.unhex(F.lit("93")), latin, F.unhex(F.lit("94"))))
        .otherwise(F.encode(text, "UTF-8"))
    )
    found = table(spark, sf_dir, "documents").select("doc_id", guess_encoding(content).alias("found"))
    return found.select("doc_id", "found.encoding", F.round("found.confidence", 6).alias("confidence"))


def long_cell_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quoted cells of one line each."""
    path = new_folder(spark, "long-cells")
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    table(spark, sf_dir, "documents").select("doc_id", flat).write.options(quoteAll="true", escape='"').csv(path)
    return load_table(spark, path).toDF("doc_id", "text")


def mixed_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files, files with quoted line ends, and one in which a quote is never closed."""
    path = new_folder(spark, "mixed")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.csv(f"{path}/a")
    broken = F.concat("c_name", F.lit('\nsays "'), "c_mktsegment", F.lit('", twice'))
    table(spark, sf_dir, "customer").select("c_custkey", broken).write.options(escape='"').csv(f"{path}/b")
    first = F.when(F.col("s_suppkey") == 1, F.lit('"')).otherwise(F.lit(""))
    table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit(","), first, "s_name")).write.text(f"{path}/c")
    return load_table(spark, f"{path}/[abc]").toDF("key", "name", "brand")


#: Text of one part of a saved table, about.
_PART_BYTES = 32 << 20


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved in parts with a header each, and loaded with one.

    There are three parts at least, and more for large tables: a part with quoted line ends is read whole by one task.
    """
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = save_table(docs.repartition(max(3, -(-size // _PART_BYTES)), "doc_id"), new_folder(spark, "round-trip") + ".csv")
    back = load_table(spark, path, row_id=True).toDF("row_id", "doc_id", "text", "lang", "source", "n_chars")
    return back.select((F.col("row_id") == 0).alias("is_header"), "doc_id", "text", "lang", "source", "n_chars")


def header_promote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small file with the header in front of larger ones."""
    path = new_folder(spark, "header-files")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("string"))
    titles = spark.createDataFrame([("Key,Priority,Total",), ("number,,in money",)], "value string").coalesce(1)
    titles.write.text(f"{path}/a")
    orders.write.csv(f"{path}/b")
    promoted = promote_headers(load_table(spark, f"{path}/[ab]", row_id=True), infer=True)
    return promoted.select(F.col("row_id") > 1, *promoted.columns[1:]).toDF("behind_header", *promoted.columns[1:])


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under different extensions; every third one in ISO-8859-1."""
    key = F.col("doc_id")
    suffix = F.get(F.array(F.lit(".txt"), F.lit(".md"), F.lit(".TXT"), F.lit(".bin")), (key % 4).cast("int"))
    latin = F.concat(F.unhex(F.lit("A0E9")), F.encode(F.regexp_replace("text", "[^\\x00-\\x7f]", ""), "UTF-8"))
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("some/folder/"), key.cast("string"), suffix).alias("path"),
        F.when(key % 3 == 0, latin).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    return documents(files).select("path", "doc_name", "size", "text")


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = save_table(table(spark, sf_dir, "documents"), new_folder(spark, "table") + ".out")
    back = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    return back.select(F.col("doc_id").cast("bigint"), "text", "lang", "source", F.col("n_chars").cast("bigint"))


def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = save_table(table(spark, sf_dir, "orders"), new_folder(spark, "table") + ".parquet")
    return load_table(spark, path)


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = save_table(_dirty_suppliers(spark, sf_dir), new_folder(spark, "table") + ".json")
    return read_json(spark, path, lines=True)


def column_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text sink wrote, as lines with their counts."""
    path = new_folder(spark, "column")
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("generated"))
    save_column(parts, "generated", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _with_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below two header rows; all cells are text, as after a delimited load."""
    titles = F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_id"), F.lit("Key").alias("a"), F.lit("Nation").alias("b"),
                 F.lit("").alias("c")),
        F.struct(F.lit(1).cast("bigint").alias("row_id"), F.lit("number").alias("a"), F.lit(None).cast("string").alias("b"),
                 F.lit("in region").alias("c")),
    )
    nations = table(spark, sf_dir, "nation")
    heads = nations.where(F.col("n_nationkey") == 0).select(F.inline(titles))
    return heads.unionByName(nations.select(
        (F.col("n_nationkey") + 2).cast("bigint").alias("row_id"), F.col("n_nationkey").cast("string").alias("a"),
        F.col("n_name").alias("b"), F.col("n_regionkey").cast("string").alias("c"),
    ))


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_header_rows(_with_headers(spark, sf_dir))


def header_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote_headers(_with_headers(spark, sf_dir), infer=True)


QUERIES = {
    "parquet_scan": parquet_scan,
    "json_array_scan": json_array_scan,
    "json_lines_scan": json_lines_scan,
    "delimited_typed_scan": delimited_typed_scan,
    "delimited_string_scan": delimited_string_scan,
    "ragged_scan": ragged_scan,
    "encoding_detect": encoding_detect,
    "delimiter_detect": delimiter_detect,
    "encoding_guess": encoding_guess,
    "long_cell_scan": long_cell_scan,
    "mixed_folder_scan": mixed_folder_scan,
    "csv_round_trip": csv_round_trip,
    "header_promote_files": header_promote_files,
    "document_scan": document_scan,
    "csv_sink": csv_sink,
    "parquet_sink": parquet_sink,
    "json_sink": json_sink,
    "column_text_sink": column_text_sink,
    "header_detect": header_detect,
    "header_promote": header_promote,
}

SQL = {
    "parquet_scan": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "json_array_scan": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer",
    "json_lines_scan": """SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice
        FROM part""",
    "delimited_typed_scan": _DIRTY_SUPPLIERS,
    "delimited_string_scan": f"""SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, name,
        CAST(balance AS VARCHAR) AS balance, CAST(even AS VARCHAR) AS even FROM ({_DIRTY_SUPPLIERS})""",
    "ragged_scan": """
        SELECT CAST(p_partkey AS VARCHAR) AS column_0, p_name AS column_1,
               CASE WHEN p_partkey % 4 >= 1 THEN p_brand ELSE '' END AS column_2,
               CASE WHEN p_partkey % 4 >= 2 THEN ' ' ELSE '' END AS column_3,
               CASE WHEN p_partkey % 4 >= 3 THEN '"x' ELSE '' END AS column_4
        FROM part""",
    "encoding_detect": """
        SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'utf-16'
                            WHEN doc_id % 4 = 2 THEN 'iso-8859-1'
                            ELSE 'utf-8' END AS encoding
        FROM documents""",
    "delimiter_detect": """
        WITH heads AS (
            SELECT CAST(doc_id AS VARCHAR) AS path,
                   CASE WHEN doc_id % 4 = 1 THEN 'utf-16'
                        WHEN doc_id % 4 = 2 THEN 'iso-8859-1'
                        ELSE 'utf-8' END AS encoding,
                   array_to_string(regexp_split_to_array(text, '\\r\\n|\\n|\\r')[1:5], chr(10)) AS head
            FROM documents),
        counts AS (
            SELECT path, encoding,
                   len(head) - len(replace(head, ',', '')) AS a, len(head) - len(replace(head, ';', '')) AS b,
                   len(head) - len(replace(head, chr(9), '')) AS c, len(head) - len(replace(head, '|', '')) AS d
            FROM heads)
        SELECT path, encoding,
               CASE greatest(a, b, c, d) WHEN 0 THEN ',' WHEN a THEN ',' WHEN b THEN ';' WHEN c THEN chr(9) ELSE '|' END
                   AS delimiter
        FROM counts""",
    "document_scan": f"""
        WITH files AS (
            SELECT doc_id, 'some/folder/' || doc_id || ['.txt', '.md', '.TXT', '.bin'][doc_id % 4 + 1] AS path,
                   CASE WHEN doc_id % 3 = 0 THEN chr(160) || chr(233) || regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')
                        ELSE text END AS body
            FROM documents)
        SELECT path, regexp_extract(path, '[^/]+$') AS doc_name,
               CAST(CASE WHEN doc_id % 3 = 0 THEN len(body) ELSE octet_length(encode(body)) END AS BIGINT) AS size,
               CASE WHEN doc_id % 4 < 3
                    THEN trim(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {WS}) END AS text
        FROM files""",
    "encoding_guess": """
        WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{80}-\\x{ff}]', '', 'g')) AS high,
                          length(regexp_replace(text, '[^\\x{a0}-\\x{bf}\\x{d7}\\x{f7}]', '', 'g')) AS odd FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'utf-16' WHEN doc_id % 4 = 0 OR doc_id % 4 = 2 AND high = 0 THEN 'utf-8'
                            WHEN doc_id % 4 = 3 AND (high + 2 - odd) / (high + 2) >= 0.7 THEN 'windows-1252' ELSE 'iso-8859-1' END AS encoding,
               CAST(round(CASE WHEN doc_id % 4 < 2 OR doc_id % 4 = 2 AND high = 0 THEN 1
                               WHEN doc_id % 4 = 2 THEN (high - odd) / high ELSE (high + 2 - odd) / (high + 2) END, 6) AS DOUBLE) AS confidence
        FROM c""",
    "long_cell_scan": r"""
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents""",
    "mixed_folder_scan": """
        SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name, p_brand AS brand FROM part
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name || chr(10) || 'says "' || c_mktsegment || '", twice', NULL FROM customer
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE s_suppkey WHEN 1 THEN '"' ELSE '' END || s_name, NULL FROM supplier""",
    "csv_round_trip": """
        SELECT false AS is_header, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents
        UNION ALL SELECT true, 'doc_id', 'text', 'lang', 'source', 'n_chars'""",
    "header_promote_files": """
        SELECT true AS behind_header, o_orderkey AS "[A] Key - number", o_orderpriority AS "[B] Priority",
               o_totalprice AS "[C] Total - in money" FROM orders""",
    "csv_sink": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "parquet_sink": "SELECT * FROM orders",
    "json_sink": """
        SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN 'Na'
                               ELSE s_name || ', "the" supplier' END AS name,
               CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(s_acctbal AS VARCHAR) END AS balance,
               CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS even
        FROM supplier""",
    "column_text_sink": """
        SELECT line, count(*) AS n
        FROM (SELECT CASE WHEN p_size % 5 <> 0 THEN p_name ELSE '' END AS line FROM part
              UNION ALL SELECT '---' FROM part)
        GROUP BY line""",
    "header_detect": """
        SELECT CASE WHEN count(*) + 2 < 5 THEN 1 ELSE 2 END AS header_rows,
               CAST(CASE WHEN count(*) + 2 < 5 THEN 0.5 ELSE 0.7 END AS DOUBLE) AS confidence
        FROM nation""",
    "header_promote": """
        SELECT CAST(n_nationkey + 2 AS BIGINT) AS row_id, CAST(n_nationkey AS BIGINT) AS "[A] Key - number",
               n_name AS "[B] Nation", CAST(n_regionkey AS BIGINT) AS "[C] in region"
        FROM nation""",
}
