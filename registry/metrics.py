"""Usage metrics, few-shot examples and file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import sql_json, table
from rowloom.operators.examples import build_examples, format_examples
from rowloom.operators.manifest import group_shards, reconcile, set_sizes, shard_sets
from rowloom.operators.usage import calibration, recent_speed, remaining_time, running_totals, usage_totals


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies: a run per event type, a definition per remainder of the user."""
    k = F.regexp_extract("props", "(\\d+)", 1).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("def_id"),
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 7 % 211).alias("prompt_tokens"),
        F.when(k % 4 == 0, F.lit(0)).otherwise(k).alias("completion_tokens"),
        (F.col("event_id") % 13 * 0.25 + 0.25).cast("double").alias("seconds"),
        (F.col("event_id") % 50).cast("bigint").alias("input_est"),
    )


USAGE = """
    SELECT event_type AS run_id, CAST(user_id % 3 AS INTEGER) AS def_id, event_id AS seq,
           user_id * 7 % 211 AS prompt_tokens, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS completion_tokens,
           CAST(event_id % 13 * 0.25 + 0.25 AS DOUBLE) AS seconds, event_id % 50 AS input_est
    FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)"""


def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_totals(usage(spark, sf_dir)).select("run_id", "seq", "total_prompt", "total_completion", "total_tokens")


def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_totals(usage(spark, sf_dir))


def speed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    speeds = recent_speed(usage(spark, sf_dir))
    return speeds.select("run_id", "seq", F.round("recent_speed", 6).alias("recent_speed"))


def first_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = calibration(usage(spark, sf_dir))
    return facts.select("run_id", "def_id", F.round("ratio", 6).alias("ratio"), F.round("speed", 6).alias("speed"))


def time_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remaining_time(usage(spark, sf_dir)).select("run_id", "def_id", "seq", "remaining_seconds")


def built_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example per part, from the customer of the same number; some numbers have no row."""
    key = F.col("p_partkey")
    examples = table(spark, sf_dir, "part").select(
        key.alias("def_id"), (key + 1).alias("row_no"), F.concat(F.col("p_name"), F.lit(" \n")).alias("text"),
        F.when(key % 3 == 0, F.concat("p_type", F.lit("\nsecond line"))).when(key % 3 == 1, F.lit(" ")).alias("document"),
    )
    rows = table(spark, sf_dir, "customer").withColumn("row_no", F.col("c_custkey") + 1)
    return build_examples(examples, rows, ["c_mktsegment", "c_name"]).select("def_id", "row_no", "example")


def formatted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("def_id"), F.col("p_partkey").alias("row_no"), F.col("p_name").alias("text")
    )
    return format_examples(examples, most_bytes=2_000)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: sets of four, some short of a part or of one mind, and files of their own."""
    key = F.col("p_partkey")
    number = F.floor(key / 4)
    total = F.when(number % 5 == 0, F.lit(5)).when((number % 7 == 0) & (key % 4 == 3), F.lit(3)).otherwise(F.lit(4))
    shard = F.concat(
        F.lit("set-"), number.cast("string"), F.lit("-0"), (key % 4 + 1).cast("string"),
        F.lit("-of-0"), total.cast("string"), F.lit(".gguf"),
    )
    name = F.when(key % 41 == 0, F.concat("p_name", F.lit("-"), key.cast("string"), F.lit(".gguf"))).otherwise(shard)
    return table(spark, sf_dir, "part").select(
        name.alias("name"),
        F.when(key % 23 != 0, F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("size"),
    )


def set_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_sets(listing(spark, sf_dir))


def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_shards(listing(spark, sf_dir))


def sizes_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sizes(listing(spark, sf_dir))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit("-"), key.cast("string"))
    local = parts.select(name.alias("name"), F.col("p_size").cast("bigint").alias("size"))
    listed = F.when(key % 17 == 0, F.concat(F.lit("other-"), name)).otherwise(name)
    remote = parts.select(
        listed.alias("name"),
        F.when(key % 29 == 0, F.lit(None)).when(key % 31 == 0, F.lit(0)).when(key % 19 == 0, F.col("p_size") + 1)
        .otherwise(F.col("p_size")).cast("bigint").alias("size"),
    )
    return reconcile(local, remote)


QUERIES = {
    "usage_running": usage_running,
    "usage_sums": usage_sums,
    "speed_recent": speed_recent,
    "first_calibration": first_calibration,
    "time_remaining": time_remaining,
    "built_examples": built_examples,
    "formatted_examples": formatted_examples,
    "set_list": set_list,
    "file_groups": file_groups,
    "sizes_sorted": sizes_sorted,
    "reconciled": reconciled,
}

_CALIBRATION = f"""
    SELECT run_id, def_id, greatest(0.2, least(8.0, ct / greatest(1, est))) AS ratio, greatest(1e-6, ct / dt) AS speed
    FROM (SELECT run_id, def_id, CAST(arg_min(completion_tokens, seq) AS DOUBLE) AS ct, arg_min(seconds, seq) AS dt,
                 arg_min(input_est, seq) AS est
          FROM ({USAGE}) GROUP BY run_id, def_id)"""

_LISTING = """
    SELECT CASE WHEN p_partkey % 41 = 0 THEN p_name || '-' || p_partkey || '.gguf'
                ELSE 'set-' || p_partkey // 4 || '-0' || (p_partkey % 4 + 1) || '-of-0'
                     || CASE WHEN p_partkey // 4 % 5 = 0 THEN 5 WHEN p_partkey // 4 % 7 = 0 AND p_partkey % 4 = 3 THEN 3
                             ELSE 4 END || '.gguf' END AS name,
           CASE WHEN p_partkey % 23 <> 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS size
    FROM part"""

_SHARDS = f"""
    SELECT name, size, regexp_extract(name, '^(.+)-(\\d+)-of-(\\d+)\\.gguf$', 1) AS base,
           TRY_CAST(regexp_extract(name, '^(.+)-(\\d+)-of-(\\d+)\\.gguf$', 2) AS BIGINT) AS part,
           TRY_CAST(regexp_extract(name, '^(.+)-(\\d+)-of-(\\d+)\\.gguf$', 3) AS BIGINT) AS total
    FROM ({_LISTING})"""

_SETS = f"""
    SELECT base, count(*) AS parts, CASE WHEN count(size) = count(*) THEN CAST(sum(size) AS BIGINT) END AS size,
           min(total) = max(total) AND list_sort(list(part)) = range(1, min(total) + 1) AS complete
    FROM ({_SHARDS}) WHERE base <> '' GROUP BY base"""

SQL = {
    "usage_running": f"""
        SELECT run_id, seq, CAST(sum(prompt_tokens) OVER w AS BIGINT) AS total_prompt,
               CAST(sum(completion_tokens) OVER w AS BIGINT) AS total_completion,
               CAST(sum(prompt_tokens + completion_tokens) OVER w AS BIGINT) AS total_tokens
        FROM ({USAGE}) WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
    "usage_sums": f"""
        SELECT run_id, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt,
               CAST(sum(completion_tokens) AS BIGINT) AS total_completion,
               CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens
        FROM ({USAGE}) GROUP BY run_id""",
    "speed_recent": f"""
        SELECT run_id, seq, round(avg(completion_tokens / seconds) OVER (
                   PARTITION BY run_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS recent_speed
        FROM ({USAGE}) WHERE completion_tokens > 0""",
    "first_calibration": f"SELECT run_id, def_id, round(ratio, 6) AS ratio, round(speed, 6) AS speed FROM ({_CALIBRATION})",
    "time_remaining": f"""
        SELECT run_id, def_id, seq, CAST(floor(ratio * CAST(following AS DOUBLE) / speed) AS BIGINT) AS remaining_seconds
        FROM (SELECT *, coalesce(sum(greatest(1, input_est)) OVER (
                  PARTITION BY run_id, def_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS following
              FROM ({USAGE}))
        JOIN ({_CALIBRATION}) USING (run_id, def_id)""",
    "built_examples": f"""
        SELECT p_partkey AS def_id, p_partkey + 1 AS row_no,
               CASE WHEN c_custkey IS NULL THEN ''
                    ELSE 'Example:' || chr(10) || 'Source data: {{' || chr(10) || '  "c_mktsegment": ' || {sql_json('c_mktsegment')}
                         || ',' || chr(10) || '  "c_name": ' || {sql_json('c_name')} || chr(10) || '}}' || chr(10)
                         || CASE WHEN p_partkey % 3 = 0 THEN 'Document input: ' || p_type || chr(10) || 'second line' || chr(10)
                                 ELSE '' END END
               || 'Expected output: ' || p_name AS example
        FROM part LEFT JOIN customer ON c_custkey = p_partkey""",
    "formatted_examples": """
        WITH e AS (SELECT p_size, p_partkey, 'Row ' || p_partkey || ': ' || p_name AS item FROM part),
        b AS (SELECT *, CAST(sum(octet_length(encode(item)) + 2) OVER (PARTITION BY p_size ORDER BY p_partkey)
                             - octet_length(encode(item)) - 2 AS BIGINT) // 2000 AS piece FROM e)
        SELECT p_size AS def_id, piece, string_agg(item, chr(10) || chr(10) ORDER BY p_partkey) AS example
        FROM b GROUP BY p_size, piece""",
    "set_list": _SETS,
    "file_groups": f"""
        SELECT f.name, f.size, CASE WHEN s.complete THEN f.base ELSE f.name END AS group_name,
               CASE WHEN s.complete THEN f.part END AS part
        FROM ({_SHARDS}) f LEFT JOIN ({_SETS}) s USING (base)""",
    "sizes_sorted": f"""
        SELECT base || '.gguf' AS name, size, parts FROM ({_SETS}) WHERE complete
        UNION ALL
        SELECT f.name, f.size, 1 AS parts FROM ({_SHARDS}) f LEFT JOIN ({_SETS}) s USING (base)
        WHERE NOT coalesce(s.complete, false)""",
    "reconciled": """
        SELECT name, size, remote_size, reason, reason IN ('missing', 'size') AS corrupted
        FROM (SELECT p_name || '-' || p_partkey AS name, CAST(p_size AS BIGINT) AS size,
                     CASE WHEN p_partkey % 17 <> 0 THEN CAST(CASE WHEN p_partkey % 29 = 0 THEN NULL
                          WHEN p_partkey % 31 = 0 THEN 0 WHEN p_partkey % 19 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT)
                          END AS remote_size,
                     CASE WHEN p_partkey % 17 = 0 THEN 'missing' WHEN p_partkey % 29 = 0 OR p_partkey % 31 = 0 THEN 'unverified'
                          WHEN p_partkey % 19 = 0 THEN 'size' WHEN p_size = 0 THEN 'unverified' ELSE 'ok' END AS reason
              FROM part)""",
}
