"""Tables and cells that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.text import WHITESPACE

#: The strip characters as an SQL literal.
WS = f"'{WHITESPACE}'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with blank, null and ``N/A`` cells; ``row_id`` is the key."""
    key = F.col("c_custkey")
    name = (
        F.when(key % 3 == 0, F.lit(" N/a\t")).when(key % 5 == 0, F.lit("  ")).when(key % 7 != 0, F.col("c_name"))
    )
    segment = F.when(key % 2 == 0, F.lit("null")).when(key % 11 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        key.alias("row_id"), name.alias("name"), segment.alias("segment"), F.col("c_acctbal").alias("balance")
    )


MESSY_CUSTOMERS = """
    SELECT c_custkey AS row_id,
           CASE WHEN c_custkey % 3 = 0 THEN ' N/a' || chr(9) WHEN c_custkey % 5 = 0 THEN '  '
                WHEN c_custkey % 7 <> 0 THEN c_name END AS name,
           CASE WHEN c_custkey % 2 = 0 THEN 'null' WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS segment,
           c_acctbal AS balance
    FROM customer"""


def sql_filled(column: str) -> str:
    return f"coalesce(lower(trim({column}, {WS})) NOT IN ('', 'null', 'na', 'n/a'), false)"


def sql_json(column: str) -> str:
    """A string as JSON text."""
    return f"CAST(to_json({column}) AS VARCHAR)"
