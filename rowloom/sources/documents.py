"""Text documents from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.text import strip

# The extensions that are read as text.
TEXT_EXTENSIONS = ("txt", "md")


def load_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, doc_name, content_hash, size, text)`` for every file under ``paths``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return documents(files.select("path", "content"))


def documents(files: DataFrame) -> DataFrame:
    """The same for rows ``(path, content)``. Unsupported extensions keep their row, with null text."""
    return files.select(
        "path",
        doc_name(F.col("path")).alias("doc_name"),
        content_hash(F.col("content")).alias("content_hash"),
        F.octet_length("content").cast("long").alias("size"),
        document_text(F.col("path"), F.col("content")).alias("text"),
    )


def document_text(path: Column, content: Column) -> Column:
    """UTF-8 text, or ISO-8859-1 where the bytes are not UTF-8; stripped."""
    raw = content.cast("string")
    # Text mode in Python also turns every line end into \n.
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(extension.isin(*TEXT_EXTENSIONS), strip(lines))


def doc_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content, 256)
