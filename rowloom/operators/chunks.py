"""Splitting documents into chunks.

A document is one row, so splitting, filtering and removing repeats all happen inside the
row: no shuffle, and the position of a chunk is its place in the row's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named
from rowloom.functions.text import strip, whitespace_class
from rowloom.plans.scale import ordered_concat

# Chunks of this many characters or fewer are dropped; how texts are split.
MIN_LENGTH = 10
SENTENCE_END = "[.!?]+"
BLOCK_END = "\n\n"
PARAGRAPH_END = "\n" + whitespace_class() + "*\n"


def sentence_chunks(text: Column) -> Column:
    return _long_enough(F.split(text, SENTENCE_END, -1))


def line_chunks(text: Column) -> Column:
    return _long_enough(F.split(text, "\n", -1))


def paragraph_chunks(text: Column) -> Column:
    """Sentences that do not cross a blank line."""
    # A paragraph end always ends a sentence too, so one array of pieces is enough.
    return F.flatten(F.transform(F.split(text, PARAGRAPH_END, -1), sentence_chunks))


def block_chunks(text: Column) -> Column:
    """Blocks between blank lines, of any length, repeats kept."""
    return F.filter(F.transform(F.split(text, BLOCK_END, -1), strip), lambda c: c != "")


def _long_enough(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda c: F.length(c) > MIN_LENGTH)


_KINDS = {"sentence": sentence_chunks, "line": line_chunks, "paragraph": paragraph_chunks}


def chunk_array(text: Column, kind: str = "sentence") -> Column:
    """Chunks of a text in order, each once. ``block`` keeps repeats; unknown kinds mean paragraph."""
    if kind == "block":
        return block_chunks(text)
    return F.array_distinct(_KINDS.get(kind, paragraph_chunks)(text))


def chunk_documents(docs: DataFrame, kind: str = "sentence", text: str = "text", distinct: bool = True) -> DataFrame:
    """One row per chunk: the other columns of ``docs``, ``chunk_ord`` from 0, and ``chunk``."""
    if distinct:
        array = chunk_array(F.col(text), kind)
    else:
        array = block_chunks(F.col(text)) if kind == "block" else _KINDS.get(kind, paragraph_chunks)(F.col(text))
    others = all_named(c for c in docs.columns if c != text)
    return docs.select(*others, F.posexplode(array).alias("chunk_ord", "chunk"))


def distinct_chunks(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks in long form, each text once per document, at its first position.

    The aggregate is combined before the shuffle, so copies of one text cost one row per task.
    """
    return chunks.groupBy(doc, "chunk").agg(F.min("chunk_ord").alias("chunk_ord"))


def raw_context(docs: DataFrame, kind: str = "sentence", text: str = "text") -> DataFrame:
    """All chunks of a document as one text (``context``), joined by blank lines, row by row."""
    others = all_named(c for c in docs.columns if c != text)
    return docs.select(*others, F.array_join(chunk_array(F.col(text), kind), "\n\n").alias("context"))


def concat_chunks(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The same from chunk rows, for chunks that come from a store: ``(doc, context)``."""
    joined = ordered_concat(chunks, [doc], "chunk_ord", F.col("chunk"), "\n\n")
    return joined.withColumnRenamed("folded", "context")
