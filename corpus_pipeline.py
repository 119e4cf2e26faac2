"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Defined results, for every stage: a null text is an empty one, and stays null where the row stays. Rows without an id, and rows that
repeat one, are documents like others, told apart by their texts; of rows that repeat id and text one stays at least. Ties are
settled by the smaller id. An empty table gives an empty table with the same columns. Columns beside ``doc_id``, ``text``, ``lang``,
``source`` and ``n_chars`` are passed on whatever they are called; the last stage returns places of pieces and drops them.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.names import all_named
from rowloom.llm import jaccard_join, packing, quality_model, substring_dedup
from rowloom.llm.common import table, words_of
from rowloom.llm.queries import mixed_documents, tokenizer_path
from rowloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A document stays when its probability of good quality reaches this.
QUALITY = 0.3
#: Near copies share so many of a hundred shingles of so many words.
NEAR, SHINGLE = 80, 5
#: The mixture has as many tokens as there are.
MIXTURE = 1.0


def _whole(docs: DataFrame) -> Column:
    """All columns of a row as one, which no column made on the way can clash with."""
    return F.struct(*all_named(docs.columns)).alias("doc")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs.select(_whole(docs), "text"), model)
    return scored.where(F.col("_score") >= QUALITY).select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the smallest id, one without an id only if none has any.

    Rows are told apart by a key of their own, so rows without an id or with a repeated one are documents like others.
    Rows that repeat an id with the same text are one document.
    """
    rows = written(docs.select(_whole(docs), F.monotonically_increasing_id().alias("row")), "near-rows")
    texts = rows.select("row", "doc.text")
    groups = jaccard_join.ngram_join(texts, num=NEAR, den=100, width=SHINGLE, key="row")
    # Texts without words are in no group; of those with an id one stays for each id and text.
    doc_id = F.col("doc.doc_id")
    placed = rows.select("row", doc_id.alias("doc_id"), F.xxhash64("doc.text").alias("t")).join(groups, "row")
    bare = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    first = placed.groupBy(
        F.when(~bare, F.col("component_id")), F.when(bare, F.col("doc_id")), F.when(bare, F.col("t"))
    ).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents stay in one; documents that are nothing else go."""
    out = substring_dedup.remove_repeats(docs)
    left = (F.size("_removed") == 0) | (F.size(words_of(F.col("text"))) > 0)
    count = F.when(F.size("_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", count.cast("long")).select(*all_named(docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domains, languages and sources; some come in two epochs."""
    return mixed_documents(docs.select(_whole(docs), "doc_id", "text", "lang", "source"), MIXTURE).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", passages),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Tokens, hashes and a trained model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
