from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators.embed import (
    cache_embeddings, cache_info, commits, compact, embed_documents, embed_missing, encode_column, get_cached, has_cached,
    hashing_encoder, missing, read_meta, vacuum,
)
from rowloom.sources.documents import documents
from tests.conftest import plan_of

FILES = [
    ("d/a.txt", b"the first sentence here. the second sentence here."),
    ("d/b.txt", b"another document altogether."),
    ("e/copy.md", b"the first sentence here. the second sentence here."),
    ("e/tiny.txt", b"short."),
    ("e/other.bin", b"the first sentence of a binary."),
]


@pytest.fixture
def docs(spark):
    rows = [(p, bytearray(c)) for p, c in FILES]
    return documents(spark.createDataFrame(rows, "path string, content binary"))


def counting_encoder(log):
    """Writes a line per encoded text."""

    def load():
        encode = hashing_encoder(8)()

        def run(texts):
            with open(log, "a") as out:
                out.writelines(f"{len(texts)}\t{t}\n" for t in texts)
            return encode(texts)

        return run

    return load


def test_encoder_matches_its_rule():
    import hashlib

    vector = hashing_encoder(16)()(["Été été, x_1!", ""])
    want = np.zeros(16)
    for word in ("été", "été", "x", "1"):
        want[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 16] += 1
    assert vector[0].tolist() == want.tolist() and not vector[1].any()


def test_batches_stay_small(spark, tmp_path):
    log = tmp_path / "log"
    df = spark.range(70, numPartitions=1).select("id", F.concat(F.lit("text "), "id").alias("chunk"))
    out = encode_column(df, counting_encoder(log)).collect()
    assert len(out) == 70 and all(len(r["embedding"]) == 8 for r in out)
    assert max(int(line.split("\t")[0]) for line in log.read_text().splitlines()) <= 32


def test_nothing_to_embed(docs):
    assert embed_documents(docs.where("path like '%tiny%' or path like '%bin'"), hashing_encoder(8)).count() == 0


def test_store_life(spark, docs, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "log"
    encoder = counting_encoder(log)
    assert not any(r["cached"] for r in has_cached(docs, store).collect())
    assert cache_info(spark, store).first().asDict() == {
        "num_cached_documents": 0, "total_size_bytes": 0, "total_size_mb": 0.0,
    }

    embed_missing(docs.where("doc_name = 'b.txt'"), store, encoder, "m")
    embed_missing(docs, store, encoder, "m")
    texts = [line.split("\t")[1] for line in log.read_text().splitlines()]
    assert sorted(texts) == ["another document altogether", "the first sentence here", "the second sentence here"]
    embed_missing(docs, store, encoder, "m")
    assert len(log.read_text().splitlines()) == 3

    cached = {r["doc_name"]: r["cached"] for r in has_cached(docs, store).collect()}
    assert cached == {"a.txt": True, "b.txt": True, "copy.md": True, "tiny.txt": False, "other.bin": False}
    rows = get_cached(docs.select("path", "content_hash"), store).collect()
    by_path = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["chunk_ord"])):
        by_path.setdefault(r["path"], []).append(r["chunk"])
    both = ["the first sentence here", "the second sentence here"]
    assert by_path == {"d/a.txt": both, "e/copy.md": both, "d/b.txt": ["another document altogether"]}
    meta = {r["file_name"]: r for r in read_meta(spark, store).collect()}
    assert set(meta) == {"a.txt", "b.txt"} and meta["a.txt"]["num_chunks"] == 2 and meta["a.txt"]["dimension"] == 8
    assert cache_info(spark, store).first()["num_cached_documents"] == 2

    embed_missing(docs, store, encoder, "m2", force=True)
    assert len(log.read_text().splitlines()) == 6
    assert {r["model_name"] for r in read_meta(spark, store).collect()} == {"m2"}
    assert get_cached(docs.select("path", "content_hash"), store).count() == 5


def test_a_broken_entry_is_a_miss(spark, docs, tmp_path):
    store = str(tmp_path / "store")
    first = docs.where("doc_name = 'a.txt'")
    chunks = embed_documents(first.select("path", "content_hash", "text"), hashing_encoder(8))
    write = cache_embeddings(chunks, store)
    meta = spark.read.parquet(f"{store}/meta").withColumn("num_chunks", F.lit(3)).withColumn("write_id", F.lit("x" + write))
    meta.withColumn("cached_at", F.current_timestamp()).write.mode("append").parquet(f"{store}/meta")
    assert not has_cached(first, store).first()["cached"]
    assert has_cached(first, store, verify=False).first()["cached"]
    assert get_cached(first.select("path", "content_hash"), store).count() == 0
    embed_missing(first, store, hashing_encoder(8))
    assert has_cached(first, store).first()["cached"]
    # Chunks of a write without metadata (a run that broke off) are not read.
    chunks.select("path", "content_hash", "chunk_ord", "chunk", "embedding").write.parquet(f"{store}/chunks/write_id=lost")
    assert get_cached(first.select("path", "content_hash"), store).count() == 2


def test_documents_without_chunks_are_cut_once(docs, tmp_path):
    store = str(tmp_path / "store")
    assert missing(docs, store).count() == 4
    embed_missing(docs, store, hashing_encoder(8))
    assert missing(docs, store).count() == 0 and missing(docs, store, force=True).count() == 4
    assert {r["doc_name"] for r in has_cached(docs, store).where("cached").collect()} == {"a.txt", "b.txt", "copy.md"}


def test_compaction_and_vacuum(spark, docs, tmp_path):
    store = str(tmp_path / "store")
    first = embed_missing(docs.where("doc_name = 'b.txt'"), store, hashing_encoder(8), "m")
    second = embed_missing(docs, store, hashing_encoder(8), "m")
    before = sorted(map(tuple, get_cached(docs.select("path", "content_hash"), store).collect()))
    # A write that broke off behind its chunks.
    broken = spark.read.parquet(f"{store}/parts").where(F.col("write_id") == second).drop("digit")
    for digit in {r[0] for r in spark.read.parquet(f"{store}/parts").select("digit").distinct().collect()}:
        broken.drop("write_id").write.parquet(f"{store}/parts/digit={digit}/write_id=broken")
    assert sorted(map(tuple, get_cached(docs.select("path", "content_hash"), store).collect())) == before
    third = compact(store, spark)
    assert [(r["number"], r["write_id"], r["documents"], r["chunks"]) for r in commits(spark, store).orderBy("number").collect()] == [
        (0, first, 1, 1), (1, second, 1, 2), (2, third, 2, 3),
    ]
    assert set(vacuum(store, spark)) == {first, second, "broken"} and vacuum(store, spark) == []
    assert sorted(map(tuple, get_cached(docs.select("path", "content_hash"), store).collect())) == before
    assert {r["write_id"] for r in read_meta(spark, store).collect()} == {third}
    assert {r["write_id"] for r in spark.read.parquet(f"{store}/parts").select("write_id").distinct().collect()} == {third}


def test_a_reader_opens_the_folders_it_needs(docs, tmp_path):
    store = str(tmp_path / "store")
    first = embed_missing(docs.where("doc_name = 'b.txt'"), store, hashing_encoder(8))
    embed_missing(docs, store, hashing_encoder(8))
    one = docs.where("doc_name = 'b.txt'").select("path", "content_hash")
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = plan_of(get_cached(one, store))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [line[line.index("PartitionFilters") : line.index("PushedFilters")] for line in plan.splitlines() if "PartitionFilters" in line]
    digit = one.first()["content_hash"][0]
    assert any(f"= {digit})" in found and first in found for found in filters), filters
    assert get_cached(one, store).count() == 1


def test_counting_cached_chunks_reads_no_vectors(spark, docs, tmp_path):
    """Pieces of hot keys are chosen by the place of a chunk, so columns that nobody asks for are not read."""
    store = str(tmp_path / "store")
    embed_missing(docs, store, hashing_encoder(8))
    counted = get_cached(docs.select("content_hash"), store).groupBy("content_hash").count()
    assert "embedding" not in counted._jdf.queryExecution().executedPlan().toString() and counted.count() == 2


def test_compaction_leaves_out_replaced_entries(spark, docs, tmp_path):
    """Contents that a newer write holds move once; those of older writes that still count move too."""
    store = str(tmp_path / "store")
    embed_missing(docs, store, hashing_encoder(8))
    embed_missing(docs.where("path = 'd/b.txt'"), store, hashing_encoder(8), force=True)
    before = get_cached(docs.select("path", "content_hash"), store).select("path", "chunk_ord", "chunk").collect()
    write = compact(store, spark)
    moved = spark.read.parquet(f"{store}/parts").where(F.col("write_id") == write)
    assert moved.count() == moved.select("content_hash", "chunk_ord").distinct().count() == 3
    assert sorted(get_cached(docs.select("path", "content_hash"), store).select("path", "chunk_ord", "chunk").collect()) == sorted(before)
