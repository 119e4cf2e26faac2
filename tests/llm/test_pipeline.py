"""Each stage of the pipeline on its own input, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from rowloom.llm.common import table
from rowloom.session import written
from tests.conftest import SF_DIR


def one_of_each_group(texts):
    """By brute force: the smallest ids of documents linked by four fifths of their shingles of five words."""
    sets, holders = {}, {}
    for i, text in texts.items():
        found = text.translate(LOWER).split()
        sets[i] = {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))}
        for gram in sets[i]:
            holders.setdefault(gram, []).append(i)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        for other in {o for gram in sets[i] for o in holders[gram] if o < i}:
            if 5 * len(sets[i] & sets[other]) >= 4 * len(sets[i] | sets[other]):
                low, high = sorted((top(i), top(other)))
                root[high] = low
    return sorted({top(i) for i in texts})


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF_DIR), f"test-{name}")
        seen.append((name, docs, out))
        assert out.count() > 0
        docs = out
    columns = table(spark, SF_DIR, "documents").columns
    assert all(out.columns == columns for _, _, out in seen[:-1])
    (_, before, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, placed) = seen
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF_DIR, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    known = [i for r in before.collect() if (i := r["doc_id"]) in labels]
    assert sum((i in kept) == bool(labels[i]) for i in known) >= 0.9 * len(known)
    assert sorted(r["doc_id"] for r in single.collect()) == one_of_each_group({r["doc_id"]: r["text"] for r in good.collect()})
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    first = {}
    for r in sorted(clean.collect(), key=lambda r: r["doc_id"]):
        assert r["n_chars"] == len(r["text"]) and len(r["text"]) <= len(texts[r["doc_id"]])
        found = r["text"].split()
        for i in range(len(found) - 49):
            assert first.setdefault(tuple(found[i : i + 50]), r["doc_id"]) == r["doc_id"]
    assert {r["doc_id"] for r in placed.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert placed.where("piece = 0").count() == mixed.count()


def test_near_copies_without_ids(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(100)) for name in "abcd"}
    near = {name: text.replace(f"{name}50", "changed") for name, text in texts.items()}
    rows = [
        (None, texts["a"]), (None, near["a"]), (None, texts["b"]), (3, near["b"]), (7, texts["b"]),
        (5, texts["c"]), (5, texts["d"]), (4, near["d"]), (5, texts["c"]), (6, ""), (6, ""), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()), key=repr)
    assert [r for r in kept if r[0] is not None] == sorted([(3, near["b"]), (5, texts["c"]), (4, near["d"]), (6, "")], key=repr)
    assert len(kept) == 7 and {(None, ""), (None, None)} < set(kept)
    assert len({texts["a"], near["a"]} & {text for _, text in kept}) == 1


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    own = "_row long, _score double, _t long, _cuts int, doc string, row int, _epoch int, _tokens int, _level0 int, d int, t int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {own}"
    texts = [" ".join(f"k{i}x{w}" for w in range(120)) for i in range(3)]
    rows = [(i, texts[i % 3] if i < 5 else None, "en", None, 7, 1, 2.0, 3, 4, "five", 6, 7, 8, 9, 10, 11) for i in range(6)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF_DIR).count() == 0
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == rows[0][5:] for r in out.collect()), name
    assert corpus_pipeline.packed(spark, none, SF_DIR).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()} == {0, 1, 2, 5}
