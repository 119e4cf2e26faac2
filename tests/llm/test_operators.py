"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, copies and extra columns."""

from __future__ import annotations

import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import session
from rowloom.llm import (
    html_text, jaccard_join, mixing, packing, quality_model, quality_rules, substring_dedup, token_rollup, vector_search, warc,
)
from rowloom.llm.common import table
from rowloom.llm.components import components
from rowloom.llm.queries import QUERIES, SQL, tokenizer_path
from rowloom.llm.tokens import Encoder
from rowloom.session import written
from tests.compare import compare
from tests.conftest import SF_DIR

pick = random.Random(3)
WORDS = [f"w{i}" for i in range(3000)]


def words(n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


BASE = words(300)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "\t", 5).upper()), (4, BASE + " one more"), (5, None), (6, ""), (7, " \n "),
    (8, "two words"), (9, "Two WORDS"), (10, words(80) + "\n" + words(60)), (10, "the same id again"), (None, words(70)),
    (11, " ".join([words(12)] * 20)), (12, words(4000)), (13, "ß é   x" * 30), (14, BASE[: len(BASE) // 2]),
]
SCHEMA = "doc_id long, text string, length int, piece string, `a.b` int, sequence_id int, _epoch int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_packing(docs, empty):
    path = tokenizer_path()
    encoder = Encoder(path)
    found = packing.pack_documents(docs, path, capacity=256).toPandas()
    plain = encoder.tokenizer
    want = sorted(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert found["length"].sum() == sum(want) and found["length"].between(1, 256).all()
    for _, own in found[found["doc_id"] == 12].sort_values("piece").groupby("doc_id"):
        ids = np.array(plain.encode(dict(ROWS)[12], add_special_tokens=False).ids + [2], dtype="<u4")
        assert (own["length"].iloc[1:] == 256).all() and list(own["piece"]) == list(range(len(own)))
        for start, n, crc in zip(own["start"], own["length"], own["ids_crc32"]):
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    for _, one in found.sort_values("offset").groupby("sequence_id"):
        assert list(one["offset"]) == [0, *one["length"].cumsum().iloc[:-1]] and one["length"].sum() <= 256
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "ones", "halves"])
def test_packing_is_close_to_sequential_best_fit(spark, kind):
    draw = {"mixed": lambda: pick.randint(1, 64), "ones": lambda: 1, "halves": lambda: pick.choice([32, 33, 64])}[kind]
    lengths = [draw() for _ in range(600)]
    out = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), 64)
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = sorted(i for i in range(len(gaps)) if gaps[i] >= n)
        best = min(fits, key=lambda i: gaps[i], default=None)
        if best is None:
            gaps.append(64 - n)
        else:
            gaps[best] -= n
    used = out.select("sequence_id").distinct().count()
    assert out.count() == 600 and used <= 1.03 * len(gaps) + 1
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0


@pytest.mark.parametrize("rows", [40, 150])
@pytest.mark.parametrize("kind", ["mixed", "small", "one"])
def test_packing_over_many_ranges(spark, monkeypatch, rows, kind):
    """Ranges of few rows: pieces find gaps of other ranges, and little more room is used than by one range."""
    monkeypatch.setattr(packing, "SORT_ROWS", rows)
    draw = {"mixed": lambda: pick.randint(1, 64), "small": lambda: pick.randint(1, 9), "one": lambda: 23}[kind]
    lengths = [draw() for _ in range(700)]
    out = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), 64)
    placed = out.toPandas()
    assert sorted(placed["length"]) == sorted(lengths)
    for _, one in placed.sort_values("offset").groupby("sequence_id"):
        assert list(one["offset"]) == [0, *one["length"].cumsum().iloc[:-1]] and one["length"].sum() <= 64
    best = -(-len(lengths) // 2) if kind == "one" else -(-sum(lengths) // 64)
    assert placed["sequence_id"].nunique() <= 1.06 * best + 700 / rows + 1


def test_sweep_takes_the_smallest_gap_that_holds():
    def ids(**by_size):
        return {int(s[1:]): np.array(v) for s, v in by_size.items()}

    wanted, free = ids(s8=[1], s7=[2], s6=[3, 4], s11=[5]), ids(s10=[100, 101], s7=[102])
    placed, left, rest = packing.sweep(wanted, free, 20, False)
    assert [(p.tolist(), s.tolist()) for p, s in placed] == [([1], [100]), ([2], [102]), ([3], [101])]
    assert {k: v.tolist() for k, v in left.items()} == {11: [5], 6: [4]}
    assert {k: v.tolist() for k, v in rest.items()} == {2: [100], 4: [101]}
    placed, left, rest = packing.sweep(wanted, {}, 20, True)
    # 11 and 8 fill up to 19, 7 and 6 and 6 a second sequence.
    assert not left and sorted((p, s) for ps, ss in placed for p, s in zip(ps.tolist(), ss.tolist())) == [(1, 5), (2, 2), (3, 2), (4, 2), (5, 5)]


def test_ranges_take_slots_from_the_top_of_the_stack():
    assert packing.depths_of({0: (3, 2), 1: (1, 4), 2: (7, 0), 3: (1, 1)}) == ({0: 0, 1: 2, 2: 5, 3: 0}, 6)


def test_tokens_equal_the_tokenizer():
    encoder = Encoder(tokenizer_path())
    for text in ["a\t\n b", "  x  y \n\n z ", "a<|endoftext|>\n b", " \x1f a", "don't I'll 12,5 é ß", "x" * 9000, ""]:
        assert encoder.ids(text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def sets_of(rows):
    out = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(found[i : i + 3]) for i in range(len(found) - 2)}
        out.append(grams or ({tuple(found)} if found else set()))
    return out


def joined_by_force(rows):
    sets, root = sets_of(rows), list(range(len(rows)))
    n_links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 90 * len(sets[a] | sets[b]):
                n_links[a] += 1
                n_links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    ids = [min((rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None), default=None) for r in root]
    return sorted(zip([i for i, _ in rows], map(len, sets), ids, n_links), key=repr)


def near_family(n):
    base = [pick.choice(WORDS) for _ in range(200)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(pick.choice([0, 1, 2, 3, 4, 6])):
            own[pick.randrange(200)] = pick.choice(WORDS)
        out.append((100 + i, " ".join(own)))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 2000])
def test_jaccard_join(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", limit)
    rows = ROWS + near_family(60) + [(200 + i, words(pick.choice([9, 10, 11, 12]))) for i in range(10)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string"))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.ngram_join(df).collect()]
    assert sorted(got, key=repr) == joined_by_force(rows)
    assert jaccard_join.ngram_join(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}


@pytest.mark.parametrize("within", [True, False])
def test_components_take_few_plans(spark, monkeypatch, within):
    module, steps = sys.modules[components.__module__], []
    if not within:
        monkeypatch.setattr(module, "_within", lambda pairs: pairs)
    monkeypatch.setattr(module, "written", lambda df, name: steps.append(name) or session.written(df, name))
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 250), (250, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(40)} | {200: 200, 250: 200, 300: 200}
    # A task that holds all edges settles them; otherwise steps go on until they are.
    assert steps == ["edges"] if within else set(steps[1:]) == {"stars"}
    parts = [module.put_together(*np.array(edges[a : a + 9]).T) for a in range(0, len(edges), 9)]
    u, v = module.put_together(*map(np.concatenate, zip(*parts)))
    assert dict(zip(v.tolist(), u.tolist())) == {node: root for node, root in got.items() if node != root}
    texts = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert sorted(map(tuple, components(texts).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_tasks_of_groups_take_one_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 1000)
    at = jaccard_join.Threshold(80, 100)
    sizes = {1: [10, 20], 2: [300] * 9 + [100] * 12 + [110, 80, 5], 3: [2000]}
    rows = [(root, 1000 * root + i, n) for root, some in sizes.items() for i, n in enumerate(some)]
    found = jaccard_join.block_tasks(spark.createDataFrame(rows, "root long, node long, n long"), at)
    assert len(re.findall(r"Join ", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    tasks = {r["node"]: {t["task"]: t["side"] for t in r["tasks"]} for r in found.collect()}
    assert tasks[1000] == tasks[1001] == {"1": -1} and len(tasks) == len(rows)
    for _, a, n in rows:
        for _, b, m in rows:
            if a < b and a // 1000 == b // 1000:
                met = [k for k in tasks[a].keys() & tasks[b].keys() if tasks[a][k] != tasks[b][k] or tasks[a][k] < 0]
                near = sum(sizes[a // 1000]) <= 1000 or abs(at.stretch(n) - at.stretch(m)) <= 1
                assert len(met) == near, (a, b, met)


def test_discarded_tables_hold_nothing(spark):
    kept = session.written(spark.range(5).selectExpr("id AS a", "array(id) AS b"), "test-discard")
    assert kept.count() == 5
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("test-discard", "")
    session.discard(kept)
    ids = jobs.getJobIdsForGroup("test-discard")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(jobs.getStageInfo(i).numTasks for job in ids for i in jobs.getJobInfo(job).stageIds) <= 1
    assert spark.read.schema(kept.schema).parquet(kept.inputFiles()[0].rpartition("/")[0]).count() == 0


def test_substring_dedup(spark, empty):
    passage, near = words(55), words(70)
    changed = near.split()
    changed[33] = "changed"
    rows = [
        (1, words(40) + " " + passage + " " + words(30)), (2, "start here " + passage + " end there\nlast line"),
        (3, words(200)), (4, near + "\nx"), (5, "own words\n" + " ".join(changed)), (6, None), (7, ""), (8, "short copy"),
        (9, "short copy"), (10, words(90)), (11, "  odd   space\n\n" + words(90) + " \n"), (12, (words(60) + "\n") * 1),
        (None, passage), (13, " ".join([words(10)] * 30)),
    ]
    rows.append((14, dict(rows)[10]))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, first int")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert len(got) == len(rows) and got[1]["first"] == 5
    assert got[2]["text"] == "start here end there\nlast line" and list(got[2]["_kept_in"]) == [1]
    assert got[5]["text"] == "own words" and list(got[5]["_kept_in"]) == [4]
    assert got[14]["text"] == "" and got[None]["text"] == ""
    for i in (1, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13):
        assert got[i]["text"] == dict(rows)[i] and not got[i]["_removed"], i
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("limit", [2_000_000, 4_000])
def test_near_paragraphs_of_a_large_group(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", limit)
    rng = random.Random(17)
    texts = []
    for family, (n, places) in enumerate([(300, (33, 66)), (10, (33, 66)), (100, (20, 40, 60, 80))]):
        base = [f"f{family}w{i}" for i in range(100)]
        if family < 2:  # windows of unlike copies would cover all of the base
            texts.append(" ".join(base))
        for copy in range(n):
            edited = list(base)
            for place in places:
                edited[place + rng.randint(-8, 8)] = f"e{family}x{copy}x{place}"
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    for a, one in enumerate(sets):
        for b in range(a):
            if least[a] != least[b] and 5 * len(one & sets[b]) >= 4 * len(one | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    gone = {i for i, r in got.items() if not r["text"]}
    wanted = {i for i, first in enumerate(least) if first < i}
    assert len(wanted) >= 310
    assert gone <= wanted and len(gone) >= 0.99 * len(wanted)
    assert all(least[i] in got[i]["_kept_in"] for i in gone)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_every_passage_of_the_least_length_is_found(spark, monkeypatch, broadcast):
    """Passages of 50 to 60 words at any place of longer lines: all of their later copies go, and nothing else does."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_VALUES", broadcast)
    rng = random.Random(23)
    draw = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passages = [draw(rng.randint(50, 60)) for _ in range(40)]
    shown = [(i, p) for i in range(40) for p in (i, i)]
    rng.shuffle(shown)
    rows, first = [], {}
    for doc, (i, _) in enumerate(shown):
        before, behind = draw(rng.randint(60, 120)), draw(rng.randint(60, 120))
        again = first.setdefault(i, doc) != doc
        rows.append((doc, " ".join(before + passages[i] + behind), " ".join(before + behind) if again else None, first[i]))
    own = "_d int, _t int, _cuts int, _keepers int, _first int, _done int, row int, d int, t int, cuts int, first int, `a.b` int"
    df = spark.createDataFrame([(d, t, *range(12)) for d, t, _, _ in rows], f"doc_id long, text string, {own}")
    out = substring_dedup.remove_repeats(df)
    assert out.columns == [*df.columns, "_removed", "_kept_in"]
    got = {r["doc_id"]: r for r in out.collect()}
    for doc, text, left, keeper in rows:
        assert tuple(got[doc])[2:14] == tuple(range(12))
        assert got[doc]["text"] == (left or text), doc
        assert list(got[doc]["_kept_in"]) == ([keeper] if left else [])


def test_kept_windows_cover_every_choice():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 2**63, 900).astype(np.uint64)
    begins = np.array([0, 40, 300, 349, 500])
    places, names = substring_dedup.starts(words, begins, 50)
    ends = [40, 300, 349, 500, 900]
    hashes = substring_dedup.doubled(words, substring_dedup.WINDOW)
    assert (names == hashes[places]).all()
    want = set()
    for a, b in zip(begins, ends):
        for at in range(a, b - 50 + 1):
            want.add(at + int(np.argmin(hashes[at : at + 35])))
    assert set(places.tolist()) == want


@pytest.mark.parametrize("period", [1, 3, 16, 17, 40, 90])
def test_windows_that_a_text_repeats_are_few_rows(spark, monkeypatch, period):
    """Every text holds the same 400 words of a short period: rows follow the texts, not the places of its windows in each."""
    rng = random.Random(period)
    draw = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    passage = (draw(period) * 400)[:400]
    rows = [(d, draw(60), draw(60)) for d in range(12)]
    seen, repeated, held = {}, substring_dedup._repeated_windows, substring_dedup._held_windows

    def counted(found):
        around = repeated(found)
        seen["kept"] = around.count()
        return around

    def counted_held(looked):
        inside, keepers = held(looked)
        seen["held"] = inside.count()
        return inside, keepers

    monkeypatch.setattr(substring_dedup, "_repeated_windows", counted)
    monkeypatch.setattr(substring_dedup, "_held_windows", counted_held)
    df = spark.createDataFrame([(d, " ".join(a + passage + b)) for d, a, b in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert got[0]["text"] == " ".join(rows[0][1] + passage + rows[0][2])
    for d, a, b in rows[1:]:
        assert got[d]["text"] == " ".join(a + b) and [tuple(r) for r in got[d]["_removed"]] == [(60, 400)]
    # A text of 400 words without a period has some 23 kept windows.
    assert seen["kept"] <= 30 * len(rows)
    if period <= substring_dedup.WINDOW:
        assert seen["kept"] <= 3 * len(rows) and seen["held"] == period * (len(rows) - 1)


@pytest.mark.parametrize("gap", [1, 16, 69])
def test_equal_names_within_a_gap_are_put_together(gap):
    rng = np.random.default_rng(gap)
    places = np.sort(rng.choice(2000, 600, replace=False))
    names, owner = rng.integers(0, 9, 600).astype(np.uint64), np.searchsorted([300, 301, 900], places, side="right")
    want = []
    for i in range(600):
        before = [x for x in want if names[x[1]] == names[i] and owner[x[1]] == owner[i] and places[i] - places[x[1]] <= gap]
        if before:
            before[0][1] = i
        else:
            want.append([i, i])
    first, last = substring_dedup.together(places, names, owner, gap)
    assert [list(pair) for pair in zip(first, last)] == want
    assert [len(x) for x in substring_dedup.together(places[:0], names[:0], owner[:0], gap)] == [0, 0]


def test_banding_reaches_its_recall():
    bands, rows = substring_dedup.tune(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99


def test_budgets():
    held = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    # x cannot take its half: its sibling gets the rest; only then the other branch.
    assert mixing.budgets(held, {}, 100, epochs=1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert mixing.budgets(held, {}, 400, epochs=1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 290}
    assert sum(mixing.budgets(held, {("a",): 3.0}, 10**6, epochs=2).values()) == 2220
    assert mixing.budgets({}, {}, 5) == {} and mixing.share(7, [(1, 10), (1, 10), (0, 10)]) == [4, 3, 0]


def test_mixing(spark, docs, empty):
    df = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("s")))
    held = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(mixing.word_tokens(F.col("text"))).alias("n")).collect()}
    out = mixing.mix(df.drop("_epoch"), [F.col("source")], {("s",): 1.0, ("",): 1.0}, 1000, epochs=2).select("*", mixing.word_tokens(F.col("text")).alias("n")).collect()
    for source, whole in held.items():
        mine = [r["n"] for r in out if r["source"] == source]
        budget = mixing.budgets({("s",): held["s"], ("",): held[None]}, {}, 1000)[(source or "",)]
        assert budget <= sum(mine) < budget + max(mine)
    assert mixing.mix(empty.drop("_epoch"), [F.lit("a")], {}, 0.5).count() == 0


def test_quality_rules(docs, empty):
    for r in quality_rules.ledger(docs).collect():
        texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in ROWS if i == r["doc_id"]]
        found = next(f for f in texts if len(f) == r["n_words"])
        grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 500 else None
        assert r["n_words"] == len(found) and r["word_chars"] == sum(map(len, found))
        assert covered is None or r["n_repeat_words"] == len(covered)
    entries = quality_rules.ledger(docs)
    masks = [r["failed"] for r in entries.collect()]
    for r in quality_rules.ablation(entries).collect():
        mask = quality_rules.POLICIES[r["policy"]]
        less = mask & ~quality_rules.BIT[r["rule"]]
        assert (r["kept"], r["kept_without"]) == (sum(not m & mask for m in masks), sum(not m & less for m in masks))
    assert quality_rules.ledger(empty).count() == 0


def test_quality_model(spark, empty):
    good = [(i, words(60), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "***" for w in words(60).split()), 0) for i in range(200)]
    rows = good + bad + [(5000, None, None), (None, "x y", 0), (5001, "", 1)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_model.classify(df, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [i for i, _, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i in held) and not out[1]["held_out"] == (zlib.crc32(b"1") % 5 != 0)
    assert np.mean([out[i]["predicted"] == (i < 1000) for i in held]) > 0.95
    nothing = quality_model.classify(df, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in nothing} == {0.5} and quality_model.classify(empty, labels).count() == 0


def test_vector_search(spark):
    random_vectors = np.random.default_rng(5).normal(size=(900, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random_vectors)]
    rows += [(900 + i, rows[20][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (None, rows[1][1]), (2060, [1.0])]
    rows += [(40, rows[40][1])]
    out = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=10).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows[:960]}
    hits = 0
    for i in (q for q in known if q % 20 == 0):
        want = sorted((-float(known[j] @ known[i]), j) for j in known if j != i)[:10]
        hits += len({j for _, j in want} & {j for j, _ in out[i]})
        assert len(out[i]) == 10 and all(abs(known[j] @ known[i] - s) < 1e-9 for j, s in out[i])
    assert set(out) == {q for q in known if q % 20 == 0} and hits >= 0.95 * 10 * len(out)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert vector_search.nearest(few).count() == 2 and vector_search.nearest(few.where("vec_id < 0")).count() == 0


def test_vector_search_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL", 200)
    monkeypatch.setattr(vector_search, "LEAF", 16)
    x = np.random.default_rng(6).normal(size=(1500, 16)) * np.random.default_rng(7).uniform(0.5, 2, size=(1500, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, k=10, every=50).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for i, found in got.items():
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(found & set(np.argsort(-scores)[:10].tolist()))
    assert len(got) == 30 and hits >= 0.9 * 300


def test_vectors_of_each_length_are_searched(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0]), (6, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_search.nearest(df, k=2, every=2).collect()))
    assert got == [(0, 1, 2, 9.0), (0, 2, 1, 4.0), (2, 1, 0, 9.0), (2, 2, 1, 9.0), (4, 1, 6, 2.0), (6, 1, 4, 2.0)]


def test_archives(spark):
    rows = [(1, "http://B.example/x", "<p>ä</p>"), (2, "http://a.example/", "<p>ä</p>"), (3, None, None), (4, "u\r\nv", ""),
            (5, "http://a.example/", "WARC/1.1\r\n\r\nnot a record"), (1, "again", "<p>ä</p>"), (None, "n", "<p>ä</p>"), (6, "z", "q" * 100_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record_type int")
    out = warc.archive_index(df).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out), key=repr)
    assert got == sorted([
        (1, 9, "response", None), (2, 9, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 24, "response", None),
        (1, 9, "response", None), (None, 9, "revisit", 1), (6, 100_000, "response", None),
    ], key=repr)
    assert [(r["urlkey"], r["timestamp"]) for r in out] == sorted((r["urlkey"], r["timestamp"]) for r in out)
    assert warc.archive_index(df.where("page_id > 100")).count() == 0


def test_loser_tree():
    for k in range(7):
        runs = [sorted(pick.randrange(50) for _ in range(pick.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda v: v)) == sorted(sum(runs, []))


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>a&amp;b &lt;i&gt; \n c</p>tail", "a&b <i> c\ntail"),
    ("<nav>menu</nav><article><h1>T</h1><p>one<br>two <b>bold</b><script>x</script></article><footer>f</footer>", "T\none\ntwo bold"),
    ("<body><div class='menu'><a>x</a></div><div><h2>T</h2><p>long enough text here</p><p>b</p></div><div id=comments><p>bla bla</p></div>",
     "T\nlong enough text here\nb"),
    ("<main><p>text</p><aside>side</aside><form>f</form><p>more</p></main><div class=\"ad\">buy</div>", "text\nmore"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "long text of the page " * 20


@pytest.mark.parametrize("html,text", [
    ("<article><p>card</p></article><div><p>{0}</p><p>{0}</p></div><article><p>card two</p></article>", "{0}\n{0}"),
    ("<div>log in here</div><article><p>{0}</p></article><div>all rights</div>", "{0}"),
    ("<div><h1>T</h1></div></div></div><div><div><div><p>{0}</p></div></div></div></div><div><div><p>end</p>", "T\n{0}\nend"),
    ("<h1>T</h1><div class=share>x</div><p>{0}</p><div class=ad>x</div><p>end</p><div class=ad>x</div><div>far</div>", "T\n{0}\nend"),
])
def test_sums_decide_on_every_page(html, text):
    assert html_text.main_text(html.format(LONG)) == text.format(LONG.strip())


@pytest.mark.parametrize("html,text", [
    ('<article><p class="notice">x<p>one<p>two</article>', "one\ntwo"),
    ('<article><ul><li class="ad">x<li>one<li>two</ul><p>three</article>', "one\ntwo\nthree"),
    ('<div><p class="notice">x</div><p>one', "one"),
    ("<article><p>one</p><aside>side</article><p>tail", "one\ntail"),
    ("<article><dl><dt class=ad>x<dd>one</dl><table><tr class=ad><td>x<tr><td class=ad>x<td>two</table></article>", "one\ntwo"),
    ("<html><head><meta charset=utf-8><title>t</title><body><p>one", "one"),
    ('<article><div class="ad">a<div>b</div>c</div><p>one <span class="ad">x<span>y</span>z</span></article>', "one"),
    ('<article><div class="ad"><p>a<p>b<ul><li>c</ul></div><p>one</article>', "one"),
])
def test_omitted_end_tags(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("mark", [
    "layout no-sidebar", "page has-banner", "with-comments", "post share-enabled", "search-results", "code-comment", "sidebar", "comments",
])
def test_marks_do_not_drop_the_article(mark):
    for tag, head in (("div", "<h1>Title</h1>"), ("section", "")):
        html = f'<body><nav>menu</nav><{tag} class="{mark}">{head}<p>{LONG}</p><p>{LONG}</p><p>end</p></{tag}><footer>x</footer></body>'
        want = "\n".join(([head[4:9]] if head else []) + [LONG.strip()] * 2 + ["end"])
        assert html_text.main_text(html) == want, (tag, mark)


def test_marks_count_beside_an_article():
    talk = "<li><article><p>" + LONG * 3 + "</p></article></li>"
    html = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class='comments'><ol class='comment-list'>{talk * 6}</ol></div>"
    assert html_text.main_text(html) == f"Title\n{LONG.strip()}\n{LONG.strip()}"


def test_menus_without_marks():
    menu = "".join(f'<div><a href="/{i}">Topic number {i}</a></div>' for i in range(9)) + "<div>Home</div><div>About us</div>"
    article = f"<div>{LONG}</div><div>A short remark.</div><div>{LONG}</div><div>{LONG}</div>"
    html = f"<body>{menu}<h1>Title</h1>{article}<div>Contact</div><div>All rights reserved. 2024</div>{menu}</body>"
    assert html_text.main_text(html) == "\n".join(["Title", LONG.strip(), "A short remark.", LONG.strip(), LONG.strip()])
    assert html_text.main_text(f'<p title="a > b">{LONG}</p>') == LONG.strip()


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>", "<p>", "<b>", "</div>", "<!-", "<div class=ad>", '<a x=">" ', "&lt;", "<script>", "<li><p>x", "<"])
def test_hostile_pages_take_one_pass(piece):
    import time

    start = time.process_time()
    html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 6


def test_pages_against_their_articles(spark):
    """Precision and recall of words over all pages; the truth is what stands in the article by another parser's account."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.words += data.split()

    pages = table(spark, SF_DIR, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    kept = right = wanted = 0
    for row in QUERIES["op4_html_extraction"](spark, SF_DIR).collect():
        parser = Article()
        parser.feed(html[row["page_id"]])
        assert row["n_chars"] == len(row["text"])
        got = row["text"].split()
        same = sum(a == b for a, b in zip(got, parser.words))
        kept, right, wanted = kept + len(got), right + same, wanted + len(parser.words)
    assert right >= 0.99 * kept and right >= 0.99 * wanted


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>ä b</p>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=repr) == [(1, "u", "ä b", 3), (None, None, "", 0)]


@pytest.mark.parametrize("most", [30_000, 12])
def test_five_words_with_shared_passages(spark, monkeypatch, most):
    """Many texts that share a passage and are not alike, beside families that are: the links of brute force, and small groups."""
    monkeypatch.setattr(jaccard_join, "LIST_SETS", most)
    rng = random.Random(41)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"u{i}x{w}" for w in range(60)] for i in range(60)]
    for family in range(6):
        base = [f"f{family}x{w}" for w in range(150)] + passage
        for copy in range(14):
            own = list(base)
            for _ in range(copy % 5):
                own[rng.randrange(150)] = f"e{family}x{copy}x{rng.random()}"
            texts.append(own)
    rng.shuffle(texts)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in texts]
    n_links = [sum(5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.ngram_join(df, 80, 100, 5).collect()}
    assert [got[i] for i in range(len(texts))] == n_links and max(n_links) >= 5


def test_sketches_keep_linked_sets():
    at = jaccard_join.Threshold(4, 5)
    rng = np.random.default_rng(8)
    agreeing = []
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        one, other = (np.unique(np.append(shared, rng.integers(0, 1 << 63, 100).astype(np.uint64))) for _ in range(2))
        a, b = (np.frombuffer(jaccard_join.sketch(v), np.uint64) for v in (one, other))
        agreeing.append(jaccard_join.BITS - int(np.bitwise_count(a ^ b).sum()))
    assert min(agreeing) >= jaccard_join.least_agreeing(at) + 5 and 113 <= np.mean(agreeing) <= 117


def test_rows_without_ids_fetch_their_own_texts(spark):
    """Each text is fetched for the sets it has, however many rows share an id or have none."""
    base = [" ".join(f"t{i}x{w}" for w in range(60)) for i in range(40)]
    rows = [(None, t) for t in base] + [(None, t + " and more") for t in base] + [(7, t + " and others") for t in base] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = jaccard_join.ngram_join(df)
    got = sorted((r["component_id"] is None, r["n_links"]) for r in out.collect())
    # Every text has its longer forms as links: one without an id, three copies with one.
    assert got == [(False, 4)] * 200 and {r["component_id"] for r in out.collect()} == {7}


def test_rollup(spark, docs, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    df = docs.withColumn("source", F.lit("s")).withColumn("lang", F.when(F.col("doc_id") > 5, F.lit("en")))
    n = F.length("text")
    insert = token_rollup.changes(df, "chars", n)
    gone = token_rollup.changes(df.where("lang is null"), "chars", n, -1)
    assert rollup.totals().count() == 0
    for _ in range(2):
        rollup.commit("one", insert)
    total = sum(len(t or "") for _, t in ROWS)
    assert rollup.totals().agg(F.sum("n_tokens"), F.sum("n_docs")).first()[:] == (total, len(ROWS))
    rollup.compact()
    rollup.commit("one", insert)
    rollup.commit("two", gone)
    rollup.commit("none", gone.where("n_docs > 5"))
    want = sum(len(t or "") for i, t in ROWS if i and i > 5)
    rows = rollup.totals().collect()
    assert [(r["source"], r["lang"], r["n_tokens"]) for r in rows] == [("s", "en", want)]
    rollup.compact()
    assert rollup.totals().collect() == rows


def test_features_of_many_words_are_those_of_each():
    """Words worked on as one array have the features of their names, whatever their characters."""
    import re
    import zlib

    from rowloom.llm.quality_model import BUCKETS, _means, features_of, index_vectors

    words = ["a", "Word", "x-Y9", "\u00dcn\u00efT", "\u0391\u03a3\u03a3", "\u0130x", "\ud800x", "\u06634", "\U0001f600ab", "aaaa", "Long" * 90]
    flat, sizes = features_of(words)
    index, at = index_vectors(), 0
    for word, size, mean in zip(words, sizes, _means(words, index)):
        low, shape = f"<{word.lower()}>", word
        for pattern, name in (("[A-Z\u00c0-\u00d6\u00d8-\u00de]+", "A"), ("[a-z\u00df-\u00f6\u00f8-\u00ff]+", "a"), (r"\d+", "0")):
            shape = re.sub(pattern, name, shape)
        names = {"w" + low, "s" + shape, *(low[i : i + 3] for i in range(len(low) - 2))}
        wanted = sorted({zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names})
        assert flat[at : at + size].tolist() == wanted
        assert np.allclose(mean, index[wanted].mean(axis=0), atol=1e-6)
        at += size


def test_keys_of_sets_go_through_one_exchange(spark):
    """Lists with one set are dropped where the lists are made; copies of a set do not make a list."""
    from rowloom.llm.jaccard_join import _shared_lists

    rows = [(1, [10, 11]), (2, [11, 12]), (3, [13]), (3, [13]), (4, None), (5, [11, 14]), (5, [11, 14])]
    found = written(spark.createDataFrame(rows, "mark long, keys array<long>"), "found")
    shared = _shared_lists(found)
    assert sorted(map(tuple, shared.collect())) == [(11, 1), (11, 2), (11, 5)]
    plan = shared._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1
