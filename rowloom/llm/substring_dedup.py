"""Removal of passages that repeat across documents.

Paragraphs (lines of at least ``min_words`` words, and of at least one shingle) are compared by MinHash banding: bands and
rows are tuned for high recall at the threshold, paragraphs that hang together by collisions in a band are one group, all pairs of a
group are compared by the exact Jaccard of their word shingles (large groups in bounded blocks, block against block), and verified
pairs are clustered by connected components. Passages inside of paragraphs are found by windows of ``WINDOW`` words: of every
``min_words`` words in a row the window with the smallest hash is kept, so any passage of that many words that two texts share has a
window in both; where a window occurs in several texts, every window around it is compared, and a passage is found to its last word.
A window that a text holds again and again at close places (a run of one word, a short period) is one row there, not one for each place.

The smallest doc_id that holds a passage keeps it; others lose it if it has at least ``min_words`` words in one stretch.
Copies of whole texts are settled first, by hashes of the text alone.

Decisions are made on ids, places and hashes. Whole texts are read three times and shuffled at most twice, each time in one join: with the
places to look at, and with the cuts. What is written between the steps is freed when the next step no longer needs it.

Defined results: null texts stay null, texts shorter than ``min_words`` and texts without repeats stay as they are, to the last
character. Rows that share a doc_id count as one document: nothing in them repeats across documents. Rows
without an id keep a passage only if no other row has it, and are one document together. What is removed goes with the white space
behind it; lines that lose all words go as a whole. Columns beside the named ones are passed on unchanged, whatever they are called,
but for ``_removed`` and ``_kept_in``, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.names import all_named
from rowloom.llm.common import exact, tidy
from rowloom.llm.components import components
from rowloom.llm.jaccard_join import Threshold, block_tasks, links
from rowloom.llm.shingles import Hasher, doubled, mixed, sequence_name, shingle_set, split_words, windows
from rowloom.session import discard, written

SHINGLE, SIMILARITY, RECALL, MIN_WORDS = 5, 0.8, 0.99, 50
#: Words of a window, a power of two.
WINDOW = 16
#: Words that are worked on as one array.
WORDS = 100_000
#: Small tables (groups of copies, rows with removals) are broadcast up to this many values, those of arrays counted one by
#: one, else shuffled.
BROADCAST_VALUES = 20_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_ID = (1 << 63) - 1


def tune(similarity: float, recall: float, most: int = 64) -> tuple[int, int]:
    """Bands and rows: the most rows per band that reach the recall at the similarity with ``most`` hashes at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches that recall")


def minhash(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band for each set of shingles; ``first`` tells where in ``grams`` each set begins."""
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    # A multiplication by an odd number after the exclusive or permutes well enough for minima of hashes.
    least = np.stack([np.minimum.reduceat((grams ^ seed) * np.uint64(0x9E3779B97F4A7C15), first) for seed in seeds], axis=1)
    least = least.reshape(len(first), bands, rows)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(first), 1))
    for i in range(rows):
        key = mixed(key + least[:, :, i])
    return key.view(np.int64)


def _extreme(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The extreme of every ``width`` values in a row, by its start."""
    out, size = values, 1
    while size * 2 <= width:
        out, size = of(out[:-size], out[size:]), size * 2
    return of(out[: len(values) - width + 1], out[width - size :]) if size < width else out


def starts(words: np.ndarray, begins: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the kept windows begin, and their hashes: of every ``min_words`` words in a row the smallest.

    ``words`` holds several texts, one after the other; ``begins`` where each begins. No window leaves its text.
    """
    hashes, choice = doubled(words, WINDOW), min_words - WINDOW + 1
    if len(words) < min_words:
        return np.zeros(0, dtype=np.int64), hashes[:0]
    ends = np.append(begins[1:], len(words))
    left = np.repeat(ends, ends - begins) - np.arange(len(words))
    least = np.where(left[: len(words) - min_words + 1] >= min_words, _extreme(hashes, choice, np.minimum), 0)
    # A window is kept if it is the smallest of any of the choices that it stands in.
    around = np.concatenate([np.zeros(choice - 1, np.uint64), least, np.zeros(choice - 1, np.uint64)])
    places = np.flatnonzero((_extreme(around, choice, np.maximum) == hashes) & (hashes > 0))
    return places, hashes[places]


def together(places: np.ndarray, names: np.ndarray, owner: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first and the last of equal names stand that follow one another at most ``gap`` places apart in one text.

    ``places`` are in order, as are the texts that own them; both results are positions among them, by the first.
    """
    order = np.argsort(names, kind="stable")
    places, names, owner = places[order], names[order], owner[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(places) > gap)
    first, last = order[fresh], order[np.append(fresh[1:], True)[: len(order)]]
    by_first = np.argsort(first)
    return first[by_first], last[by_first]


def spans(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all spans, one after the other, and where among them each span begins."""
    begins = np.cumsum(sizes) - sizes
    return np.repeat(first - begins, sizes) + np.arange(sizes.sum()), begins


def _words(text: str, hasher: Hasher) -> np.ndarray:
    return hasher.words(split_words(text, lower=False))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, shingle: int = SHINGLE,
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and ``_removed`` and ``_kept_in``.

    ``_removed`` holds the removed stretches as (first word, words), ``_kept_in`` the ids that keep their text.
    """
    if min_words < WINDOW:
        raise ValueError(f"min_words must be {WINDOW} at least")
    bands, band_rows = tune(similarity, recall)
    body = F.coalesce(exact(docs, text), F.lit(""))
    rows = docs.select(F.coalesce(exact(docs, key).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))
    # Copies of whole texts: the smallest id stands for all of them from here on.
    ids = rows.select("d", "t", F.xxhash64(F.lit(7), "text").alias("t2"))
    texts = written(ids.groupBy("t", "t2").agg(F.min("d").alias("first"), F.max("d").alias("last")), "texts")

    units = written(_units(rows, min_words, bands, band_rows, shingle), "units")
    lines, found = units.where(F.col("line") >= 0), units.where(F.col("line") < 0)
    classes, shown = _paragraph_groups(lines)
    around = _repeated_windows(found)
    no_line, no_place = F.lit(None).cast("struct<line:int,node:bigint,root:bigint>"), F.lit(None).cast("struct<first:int,n:int>")
    places = shown.select("d", "t", F.struct("line", "node", "root").alias("line"), no_place.alias("place")).unionByName(
        around.select("d", "t", no_line.alias("line"), F.struct("first", "n").alias("place"))
    )
    places = places.groupBy("d", "t").agg(F.collect_list("line").alias("lines"), F.sort_array(F.collect_set("place")).alias("places"))
    is_first = texts.select(F.col("first").alias("d"), "t")
    places = written(places.join(is_first, ["d", "t"], "left_semi"), "places")
    looked = written(_looked(rows, _checked(places), shingle, min_words), "looked")
    discard(places)

    whole = _near_paragraphs(lines, classes, looked.where("node IS NOT NULL"), similarity)
    inside, keepers = _held_windows(looked.where("names IS NOT NULL"))
    stretches = whole.unionByName(inside).groupBy("d", "t").agg(
        F.sort_array(F.collect_list(F.struct("first", "n"))).alias("cuts"), F.collect_set("keeper").alias("keepers")
    )
    decided = texts.join(stretches.withColumnRenamed("d", "first"), ["first", "t"], "left")
    decided = written(decided.where((F.col("last") > F.col("first")) | F.col("cuts").isNotNull()).drop("last"), "cuts")
    discard(units, classes, looked, keepers)
    return _cut(docs, key, text, _checked(decided), min_words)


def _checked(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted values allow it."""
    values = sum((F.size(c) if kind.startswith("array") else F.lit(1) for c, kind in table.dtypes), F.lit(0))
    counted = table.agg(F.sum(values.cast("long"))).first()[0] or 0
    return F.broadcast(table) if counted <= BROADCAST_VALUES else table


def _units(rows: DataFrame, min_words: int, bands: int, band_rows: int, shingle: int) -> DataFrame:
    """Paragraphs ``(d, t, line, first, n, name, keys)`` and kept windows (the same with line -1 and no keys).

    Equal kept windows of a text are one row if all between them is looked at anyway: ``n`` words from the first to the last.
    """
    gap = 2 * (min_words - WINDOW) + 1

    def some(texts: list[tuple[int, list[list[bytes]]]], hasher: Hasher) -> list[tuple]:
        """The columns of what a few texts give, worked on as one array of words."""
        words = hasher.words([word for _, lines in texts for line in lines for word in line])
        rows = np.array([row for row, _ in texts])
        n_lines = np.array([len(lines) for _, lines in texts])
        sizes = np.array([len(line) for _, lines in texts for line in lines])
        line_first = np.cumsum(sizes) - sizes
        numbers, line_begins = spans(np.zeros(len(rows), dtype=np.int64), n_lines)
        begins = line_first[line_begins]
        out = []
        long = np.flatnonzero(sizes >= max(min_words, shingle))
        if len(long):
            owner = np.searchsorted(line_begins, long, side="right") - 1
            places, first = spans(line_first[long], sizes[long] - shingle + 1)
            keys = minhash(windows(words, shingle)[places], first, bands, band_rows)
            names = [sequence_name(words[a : a + n]) for a, n in zip(line_first[long], sizes[long])]
            out.append((rows[owner], numbers[long], line_first[long] - begins[owner], sizes[long], np.array(names), list(keys)))
        places, names = starts(words, begins, min_words)
        owner = np.searchsorted(begins, places, side="right") - 1
        a, b = together(places, names, owner, gap)
        nothing, n = np.full(len(a), -1), places[b] - places[a] + WINDOW
        out.append((rows[owner[a]], nothing, places[a] - begins[owner[a]], n, names[a].view(np.int64), [None] * len(a)))
        return out

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def found(batch: pa.RecordBatch, texts: list) -> Iterator[pa.RecordBatch]:
            for owner, line, first, size, name, keys in some(texts, hasher):
                picked = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("d").take(picked), batch.column("t").take(picked), pa.array(line, pa.int32()),
                        pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(name, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["d", "t", "line", "first", "n", "name", "keys"],
                )

        for batch in batches:
            texts, n = [], 0
            for row, value in enumerate(batch.column("text")):
                lines = [line.split() for line in value.as_py().encode("utf-8", "surrogatepass").split(b"\n")]
                size = sum(map(len, lines))
                if size < min_words:
                    continue
                texts.append((row, lines))
                n += size
                if n >= WORDS:
                    yield from found(batch, texts)
                    texts, n = [], 0
            if texts:
                yield from found(batch, texts)

    return rows.mapInArrow(tidy(units), "d long, t long, line int, first int, n int, name long, keys array<long>")


def _paragraph_groups(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal paragraphs as classes ``(name, least, shown, keys)``, and where a class of each group is shown."""
    classes = written(
        lines.groupBy("name").agg(
            F.min("d").alias("least"), F.min(F.struct("d", "t", "line")).alias("shown"), F.first("keys").alias("keys")
        ),
        "paragraph-classes",
    )
    # Heads only form the groups; inside a group every pair is compared.
    banded = classes.select("name", F.explode("keys").alias("band"))
    heads = banded.groupBy("band").agg(F.min("name").alias("head"), F.max("name").alias("last"))
    heads = written(heads.where(F.col("head") < F.col("last")).drop("last"), "band-heads")
    groups = components(banded.join(heads, "band").where(F.col("name") != F.col("head")), "head", "name")
    discard(heads)
    return classes, groups.join(classes, F.col("node") == F.col("name")).select("node", "root", "shown.d", "shown.t", "shown.line")


def _looked(rows: DataFrame, places: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """What the texts hold at the places: shingles of paragraphs, and all windows around those that repeat.

    A row has ``node``, ``root``, ``n``, ``shingles`` or else ``d``, ``t``, ``first``, ``n`` and ``names``, the windows from there on.
    Equal windows that touch or overlap are one name in a row of its own, of the ``n`` words that they cover.
    """
    schema = pa.schema([
        ("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()),
        ("d", pa.int64()), ("t", pa.int64()), ("first", pa.int32()), ("names", pa.list_(pa.int64())),
    ])
    # A passage goes on for less than this beyond its first and its last kept window.
    reach = min_words - WINDOW

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out, held = Hasher(), [[] for _ in schema], 0

        def give(*row) -> None:
            for column, value in zip(out, row):
                column.append(value)

        def given() -> pa.RecordBatch:
            arrays = [pa.array(column, field.type) for column, field in zip(out, schema)]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def give_windows(d: int, t: int, at: int, names: np.ndarray) -> None:
            each = np.arange(len(names))
            first, last = together(each, names, np.zeros_like(each), WINDOW)
            repeats = last > first
            for a, b in zip(first[repeats], last[repeats]):
                give(None, None, int(b - a) + WINDOW, None, d, t, at + int(a), names[a : a + 1])
            alone = first[~repeats]
            for part in np.split(alone, np.flatnonzero(np.diff(alone) > 1) + 1):
                if len(part):
                    give(None, None, WINDOW, None, d, t, at + int(part[0]), names[part[0] : part[-1] + 1])

        for batch in batches:
            for d, t, value, lines, at in zip(*(batch.column(c) for c in ("d", "t", "text", "lines", "places"))):
                value = value.as_py()
                if len(lines):
                    text_lines = value.split("\n")
                    for line in lines.as_py():
                        found = shingle_set(_words(text_lines[line["line"]], hasher), shingle)
                        give(line["node"], line["root"], len(found), found.tobytes(), None, None, None, None)
                        held += len(found)
                if len(at):
                    hashes = doubled(_words(value, hasher), WINDOW).view(np.int64)
                    first, n = (at.values.field(c).to_numpy() for c in ("first", "n"))
                    begins = np.maximum(first - reach, 0)
                    ends = np.maximum.accumulate(np.minimum(first + n - WINDOW + reach + 1, len(hashes)))
                    apart = np.flatnonzero(np.r_[True, begins[1:] > ends[:-1]])
                    for a, b in zip(begins[apart], ends[np.r_[apart[1:] - 1, len(ends) - 1]]):
                        give_windows(d.as_py(), t.as_py(), int(a), hashes[a:b])
                    # A part of an array keeps all of it.
                    held += len(hashes)
                # What several texts give goes on together.
                if held >= WORDS:
                    yield given()
                    held = 0
        if out[0]:
            yield given()

    kinds = "node long, root long, n long, shingles binary, d long, t long, first int, names array<long>"
    return rows.join(places, ["d", "t"]).select("d", "t", "text", "lines", "places").mapInArrow(tidy(look), kinds)


def _near_paragraphs(lines: DataFrame, classes: DataFrame, looked: DataFrame, similarity: float) -> DataFrame:
    """Stretches ``(d, t, first, n, keeper)`` of paragraphs that a smaller id holds alike."""
    # Rows of one id and equal text show the same paragraph; any of them will do.
    shingles = looked.groupBy("node", "root").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    shingles = written(shingles, "paragraph-shingles")
    share = Fraction(str(similarity))
    at = Threshold(share.numerator, share.denominator)
    tasks = block_tasks(shingles.select("root", "node", "n"), at).select("node", F.explode("tasks").alias("_task"))
    met = shingles.select("node", "shingles").join(tasks, "node")
    met = met.select("node", "shingles", F.col("_task.task").alias("task"), F.col("_task.side").alias("side"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part["node"].to_numpy()
        values = [np.frombuffer(v, dtype=np.uint64) for v in part["shingles"]]
        edges, _ = links(values, np.ones(len(nodes), dtype=np.int64), part["side"].to_numpy(), at)
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in edges], columns=["a", "b"], dtype=np.int64)

    linked = written(met.groupBy("task").applyInPandas(compare, "a long, b long"), "paragraph-links")
    discard(shingles)
    clusters = components(linked)
    clustered = classes.select("name", "least").join(clusters.withColumnRenamed("node", "name"), "name", "left")
    clustered = clustered.withColumn("root", F.coalesce("root", "name"))
    keepers = clustered.groupBy("root").agg(F.min("least").alias("keeper"))
    # Written, so that Spark can split a paragraph that very many documents hold.
    kept = written(clustered.join(keepers, "root").where(F.col("least") >= F.col("keeper")).select("name", "keeper"), "kept")
    return lines.join(kept, "name").where(F.col("keeper") < F.col("d")).select("d", "t", "first", "n", "keeper")


def _repeated_windows(found: DataFrame) -> DataFrame:
    """Kept windows ``(d, t, first, n)`` that other documents with another text hold as well."""
    span = [f("d" if c == "d" else "t").alias(f"{n}_{c}") for c in ("d", "t") for n, f in (("least", F.min), ("most", F.max))]
    repeated = found.groupBy("name").agg(*span).where("least_d < most_d AND least_t < most_t").select("name")
    return found.join(written(repeated, "repeated"), "name").select("d", "t", "first", "n")


def _held_windows(looked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches of windows that a smaller id holds too, and the table ``(name, keeper)`` they are found by."""
    every = looked.select("d", "t", "first", "n", F.posexplode("names").alias("at", "name")).select(
        "d", "t", (F.col("first") + F.col("at")).alias("first"), "n", "name"
    )
    keepers = every.groupBy("name").agg(F.min("d").alias("keeper"), F.max("d").alias("last"))
    keepers = written(keepers.where(F.col("keeper") < F.col("last")).drop("last"), "keepers")
    held = every.join(keepers, "name").where(F.col("keeper") < F.col("d"))
    return held.select("d", "t", "first", F.col("n").cast("int").alias("n"), "keeper"), keepers


def stretches_of(cuts: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """The union of (first, n) stretches, as far as they reach ``min_words``."""
    out: list[list[int]] = []
    for first, n in sorted(cuts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + n)
        else:
            out.append([first, first + n])
    return [(a, b - a) for a, b in out if b - a >= min_words]


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without word stretches; lines that lose all words go, the others keep what is left as it stands."""
    removed = set()
    for first, n in cuts:
        removed.update(range(first, first + n))
    at, lines = 0, []
    for line in text.split("\n"):
        words = list(_WORD.finditer(line))
        gone = [i for i in range(len(words)) if at + i in removed]
        at += len(words)
        if not gone:
            lines.append(line)
            continue
        if len(gone) == len(words):
            continue
        kept, end = [], 0
        for i, word in enumerate(words):
            stop = words[i + 1].start() if i + 1 < len(words) else len(line)
            if at - len(words) + i not in removed:
                kept.append(line[end if not kept and i == 0 else word.start() : stop])
            end = stop
        lines.append("".join(kept).rstrip(" \t") if len(words) - 1 in gone else "".join(kept))
    return "\n".join(lines)


def _cut(docs: DataFrame, key: str, text: str, decided: DataFrame, min_words: int) -> DataFrame:
    """The rows with their texts cut, by one join of the texts with the decisions on ``(t, t2)``."""
    body = F.coalesce(exact(docs, text), F.lit(""))
    # The columns of the table stay together in one, so none of them can clash with those made here.
    rows = docs.select(
        F.struct(*all_named(docs.columns)).alias("row"), F.coalesce(exact(docs, key).cast("long"), F.lit(_NO_ID)).alias("d"),
        F.xxhash64(body).alias("t"), F.xxhash64(F.lit(7), body).alias("t2"),
    )
    joined = rows.join(decided, ["t", "t2"], "left")

    @F.pandas_udf("struct<text:string,removed:array<struct<first:int,n:int>>>")
    def apply(texts: pd.Series, cuts: pd.Series, is_copy: pd.Series) -> pd.DataFrame:
        out, removed = [], []
        for value, found, copied in zip(texts, cuts, is_copy):
            if value is None:
                gone = []
            elif copied:
                n = len(_WORD.findall(value))
                gone = [(0, n)] if n >= min_words else []
            else:
                gone = stretches_of([(c["first"], c["n"]) for c in found], min_words)
            out.append(without(value, gone) if gone else value)
            removed.append([{"first": a, "n": n} for a, n in gone])
        return pd.DataFrame({"text": out, "removed": removed})

    is_copy = F.coalesce(F.col("first") < F.col("d"), F.lit(False))
    touched = is_copy | F.col("cuts").isNotNull()
    held = F.col("row").getField(text)
    # Only texts that repeat anything pass through Python.
    done = joined.withColumn("copied", is_copy).withColumn("touched", touched)
    done = done.withColumn("done", apply(F.when(F.col("touched"), held), F.when(F.col("touched"), F.col("cuts")), F.col("copied")))
    cut = F.col("touched") & (F.size("done.removed") > 0)
    keepers = F.when(F.col("copied"), F.array("first")).otherwise(F.coalesce("keepers", F.array().cast("array<long>")))
    kept = [c for c in docs.columns if c not in ("_removed", "_kept_in")]
    return done.select(
        *[(F.when(cut, F.col("done.text")).otherwise(held) if c == text else F.col("row").getField(c)).alias(c) for c in kept],
        F.when(cut, F.col("done.removed")).otherwise(F.array().cast("array<struct<first:int,n:int>>")).alias("_removed"),
        F.when(cut, keepers).otherwise(F.array().cast("array<long>")).alias("_kept_in"),
    )
