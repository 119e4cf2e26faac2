"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word is described by hashed features (itself, its character trigrams, its shape). Each feature has a fixed sparse random
index vector; random indexing adds to it the index vectors of the words around its occurrences. The vector
of a word is the mean over its features, so unseen words have one too. A document is the mean over its words
and over its distinct words. A two-layer numpy network gives a logit, whose temperature is fitted on
labelled rows that the network did not see.

The model is fitted on at most ``sample`` labelled rows (those with the smallest hash of their id); its size is fixed
by ``BUCKETS`` and ``DIMENSIONS``, so broadcasting it to the tasks is bounded. Scoring covers every row and whole
texts, in batches.

Defined results: a null text is an empty one, scored like any other. Labels that are null are left out; several labels of one
id are averaged (1 from one half on). Rows with a null id are never learnt from. Without labels of both kinds the score is
the smoothed share of ones. Repeated rows get equal scores; other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import columns, tidy

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
BUCKETS, DIMENSIONS, HIDDEN = 4096, 64, 32
EPOCHS, BATCH, RATE, SEED = 30, 128, 3e-3, 7
#: Parts of the sample; each gives one partial table of context vectors (1 MB).
PARTS = 12
CACHE_WORDS = 50_000
#: Documents that are pooled together, and words of several documents that are looked up together.
ROWS, NEW_WORDS = 64, 10_000

_SHAPES = ((re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile(r"\d+"), "0"))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of every word's features (itself, its trigrams, its shape), one word after the other, and how many each has.

    Words hold no white space. They are worked on as one array of bytes; a feature's bucket is the crc32 of its name.
    """
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    joined = "\n".join(words)
    low = joined.lower().replace("\n", ">\n<").join("<>").encode("utf-8", "replace")
    data = np.frombuffer(low + b"\n", np.uint8)
    # Where characters begin, the line ends between words among them.
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    breaks = data[begins] == 10
    owner = np.cumsum(breaks) - breaks
    # Trigrams of a very long word are those of its whole length: features are a set of bounded size.
    inside = np.flatnonzero(owner[: len(begins) - 3] == owner[3:]) if len(begins) > 3 else np.zeros(0, dtype=np.int64)
    first, stop = begins[inside], begins[inside + 3]
    crc = np.full(len(inside), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int((stop - first).max(initial=0))):
        byte = data[np.minimum(first + i, len(data) - 1)]
        crc = np.where(first + i < stop, _CRC[(crc ^ byte) & 0xFF] ^ (crc >> 8), crc)
    shape = joined
    for pattern, name in _SHAPES:
        shape = pattern.sub(name, shape)
    crc32, numbers = zlib.crc32, np.arange(len(words)) * BUCKETS
    whole = np.array([crc32(b"w" + word) for word in low.split(b"\n")]) % BUCKETS
    shaped = np.array([crc32(b"s" + one) for one in shape.encode("utf-8", "replace").split(b"\n")]) % BUCKETS
    trigrams = (crc ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    every = np.sort(np.concatenate([numbers[owner[inside]] + trigrams, numbers + whole, numbers + shaped]))
    every = every[np.append(True, every[1:] != every[:-1])]
    return every % BUCKETS, np.bincount(every // BUCKETS, minlength=len(words))


def _means(words: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row per word: the mean of ``vectors`` over its features."""
    out = np.zeros((len(words), vectors.shape[1]), dtype=np.float32)
    for at in range(0, len(words), 10_000):
        flat, sizes = features_of(words[at : at + 10_000])
        # The first feature of all words, then the second of those that have one, and so on; words with most come first.
        order = np.argsort(-sizes, kind="stable")
        first, least = (np.cumsum(sizes) - sizes)[order], -sizes[order]
        sums = np.zeros((len(sizes), vectors.shape[1]), dtype=np.float32)
        for i in range(int(sizes.max(initial=0))):
            n = np.searchsorted(least, -i)
            sums[:n] += vectors[flat[first[:n] + i]]
        out[at + order] = sums / sizes[order, None]
    return out


class Words:
    """Vectors of words, remembered for a bounded number of them."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.of: np.ndarray | None = None
        self.means = np.zeros((0, 0), dtype=np.float32)

    def learn(self, words: set[str], vectors: np.ndarray) -> None:
        """Makes sure that all of these words are known."""
        if self.of is not vectors:
            self.of, self.means = vectors, np.zeros((1024, vectors.shape[1]), dtype=np.float32)
            self.places.clear()
        unseen = sorted(words.difference(self.places))
        if len(self.places) + len(unseen) > CACHE_WORDS:
            self.places.clear()
            unseen = sorted(words)
        start, end = len(self.places), len(self.places) + len(unseen)
        if end > len(self.means):
            larger = np.zeros((max(end, min(2 * end, CACHE_WORDS)), vectors.shape[1]), dtype=np.float32)
            larger[:start] = self.means[:start]
            self.means = larger
        if unseen:
            self.means[start:end] = _means(unseen, vectors)
            self.places.update(zip(unseen, range(start, end)))

    def vectors(self, words: Iterable[str], count: int) -> np.ndarray:
        """A row per word; all have been learnt."""
        return self.means[np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=count)]


def index_vectors() -> np.ndarray:
    """One sparse vector of -1, 0 and 1 per feature, the same everywhere."""
    random = np.random.default_rng(SEED)
    signs = random.choice([-1.0, 0.0, 1.0], size=(BUCKETS, DIMENSIONS), p=[0.1, 0.8, 0.1])
    return signs.astype(np.float32)


def _add(total: np.ndarray, rows: np.ndarray, vectors: np.ndarray, picked: np.ndarray) -> None:
    """Adds the picked vectors to rows of ``total``; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    total[rows[first]] += np.add.reduceat(vectors[picked[order]], first, axis=0)


def contexts(texts: Iterator[str], index: np.ndarray) -> np.ndarray:
    """What random indexing adds to each feature: the index vectors of the words next to its words.

    Sums are kept by word, and spread over the features of the words whenever ``CACHE_WORDS`` words have come together.
    """
    total, places = np.zeros_like(index), {}
    own = np.zeros((CACHE_WORDS, index.shape[1]), dtype=np.float32)
    sums = np.zeros_like(own)

    def spread() -> None:
        known = list(places)
        for start in range(0, len(known), 10_000):
            features, sizes = features_of(known[start : start + 10_000])
            _add(total, features, sums, np.repeat(np.arange(start, start + len(sizes)), sizes))
        places.clear()
        sums[:] = 0

    for text in texts:
        found = text.split()
        if len(found) < 2:
            continue
        distinct = dict.fromkeys(found)
        if len(places) + len(distinct) > len(own):
            spread()
            if len(distinct) > len(own):
                own = np.zeros((len(distinct), index.shape[1]), dtype=np.float32)
                sums = np.zeros_like(own)
        unseen = [word for word in distinct if word not in places]
        if unseen:
            own[len(places) : len(places) + len(unseen)] = _means(unseen, index)
            places.update(zip(unseen, range(len(places), len(places) + len(unseen))))
        ids = np.fromiter(map(places.__getitem__, found), dtype=np.int64, count=len(found))
        _add(sums, ids[1:], own, ids[:-1])
        _add(sums, ids[:-1], own, ids[1:])
    spread()
    return total


def pooled(texts: list[str], vectors: np.ndarray, words: Words) -> np.ndarray:
    """A row per text: means over words and over distinct words, their norms, and the sizes behind them."""
    a = np.zeros((len(texts), vectors.shape[1]), dtype=np.float32)
    b = np.zeros_like(a)
    sizes = np.zeros((len(texts), 2), dtype=np.float32)
    held: list[tuple[int, Counter]] = []
    n_held = 0
    for row, text in enumerate(texts):
        held.append((row, Counter(text.split())))
        n_held += len(held[-1][1])
        # Words that are new come together over several texts.
        if n_held < NEW_WORDS and row < len(texts) - 1:
            continue
        words.learn({word for _, counts in held for word in counts}, vectors)
        for at, counts in held:
            if counts:
                n, often = sum(counts.values()), np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
                means = words.vectors(counts, len(counts))
                a[at], b[at] = often @ means / n, means.mean(axis=0)
                sizes[at] = np.log1p(n) / 10, len(counts) / n
        held, n_held = [], 0
    norms = np.stack([np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1), np.linalg.norm(a - b, axis=1)], axis=1)
    return np.hstack([a, b, norms, sizes]).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Weights, scaling and temperature; every fifth row is held back for the temperature."""
    random = np.random.default_rng(SEED)
    back = np.arange(len(x)) % 5 == 0
    mean, scale = x[~back].mean(axis=0), x[~back].std(axis=0) + 1e-6
    z = (x - mean) / scale
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,)]
    weights = [random.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    rows, target, step = z[~back].astype(np.float64), y[~back].astype(np.float64), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            step += 1
            take = order[start : start + BATCH]
            hidden = np.maximum(rows[take] @ weights[0] + weights[1], 0)
            wrong = (_sigmoid((hidden @ weights[2] + weights[3])[:, 0]) - target[take])[:, None] / len(take)
            back_hidden = (wrong @ weights[2].T) * (hidden > 0)
            grads = [rows[take].T @ back_hidden, back_hidden.sum(0), hidden.T @ wrong, wrong.sum(0)]
            for i, grad in enumerate(grads):
                grad = grad + 1e-4 * weights[i] * (grad.ndim == 2)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                weights[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "weights": weights, "temperature": 1.0}
    logits, truth = _logits(model, x[back]), y[back]
    grid = np.exp(np.linspace(np.log(0.5), np.log(20.0), 60))
    losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
    model["temperature"] = float(grid[int(np.argmin(losses))]) if len(truth) else 1.0
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["weights"]
    hidden = np.maximum(((x - model["mean"]) / model["scale"]) @ w[0] + w[1], 0)
    return (hidden @ w[2] + w[3])[:, 0]


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``folds``, is 0. True without an id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE,
) -> dict:
    """The model, fitted on a bounded sample of the labelled rows that are not held out."""
    known = (
        columns(labels, _key=key, _label=label)
        .where(F.col("_label").isNotNull() & F.col("_key").isNotNull() & ~held_out(F.col("_key")))
        .groupBy("_key").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    # At most ``sample`` rows of an id and a label.
    rows = columns(docs, _key=key, _text=text).join(F.broadcast(known), "_key")
    # Never more than PARTS tasks, also where a session deals keys to more partitions.
    rows = rows.repartition(PARTS, "_key").coalesce(PARTS).sortWithinPartitions("_key", F.xxhash64("_text"))
    rows = rows.select("_key", "_label", F.coalesce("_text", F.lit("")).alias("_text"))
    index = index_vectors()

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = contexts((t for part in parts for t in part["_text"]), index)
        if total.any():
            yield pd.DataFrame({"part": [total.tobytes()]})

    # PARTS tables of fixed size; sorted, so that their sum does not depend on the order of arrival.
    tables = sorted(bytes(r["part"]) for r in rows.mapInPandas(tidy(partial), "part binary").collect())
    vectors = index.copy()
    if tables:
        around = sum(np.frombuffer(t, dtype=np.float32).reshape(index.shape).astype(np.float64) for t in tables)
        norms = np.linalg.norm(around, axis=1, keepdims=True)
        lengths = np.linalg.norm(index, axis=1, keepdims=True)
        vectors = (index + np.where(norms > 0, around / np.maximum(norms, 1e-9) * lengths, 0)).astype(np.float32)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for part in parts:
            for start in range(0, len(part), ROWS):
                some = part.iloc[start : start + ROWS]
                x = pooled(list(some["_text"]), vectors, words)
                yield pd.DataFrame({"key": some["_key"].to_numpy(), "label": some["_label"].to_numpy(), "x": [r.tobytes() for r in x]})

    kind = rows.schema["_key"].dataType.simpleString()
    found = sorted(
        (r["key"], r["label"], bytes(r["x"])) for r in rows.mapInPandas(tidy(features), f"key {kind}, label int, x binary").collect()
    )
    y = np.array([label for _, label, _ in found], dtype=np.float64)
    if len(set(y)) < 2 or len(y) < 10:
        return {"vectors": vectors, "constant": float((y.sum() + 1) / (len(y) + 2))}
    # The order of ids would put kinds of documents together; a fixed shuffle mixes them.
    order = np.random.default_rng(SEED).permutation(len(found))
    x = np.stack([np.frombuffer(x, dtype=np.float32) for _, _, x in found])[order]
    return {"vectors": vectors, **train(x, y[order])}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 1 MB, whatever the data

    @F.arrow_udf("double")
    @tidy
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, model = Words(), shared.value
        for part in parts:
            if "constant" in model:
                yield pa.array(np.full(len(part), model["constant"]))
                continue
            out = [np.zeros(0)]
            # Few texts at a time become Python strings; the batch stays as it came.
            for start in range(0, len(part), ROWS):
                x = pooled([t or "" for t in part.slice(start, ROWS).to_pylist()], model["vectors"], words)
                out.append(_sigmoid(_logits(model, x) / model["temperature"]))
            yield pa.array(np.concatenate(out).astype(np.float64))

    return docs.withColumn("_score", probability(F.coalesce(F.col(text), F.lit(""))))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    model = fit(docs, labels, key, text, label, sample)
    rows = score(columns(docs, **{key: key, "_text": text}), model, "_text")
    return rows.select(
        key, held_out(F.col(key)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
