"""Secrets in texts: patterns that always count, and a character network that finds what the patterns miss.

One pass over the texts gives each document's matches of the patterns and all its candidates: every run of the characters secrets are
written in that is long, or holds letters and digits. A candidate becomes a window of fixed length, its characters between those
around it; of very long ones the start and the end. A convolutional network over the characters, written in numpy, gives each
window a probability: five characters wide, pooled over the candidate and over its surroundings apart, then two dense layers.

It is trained on labelled findings: windows of pattern matches are secrets, those of other candidates are not. In training, secrets
also appear between the surroundings of candidates and cut short (to ``SHORTEST`` characters at least), and others in capitals, so the network has to know them by their own characters as
well as by the words before them. Windows of a quarter of all values, which training never sees, calibrate the logits
(slope and offset) and set the thresholds, one per shape (lower-case hexadecimal, upper case, others): each keeps ``RECALL`` of the
held-out secrets, as they stand and varied as in training, and lies halfway (in logits) between the largest that does and the smallest that
lets no more than ``FALSE`` of the other candidates through; it is never less than one half.

The network is fitted on all distinct windows, dealt by their hashes to parts of about ``PART``. One part is trained on by one task.
With more, each round passes over the windows of every part, all from the same weights, and the next one goes on from the mean of what the parts reached;
calibration and thresholds come from sums and exact order statistics over the held-out windows of all parts. Every candidate of every
document is scored. With fewer than ``LEAST`` distinct windows of a label nothing is added to the matches.

Defined results: a null or empty text has no spans, and its digest is that of the empty string. Positions count code points. A candidate that
overlaps a match is no candidate of its own. Repeated rows each give a row. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import functools
import io
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import columns
from rowloom.session import written

KINDS = ("assign", "access", "hex")
#: The name of spans that the network adds.
ADDED = "network"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of secrets. Keywords in either case of ASCII letters only.
_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# A run that is too short is dropped whole, so the least length may stand in the pattern.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_MIN_ASSIGNED = 6

#: Candidates: runs of at least so many characters, or of fewer with letters and digits.
_RUN, _PLAIN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}"), 16
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: Characters of a window: before, the candidate's first and last ones, behind.
AROUND, FIRST, LAST = 24, 32, 16
_INSIDE = FIRST + LAST
WIDTH = 2 * AROUND + _INSIDE

#: Windows of a part, as the mean of all parts: what a task learns from at a time.
PART, LEAST, HELD_OUT = 6000, 8, 4
RECALL = 0.99
#: Held-out candidates above the lower end of the range for a threshold, at most.
FALSE = 0.001
#: With fewer held-out findings of a shape, the threshold comes from those of all shapes.
ENOUGH = 20
#: Secrets are cut to so many characters at least in training.
SHORTEST = 12
_EPOCHS, _BATCH, _RATE = 12, 128, 4e-3
_DIM, _FILTERS, _SPAN, _DENSE = 10, 32, 5, 32
#: Classes of characters: none, printable ASCII, and others.
_CHARS = 97
_ZERO, _A_UPPER, _A_LOWER = ord("0") - 31, ord("A") - 31, ord("a") - 31


def matches(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of all matches, by start and kind."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= _MIN_ASSIGNED]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, known: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the runs that may be secrets and overlap no match."""
    at, covered = 0, -1
    for run in _RUN.finditer(text):
        value = run.group()
        left = len(value) - len(value.lstrip(".-"))
        start, value = run.start() + left, value.strip(".-")
        end = start + len(value)
        if len(value) < _PLAIN and (len(value) < 8 or not (_DIGIT.search(value) and _LETTER.search(value))):
            continue
        while at < len(known) and known[at][0] < end:
            covered = max(covered, known[at][2])
            at += 1
        if start >= covered:
            yield start, end


def window(text: str, start: int, end: int) -> str:
    """The characters of a finding and around it at fixed places; NUL where there are none."""
    value = text[start:end] if end - start <= _INSIDE else text[start : start + FIRST] + text[end - LAST : end]
    before, behind = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    return before.rjust(AROUND, "\0") + value.ljust(_INSIDE, "\0") + behind.ljust(AROUND, "\0")


_FOUND = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.string()), ("secret", pa.bool_())])
)
_SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``matches`` ``(start, kind, end)`` in order, and ``found``: the windows of matches and of candidates."""
    own = columns(docs, doc_id=key, text=text)
    schema = "doc_id {}, matches array<struct<start: bigint, kind: int, end: bigint>>, found array<struct<" \
             "start: bigint, end: bigint, window: string, secret: boolean>>".format(own.schema["doc_id"].dataType.simpleString())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for value in batch.column("text"):
                string = value.as_py() or ""
                known = matches(string)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in known])
                inside = [{"start": v, "end": e, "window": window(string, v, e), "secret": True} for _, _, e, v in known]
                other = [{"start": s, "end": e, "window": window(string, s, e), "secret": False} for s, e in candidates(string, known)]
                found.append(inside + other)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, _SPAN_LIST), pa.array(found, _FOUND)], names=["doc_id", "matches", "found"]
            )

    return own.mapInArrow(scan, schema)


# -- the network ------------------------------------------------------------------------------------------------------

_REGION = np.repeat([0, 1, 0], [AROUND, _INSIDE, AROUND])


def encoded(windows: list[str]) -> np.ndarray:
    """The class of every character of every window."""
    points = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(len(windows), WIDTH)
    classes = np.where((points >= 32) & (points < 127), points - 31, _CHARS - 1)
    return np.where(points == 0, 0, classes).astype(np.intp)


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def drawn(*shape: int, inputs: int) -> np.ndarray:
        return (rng.standard_normal(shape) * np.sqrt(2 / inputs)).astype(np.float32)

    pooled = 3 * _FILTERS + 1
    return {
        "char": drawn(_CHARS, _DIM, inputs=2 * _DIM), "region": drawn(2, _DIM, inputs=2 * _DIM),
        "conv": drawn(_SPAN * _DIM, _FILTERS, inputs=_SPAN * _DIM), "conv_b": np.zeros(_FILTERS, np.float32),
        "dense": drawn(pooled, _DENSE, inputs=pooled), "dense_b": np.zeros(_DENSE, np.float32),
        "out": drawn(_DENSE, 1, inputs=_DENSE), "out_b": np.zeros(1, np.float32),
    }


def _forward(net: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of the windows, and what the way back needs."""
    n, half = len(codes), _SPAN // 2
    chars = net["char"][codes] + net["region"][_REGION]
    padded = np.pad(chars, ((0, 0), (half, half), (0, 0)))
    columns_ = np.lib.stride_tricks.sliding_window_view(padded, _SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n * WIDTH, -1)
    hidden = np.maximum(columns_ @ net["conv"] + net["conv_b"], 0).reshape(n, WIDTH, _FILTERS)
    inside = (codes > 0) & (_REGION == 1)
    length = np.maximum(inside.sum(1, keepdims=True), 1).astype(np.float32)
    mean = (hidden * inside[:, :, None]).sum(1) / length
    own = np.where(inside[:, :, None], hidden, 0).argmax(1)
    around = np.where((_REGION == 0)[None, :, None], hidden, 0).argmax(1)
    best = [np.take_along_axis(hidden, i[:, None, :], 1)[:, 0] for i in (own, around)]
    pooled = np.concatenate([mean, best[0] * inside[np.arange(n)[:, None], own], best[1], length / _INSIDE], 1)
    dense = np.maximum(pooled @ net["dense"] + net["dense_b"], 0)
    return (dense @ net["out"] + net["out_b"])[:, 0], (codes, columns_, hidden, inside, length, own, around, pooled, dense)


def _gradients(net: dict[str, np.ndarray], kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
    codes, columns_, hidden, inside, length, own, around, pooled, dense = kept
    n, half, rows = len(codes), _SPAN // 2, np.arange(len(codes))[:, None]
    filters = np.arange(_FILTERS)[None, :]
    error = error[:, None]
    at_dense = (error @ net["out"].T) * (dense > 0)
    at_pool = at_dense @ net["dense"].T
    at_hidden = (at_pool[:, None, :_FILTERS] / length[:, :, None]) * inside[:, :, None]
    at_hidden[rows, own, filters] += at_pool[:, _FILTERS : 2 * _FILTERS] * inside[rows, own]
    at_hidden[rows, around, filters] += at_pool[:, 2 * _FILTERS : 3 * _FILTERS]
    at_conv = (at_hidden * (hidden > 0)).reshape(n * WIDTH, _FILTERS)
    at_columns = (at_conv @ net["conv"].T).reshape(n, WIDTH, _SPAN, _DIM)
    at_chars = np.zeros((n, WIDTH + 2 * half, _DIM), np.float32)
    for k in range(_SPAN):
        at_chars[:, k : k + WIDTH] += at_columns[:, :, k]
    at_chars = at_chars[:, half : half + WIDTH]
    flat, marks = at_chars.reshape(-1, _DIM), codes.reshape(-1)
    by_char = np.stack([np.bincount(marks, flat[:, d], _CHARS) for d in range(_DIM)], 1)
    return {
        "char": by_char, "region": np.stack([at_chars[:, _REGION == r].sum((0, 1)) for r in (0, 1)]),
        "conv": columns_.T @ at_conv, "conv_b": at_conv.sum(0), "dense": pooled.T @ at_dense, "dense_b": at_dense.sum(0),
        "out": dense.T @ error, "out_b": error.sum(0),
    }


def _varied(codes: np.ndarray, secret: np.ndarray, strangers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the secrets between the surroundings of candidates and half cut short; a quarter of the others in capitals."""
    codes = codes.copy()
    loud = (~secret & (rng.random(len(codes)) < 0.25))[:, None] & (_REGION == 1) & (codes >= _A_LOWER) & (codes < _A_LOWER + 26)
    codes = np.where(loud, codes - 32, codes)
    moved = np.flatnonzero(secret & (rng.random(len(codes)) < 0.5))
    if len(moved) and len(strangers):
        taken = strangers[rng.integers(0, len(strangers), len(moved))]
        codes[moved] = np.where(_REGION == 1, codes[moved], taken)
    for i in np.flatnonzero(secret & (rng.random(len(codes)) < 0.5)):
        length = int((codes[i, AROUND : AROUND + _INSIDE] > 0).sum())
        if length > SHORTEST:
            codes[i, AROUND + int(rng.integers(SHORTEST, length)) : AROUND + _INSIDE] = 0
    return codes


def _logits(net: dict[str, np.ndarray], codes: np.ndarray, size: int = 512) -> np.ndarray:
    parts = [_forward(net, codes[i : i + size])[0] for i in range(0, len(codes), size)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def shape_of(codes: np.ndarray) -> np.ndarray:
    """0 for lower-case hexadecimal values, 1 for upper-case ones, 2 for others."""
    value = codes[:, AROUND : AROUND + _INSIDE]
    empty = value == 0
    digit, upper = (value >= _ZERO) & (value < _ZERO + 10), (value >= _A_UPPER) & (value < _A_UPPER + 26)
    lower_hex = (value >= _A_LOWER) & (value < _A_LOWER + 6)
    return np.where((empty | digit | lower_hex).all(1), 0, np.where((empty | digit | upper).all(1), 1, 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _calibration(sums: Callable[[float, float], tuple[float, ...]]) -> tuple[float, float]:
    """Slope and offset of the logits by a logistic fit, drawn towards (1, 0) by the weight of one row.

    ``sums``: for a slope and an offset, over all rows, the sums of error * logit, error, weight * logit**2, weight * logit and weight.
    """
    slope, offset = 1.0, 0.0
    for _ in range(50):
        at_slope, at_offset, square, mixed, weight = sums(slope, offset)
        gradient = np.array([at_slope + slope - 1, at_offset + offset])
        step = np.linalg.solve(np.array([[square + 1, mixed], [mixed, weight + 1]]), gradient)
        slope, offset = float(slope - step[0]), float(offset - step[1])
        if np.abs(step).max() < 1e-10:
            break
    return max(slope, 1e-3), offset


def _limit(most: float, least: float) -> float:
    """The threshold between the largest calibrated logit that keeps enough secrets and the smallest that lets few enough others through."""
    return max(0.5, float(_sigmoid((most + min(max(0.0, least), most)) / 2)))


def _fresh(net: dict[str, np.ndarray]) -> dict:
    """What training goes on from: the weights, both moments of their gradients, and the steps taken."""
    return {"net": net, "first": {k: np.zeros_like(v) for k, v in net.items()}, "second": {k: np.zeros_like(v) for k, v in net.items()}, "steps": 0}


def _trained(state: dict, own: np.ndarray, labels: np.ndarray, share: float, rng: np.random.Generator, epochs: int) -> dict:
    """The state after some passes over some windows; ``share``: of secrets among all that are trained on."""
    net, first, second, steps = dict(state["net"]), dict(state["first"]), dict(state["second"]), state["steps"]
    strangers = own[~labels]
    # Both labels weigh the same, however many findings they have.
    weights = np.where(labels, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(own))
        for at in range(0, len(order), _BATCH):
            some = order[at : at + _BATCH]
            logits, kept = _forward(net, _varied(own[some], labels[some], strangers, rng))
            error = ((_sigmoid(logits) - labels[some]) * weights[some] / len(some)).astype(np.float32)
            steps += 1
            for k, g in _gradients(net, kept, error).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                fair = np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8
                net[k] = (net[k] - _RATE * first[k] / (1 - 0.9**steps) / fair).astype(np.float32)
    return {"net": net, "first": first, "second": second, "steps": steps}


def _judged(
    net: dict[str, np.ndarray], codes: np.ndarray, secret: np.ndarray, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, labels and shapes of held-out windows, with the secrets once more as training varies them."""
    bare = _varied(codes[secret], np.ones(secret.sum(), bool), codes[~secret], rng)
    codes, labels = np.concatenate([codes, bare]), np.concatenate([secret, np.ones(len(bare), bool)])
    return _logits(net, codes), labels, shape_of(codes)


def _epochs(own: int) -> int:
    """Passes of a round, of which there are ``_EPOCHS``: more over few windows."""
    return max(1, 2048 // own)


def train(windows: list[str], secret: np.ndarray, held_out: np.ndarray) -> dict[str, np.ndarray] | None:
    """The network's weights with ``scale`` (slope, offset) and ``limits`` (a threshold per shape); None for too few findings."""
    codes, secret, held_out = encoded(windows) if windows else None, np.asarray(secret, bool), np.asarray(held_out, bool)
    if min((secret & ~held_out).sum(), (~secret & ~held_out).sum(), (secret & held_out).sum()) < LEAST // 2:
        return None
    rng = np.random.default_rng(11)
    state = _fresh(_initial(rng))
    own, labels = codes[~held_out], secret[~held_out]
    net = _trained(state, own, labels, labels.mean(), rng, _EPOCHS * _epochs(len(own)))["net"]
    logits, kept_labels, shapes = _judged(net, codes[held_out], secret[held_out], rng)
    real = logits.astype(float)

    def sums(slope: float, offset: float) -> tuple[float, ...]:
        p = _sigmoid(slope * real + offset)
        error, weight = p - kept_labels, p * (1 - p)
        return (error * real).sum(), error.sum(), (weight * real**2).sum(), (weight * real).sum(), weight.sum()

    scale = np.array(_calibration(sums))
    sure = scale[0] * logits + scale[1]
    limits = []
    for shape in range(3):
        of, other = (sure[(kept_labels == label) & (shapes == shape)] for label in (True, False))
        of, other = of if len(of) >= ENOUGH else sure[kept_labels], other if len(other) >= ENOUGH else sure[~kept_labels]
        most = np.quantile(of, 1 - RECALL, method="lower")
        limits.append(_limit(most, np.quantile(other, 1 - FALSE, method="higher") if len(other) else 0.0))
    return net | {"scale": scale, "limits": np.array(limits)}


def secret_windows(model: dict[str, np.ndarray], windows: list[str]) -> np.ndarray:
    """Which windows the network takes for secrets."""
    if not windows:
        return np.zeros(0, bool)
    codes = encoded(windows)
    slope, offset = model["scale"]
    return _sigmoid(slope * _logits(model, codes) + offset) >= model["limits"][shape_of(codes)]


# -- training on many parts -------------------------------------------------------------------------------------------


_KEPT = ("net", "first", "second")


def _packed(values: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **values)
    return out.getvalue()


def _added(states: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """The sum of packed states in double precision, each as often as the number beside it says."""
    total: dict[str, np.ndarray] = {}
    for times, state in states:
        for k, v in np.load(io.BytesIO(state)).items():
            total[k] = total.get(k, 0) + times * v.astype(float)
    return total


def _arrays(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and whether it is held out, of the windows of a part in their order."""
    rows = sorted((r["window"], r["secret"], r["held_out"]) for r in rows.as_py())
    return encoded([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def _round(parts: DataFrame, state: dict, share: float, epochs: int, turn: int, groups: int) -> dict:
    """The mean of the states that the parts reach from ``state`` by passes over their windows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("windows")):
                codes, secret, held_out = _arrays(rows)
                if not held_out.all():
                    reached = _trained(state, codes[~held_out], secret[~held_out], share, np.random.default_rng([11, part, turn]), epochs)
                    flat = {f"{kind}.{k}": v for kind in _KEPT for k, v in reached[kind].items()} | {"steps": np.array(reached["steps"])}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int64()), pa.array([(~held_out).sum()], pa.int64()), pa.array([_packed(flat)], pa.binary())],
                        names=["part", "n", "state"],
                    )

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = _packed(_added(list(zip(rows["n"], rows["state"]))))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "n": [rows["n"].sum()], "state": [total]})

    schema = "part long, n long, state binary"
    rows = parts.mapInArrow(learn, schema).groupBy(F.col("part") % groups).applyInPandas(added, schema).collect()
    total, n = _added([(1, bytes(r["state"])) for r in sorted(rows, key=lambda r: r["part"])]), sum(r["n"] for r in rows)
    mean = {kind: {k: (total[f"{kind}.{k}"] / n).astype(np.float32) for k in state[kind]} for kind in _KEPT}
    return mean | {"steps": float(total["steps"]) / n}


def _place(logits: np.ndarray) -> np.ndarray:
    """Integers of 32 bits in the order of the numbers."""
    bits = np.asarray(logits, np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.int64)


def _number(place: int) -> np.float32:
    return np.uint32(place & 0x7FFFFFFF if place >> 31 else ~place & 0xFFFFFFFF).view(np.float32)


def order_statistics(judged: DataFrame, wanted: list[tuple[bool, int | None, int]]) -> list[np.float32]:
    """For each (label, shape or None for all, index): the logit at that index of all in order, by counts of lower and lower digits."""
    prefix, left, above = [0] * len(wanted), [index for _, _, index in wanted], 32
    for shift in (21, 10, 0):
        within = [
            (F.col("secret") == secret) & (F.lit(shape is None) | (F.col("shape") == (shape or 0))) & (F.shiftright("place", above) == prefix[i])
            for i, (secret, shape, _) in enumerate(wanted)
        ]
        some = judged.where(functools.reduce(operator.or_, within))
        rows = some.groupBy("secret", "shape", F.shiftright("place", shift).alias("digits")).count().collect()
        for i, (secret, shape, _) in enumerate(wanted):
            counts: Counter[int] = Counter()
            for row in rows:
                if row["secret"] == secret and shape in (None, row["shape"]) and row["digits"] >> (above - shift) == prefix[i]:
                    counts[row["digits"]] += row["count"]
            for digits, count in sorted(counts.items()):
                prefix[i] = digits
                if left[i] < count:
                    break
                left[i] -= count
        above = shift
    return [_number(p) for p in prefix]


def _sums(judged: DataFrame, slope: float, offset: float) -> tuple[float, ...]:
    """What ``_calibration`` asks for; as decimals, whose sum is the same in any order."""
    x = F.col("logit").cast("double")
    p = 1 / (1 + F.exp(-F.greatest(F.least(slope * x + offset, F.lit(60.0)), F.lit(-60.0))))
    error, weight = p - F.col("secret").cast("double"), p * (1 - p)
    terms = (error * x, error, weight * x * x, weight * x, weight)
    return tuple(float(v) for v in judged.agg(*[F.sum(t.cast("decimal(38,18)")).alias(f"s{i}") for i, t in enumerate(terms)]).first())


def _train_parts(parts: DataFrame, counts: dict[tuple[bool, bool], int], groups: int) -> dict[str, np.ndarray]:
    """What ``train`` returns, from many parts: no task has more than the windows of one at a time, and the driver has weights and counts."""
    own = counts[True, False] + counts[False, False]
    state = _fresh(_initial(np.random.default_rng(11)))
    for turn in range(_EPOCHS):
        state = _round(parts, state, counts[True, False] / own, _epochs(own), turn, groups)
    net = state["net"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("windows")):
                codes, secret, held_out = _arrays(rows)
                logits, labels, shapes = _judged(net, codes[held_out], secret[held_out], np.random.default_rng([11, part, _EPOCHS]))
                yield pa.RecordBatch.from_pydict({
                    "logit": pa.array(logits, pa.float32()), "place": pa.array(_place(logits)), "secret": pa.array(labels),
                    "shape": pa.array(shapes.astype(np.int32)),
                })

    judged = written(parts.mapInArrow(judge, "logit float, place long, secret boolean, shape int"), "logits")
    scale = np.array(_calibration(functools.partial(_sums, judged)))
    have = {(r["secret"], r["shape"]): r["count"] for r in judged.groupBy("secret", "shape").count().collect()}
    wanted = []
    for shape, label in ((shape, label) for shape in range(3) for label in (True, False)):
        shape = shape if have.get((label, shape), 0) >= ENOUGH else None
        count = sum(n for (own_label, s), n in have.items() if own_label == label and shape in (None, s))
        index = np.floor((count - 1) * (1 - RECALL)) if label else np.ceil((count - 1) * (1 - FALSE))
        wanted.append((label, shape, max(0, int(index)), count))
    found = [
        scale[0] * logit + scale[1] if count else 0.0 for logit, (*_, count) in zip(order_statistics(judged, [w[:3] for w in wanted]), wanted)
    ]
    return net | {"scale": scale, "limits": np.array([_limit(*found[2 * shape : 2 * shape + 2]) for shape in range(3)])}


def fit(found: DataFrame) -> dict[str, np.ndarray] | None:
    """The network for the findings of a corpus, trained on every distinct window."""
    each = found.select(F.explode("found").alias("f")).groupBy("f.window").agg(F.max("f.secret").alias("secret"))
    inside = F.substring("window", AROUND + 1, _INSIDE)
    drawn = written(each.select("window", "secret", (F.pmod(F.xxhash64(inside), F.lit(HELD_OUT)) == 0).alias("held_out")), "windows")
    counts = {(r["secret"], r["held_out"]): r["count"] for r in drawn.groupBy("secret", "held_out").count().collect()}
    if min(counts.get(k, 0) for k in ((True, False), (False, False), (True, True))) < LEAST // 2:
        return None
    n = -(-sum(counts.values()) // PART)
    part = F.pmod(F.xxhash64("window", F.lit("part")), F.lit(n)).alias("part")
    dealt = drawn.select(part, F.struct("window", "secret", "held_out").alias("row")).repartition(n, "part")
    parts = dealt.groupBy("part").agg(F.collect_list("row").alias("windows"))
    if n > 1:
        return _train_parts(written(parts, "parts"), counts, int(np.ceil(np.sqrt(n))))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("windows"):
                rows = sorted((r["window"], r["secret"], r["held_out"]) for r in rows.as_py())
                yield pa.RecordBatch.from_pydict({"model": pa.array([_packed(train(*(list(c) for c in zip(*rows))))], pa.binary())})

    return dict(np.load(io.BytesIO(bytes(parts.mapInArrow(learn, "model binary").first()["model"]))))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: matches by kind, a digest of them, and all spans with those the network adds, as ``kind:start:end``."""
    found = written(findings(docs, text, key), "findings")
    model = fit(found)
    names = ("n_assign", "n_access", "n_hex")
    schema = ", ".join([
        f"doc_id {found.schema['doc_id'].dataType.simpleString()}", *[f"{n} long" for n in names], "base_sha256 string", "spans string",
        "n_added long",
    ])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = (*KINDS, ADDED)
        for batch in batches:
            listed = batch.column("found")
            flat, ends = listed.flatten(), np.diff(listed.offsets.to_numpy())
            owner = np.repeat(np.arange(len(listed)), ends)
            open_ = np.flatnonzero(~flat.field("secret").to_numpy(zero_copy_only=False).astype(bool))
            extra: dict[int, list[tuple[int, int, int]]] = {}
            if model is not None and len(open_):
                picked = flat.take(pa.array(open_))
                chosen = secret_windows(model, picked.field("window").to_pylist())
                starts, stops = picked.field("start").to_numpy(), picked.field("end").to_numpy()
                for i in np.flatnonzero(chosen):
                    extra.setdefault(int(owner[open_[i]]), []).append((int(starts[i]), len(KINDS), int(stops[i])))
            rows = []
            for i, spans in enumerate(batch.column("matches").to_pylist()):
                base = [(s["start"], s["kind"], s["end"]) for s in spans]
                text_of = [",".join(f"{labels[k]}:{s}:{e}" for s, k, e in some) for some in (base, sorted(base + extra.get(i, [])))]
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(text_of[0].encode()).hexdigest(), text_of[1], len(extra.get(i, []))))
            columns_ = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns_, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names, "base_sha256", "spans", "n_added"])

    return found.mapInArrow(told, schema)
