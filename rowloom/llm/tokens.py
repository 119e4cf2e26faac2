"""Token ids by a public byte-level tokenizer file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts with such long words are left to ``tokenizers``, whose time grows in proportion to them.
_LONG = re.compile(r"\S{2000}")


class Encoder:
    """Encodes whole texts as ``tokenizers`` does.

    Where the file is a byte-level BPE whose merges are in the order of their ids, ``tiktoken`` applies the same merges
    and gives the same ids several times faster; texts with the strings of special tokens, and files of
    another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described.get("added_tokens", ())]
        self.fast = _same_merges(described, self.special)

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast is None or any(s in text for s in self.special) or _LONG.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str) -> np.ndarray:
        return np.array(self.ids(text), dtype="<u4")


# Fixed value: the pattern that byte-level tokenizers of this kind cut texts with.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _same_merges(described: dict, special: list[str]):
    """A ``tiktoken`` encoding with the merges of a tokenizer file, or None if the file is of another kind."""
    import tiktoken

    model, before = described["model"], described.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        and before.get("use_regex", True) and not described.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )
    if not plain:
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in special}
    ids = [vocabulary[m] for m in merged]
    if len(vocabulary) != 256 + len(merged) or ids != sorted(ids) or min(ids) != 256:
        return None
    # Byte-level files write each byte as one visible character: printable ones as themselves, the others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: files are loaded once for all tasks that follow each other in it."""
    import sys
    import types

    state = sys.modules.setdefault("_rowloom_worker", types.ModuleType("_rowloom_worker"))
    encoders = state.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def token_count(text: Column, path: str) -> Column:
    """The number of ids of each text, 0 for null."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(path)
        for part in parts:
            yield part.map(lambda t: len(encoder.ids(t)) if t else 0, na_action=None).astype("int64")

    return count(text)
