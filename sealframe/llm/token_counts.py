"""Token counts of whole texts under a byte-level BPE vocabulary, without building the tokens.

The pre-tokens of a batch are held as ragged arrays of symbols; in every round each sequence
merges its pair of lowest rank, all sequences at once (``merging``); what survives is counted.
Each distinct pre-token is merged once per life of a bounded cache of counts.

Cases: a null or empty text has 0 bytes and 0 tokens; special strings of the vocabulary inside a
text count as one token each, as the library's default has it; texts of any length are counted
whole; repeated rows give repeated results; rows with a null id keep it; an empty table gives an
empty result; only the two named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .merging import PairTable, merge_all
from .pretokenize import Pieces

CACHE_PIECES = 300_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: visible Latin-1
    characters for themselves, the others in order from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.single = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.special = [x["content"] for x in spec["added_tokens"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made_at = {a + b: i for i, (a, b) in reversed([*enumerate(merges)])}
        self.together = all(max(made_at.get(a, -1), made_at.get(b, -1)) < i for i, (a, b) in enumerate(merges))
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int32), made.astype(np.int32))
        self.known: dict[bytes, int] = {}

    def split(self, text: str) -> list[str]:
        """The stretches between special strings."""
        parts = [text]
        for mark in self.special:
            parts = [x for p in parts for x in p.split(mark)]
        return parts

    def count(self, texts: list[str]) -> list[int]:
        marked = any(mark in text for mark in self.special for text in texts)
        parts = [self.split(t) for t in texts] if marked else [[t] for t in texts]
        found = Pieces([p for ps in parts for p in ps])
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        if new := [p for p in found.distinct if p not in self.known]:
            symbols = self.single[np.frombuffer(b"".join(new), np.uint8)]
            sizes = merge_all(symbols, np.fromiter(map(len, new), np.int64, len(new)), self.pairs, self.together)[1]
            self.known.update(zip(new, sizes.tolist(), strict=True))
        sizes = np.fromiter(map(self.known.__getitem__, found.distinct), np.int64, len(found.distinct))[found.which]
        ends = np.concatenate([[0], np.cumsum(sizes)])[found.first]
        bounds = np.cumsum([0, *map(len, parts)])
        return (ends[bounds[1:]] - ends[bounds[:-1]] + np.diff(bounds) - 1).tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``n_bytes`` (UTF-8) and ``n_tokens``."""

    def run(texts: list[str]) -> list[pa.Array]:
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        return [pa.array(sizes, pa.int64()), pa.array(counter(vocabulary_path).count(texts), pa.int64())]

    return map_texts(docs, text, keep, run, {"n_bytes": "bigint", "n_tokens": "bigint"})
