"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokens come from ``pretokenize``; each distinct pre-token is merged once per cache life
(those new to the cache all at once, by ``merging``); a text's ids are those of its pre-tokens,
gathered from the cache. Decoding gathers each id's bytes from the vocabulary by their offsets.

Cases: a null text counts as empty and encodes to no ids; a text of any length is encoded
whole (long pre-tokens are merged with a heap, in n log n steps); repeated rows give repeated
results; a row with a null id keeps it; an empty table gives an empty result; only the two named
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_texts
from .merging import PairTable, merge_all, ragged
from .pretokenize import Pieces

#: Pre-tokens kept in a worker's cache before it starts anew.
CACHE_PIECES = 300_000
#: Longer pre-tokens are merged with a heap.
LONG_PIECE = 256


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list."""
    n = len(piece)
    ends = list(range(1, n + 1))
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heap.append((rank, i, ends[j])) if not ready else heapq.heappush(heap, (rank, i, ends[j]))

    ready = False
    for i in range(n - 1):
        push(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class Codec:
    """The ranks of a vocabulary, and a cache of merged pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        found = [(a, b, rank) for whole, rank in self.ranks.items() for i in range(1, len(whole)) if (a := self.ranks.get(whole[:i])) is not None and (b := self.ranks.get(whole[i:])) is not None]
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank.astype(np.int32), rank.astype(np.int32))
        tokens = sorted((rank, token) for token, rank in self.ranks.items())
        self.token_size = np.zeros(tokens[-1][0] + 1, np.int64)
        self.token_size[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def merge(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens end to end, and their numbers: vocabulary entries as they are,
        very long pre-tokens one by one, all others together."""
        known = [[r] if (r := self.ranks.get(p)) is not None else merge_long(p, self.ranks) if len(p) > LONG_PIECE else None for p in new]
        rest = [p for p, k in zip(new, known, strict=True) if k is None]
        sizes = np.array([0 if k is None else len(k) for k in known], np.int64)
        open_ = np.array([k is None for k in known], bool)
        lone = np.array([i for k in known if k is not None for i in k], np.int32)
        if not rest:
            return lone, sizes
        symbols = self.single[np.frombuffer(b"".join(rest), np.uint8)]
        merged, sizes[open_] = merge_all(symbols, np.fromiter(map(len, rest), np.int64, len(rest)), self.pairs)
        both = np.concatenate([merged, lone])
        start = np.empty(len(new), np.int64)
        start[open_] = np.cumsum(sizes[open_]) - sizes[open_]
        start[~open_] = len(merged) + np.cumsum(sizes[~open_]) - sizes[~open_]
        return ragged(both, start, sizes), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one more at the end)."""
        found = Pieces(texts)
        if len(self.slot) > CACHE_PIECES:
            self._forget()
        if new := [p for p in found.distinct if p not in self.slot]:
            ids, sizes = self.merge(new)
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, sizes])
        slots = np.fromiter(map(self.slot.__getitem__, found.distinct), np.int64, len(found.distinct))[found.which]
        sizes = self.size[slots]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[found.first]
        return ragged(self.ids, (np.cumsum(self.size) - self.size)[slots], sizes), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of the tokens between consecutive bounds."""
        sizes = self.token_size[ids]
        flat = ragged(self.token_bytes, self.token_start[ids], sizes).tobytes()
        return _cut(flat, np.concatenate([[0], np.cumsum(sizes)])[bounds])

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Byte offset of every token's start in its decoded text, as little-endian unsigned 32-bit integers."""
        sizes = self.token_size[ids]
        start = np.cumsum(sizes) - sizes
        base = np.concatenate([start, [sizes.sum()]])[bounds[:-1]]
        return _cut((start - np.repeat(base, np.diff(bounds))).astype("<u4").tobytes(), 4 * bounds)


def _cut(flat: bytes, bounds: np.ndarray) -> list[bytes]:
    return [flat[a:b] for a, b in pairwise(bounds.tolist())]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, offsets: bool = False) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit integers)
    and, where asked for, ``decoded`` (the bytes that the ids stand for, decoded in the same pass) and
    ``offsets`` (binary, the byte offset of each token's start in the decoded text)."""

    def run(texts: list[str]) -> list[pa.Array]:
        coder = codec(ranks_path)
        ids, bounds = coder.encode(texts)
        made = [_cut(ids.astype("<u4").tobytes(), 4 * bounds), *[coder.decode(ids, bounds)] * decoded, *[coder.offsets(ids, bounds)] * offsets]
        return [pa.array(np.diff(bounds), pa.int64()), *(pa.array(x, pa.binary()) for x in made)]

    names = ["ids", *["decoded"] * decoded, *["offsets"] * offsets]
    return map_texts(docs, text, keep, run, {"n_tokens": "bigint"} | dict.fromkeys(names, "binary"))


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: its key and ``decoded``, the bytes that its ids stand for (null ids: empty)."""
    bound_batches(coded.sparkSession)
    kind = coded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path)
        for batch in batches:
            packed = [x or b"" for x in batch.column(1).to_pylist()]
            bounds = np.cumsum([0, *(len(x) // 4 for x in packed)])
            decoded = coder.decode(np.frombuffer(b"".join(packed), "<u4"), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["key", "decoded"])

    out = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded binary")
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return the digests of both."""
    coded = encode(docs, ranks_path, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
