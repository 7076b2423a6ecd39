"""Byte-pair merging of many pre-tokens at once, on ragged numpy arrays.

All pre-tokens of a batch lie end to end in one array of symbols. In each round every sequence
merges its pair of lowest rank (the leftmost one), all sequences at the same time; sequences
without a pair to merge leave the arrays, so the work shrinks with what is left.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
#: Multiplier of the pair table's hash.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing table from a pair of symbols to the rank of their merge and the symbol made."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        at = self._home(keys)
        left_over = np.arange(len(keys))
        while len(left_over):
            place = at[left_over]
            free = self.keys[place] < 0
            chosen, which = np.unique(place[free], return_index=True)
            taken = left_over[free][which]
            self.keys[chosen], self.rank[chosen], self.made[chosen] = keys[taken], rank[taken], made[taken]
            left_over = np.setdiff1d(left_over, taken, assume_unique=True)
            at[left_over] = (at[left_over] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; -1 for pairs that don't merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, at, -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable, together: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Merge the sequences that lie end to end in ``symbols`` (none of them empty).

    ``together`` merges all occurrences of a sequence's lowest pair in one round; that equals
    one at a time where every merge ranks after the merges that make its two parts.
    Returns the merged sequences, in order and end to end, and their lengths.
    """
    count = len(lengths)
    final = np.zeros(count, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who = np.arange(count)
    sym = symbols.astype(np.int32)
    size = lengths.astype(np.int64)
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = pairs.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(size)[:-1] - 1] = NONE
    while len(who):
        begin = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, begin)
        over = low == NONE
        if over.any():
            gone = np.repeat(over, size)
            final[who[over]] = size[over]
            done.append((who[over], size[over], sym[gone]))
            stay = ~gone
            sym, rank, who, size, low = sym[stay], rank[stay], who[~over], size[~over], low[~over]
            if not len(who):
                break
            begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(who)), size)
        at = np.flatnonzero(rank == low[owner])
        if together:
            run = np.ones(len(at), bool)
            run[1:] = at[1:] != at[:-1] + 1
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
        else:
            mine = owner[at]
            lead = np.ones(len(at), bool)
            lead[1:] = mine[1:] != mine[:-1]
            at = at[lead]
        sym[at] = pairs.made[pairs.find(sym[at], sym[at + 1])]
        rank[at] = rank[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))
        size = size - np.bincount(owner[at], minlength=len(who))
        sym, rank = sym[keep], rank[keep]
        last = np.cumsum(size) - 1
        ends = np.zeros(len(sym), bool)
        ends[last] = True
        left = now[~ends[now]]
        rank[left] = pairs.ranks(sym[left], sym[left + 1])
        rank[now[ends[now]]] = NONE
        back = now[now > 0] - 1
        back = back[~ends[back]]
        rank[back] = pairs.ranks(sym[back], sym[back + 1])
    out = np.empty(int(final.sum()), np.int32)
    begin = np.cumsum(final) - final
    for whose, sizes, symbols_ in done:
        inner = np.arange(len(symbols_)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(begin[whose], sizes) + inner] = symbols_
    return out, final


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from each start with each size, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]
