"""Pre-tokenisation of text batches by transition-function scans, without regular expressions.

The tokenizers' pattern takes contractions, letter runs, number runs and runs of other
characters (each with at most one leading space) and runs of white space, where the last white
space before a visible character stands apart. Every character becomes one of a few symbols
(its class, plus what a bounded lookahead adds); a small automaton over these symbols says where
a match begins. A symbol is a function from state to state, these functions compose
associatively, and all compositions that can occur form a small closed table. So the states of
a whole batch come from a scan over numpy arrays: compose within rows of a matrix, scan the row
totals by doubling, then replay each row from its known first state.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)

#: The code points with the Unicode property White_Space, other than the space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers (first, last) that Unicode 16 added; the tokenizer libraries know them.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: What may follow an apostrophe in a contraction.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

# Symbols; FIRST is added for the first character of a text.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_LAST_SPACE, S_LAST_WHITE = range(8)
FIRST = SYMBOLS = 8
# States: what the match under way is.
FRESH, LETTERS, NUMBERS, OTHERS, WHITES, LEAD, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
ROW = 512
#: The first code points that take two, three and four bytes in UTF-8.
WIDER = (0x80, 0x800, 0x10000)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
HELD = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Multiplier of the hash that sorts matches.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[WHITE_SPACE] = WHITE
    table[32] = SPACE
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a match begins at this character."""
    if symbol >= FIRST:
        return step(FRESH, symbol - FIRST)[0], True
    if state == ONE_LEFT:
        return FRESH, False
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if symbol == S_WHITE:
        return WHITES, state != WHITES
    if symbol == S_LAST_SPACE:
        return LEAD, True
    if symbol == S_LAST_WHITE:
        return FRESH, True
    if symbol in (S_SHORT, S_LONG) and state not in (OTHERS, LEAD):
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    run = {S_LETTER: LETTERS, S_NUMBER: NUMBERS}.get(symbol, OTHERS)
    return run, state not in (run, LEAD)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next, begins, extend, product, image) over states, symbols and composed functions."""
    ways = [[step(s, x) for x in range(2 * SYMBOLS)] for s in range(STATES)]
    follow = np.array([[w[0] for w in row] for row in ways], np.uint8)
    begins = np.array([[w[1] for w in row] for row in ways], bool)
    symbols = [tuple(int(follow[s, x]) for s in range(STATES)) for x in range(2 * SYMBOLS)]
    known = {tuple(range(STATES)): 0}
    todo = list(known)
    for f in todo:
        for g in symbols:
            if (made := tuple(g[s] for s in f)) not in known:
                known[made] = len(known)
                todo.append(made)
    extend = np.array([[known[tuple(g[s] for s in f)] for g in symbols] for f in todo], np.uint16)
    product = np.array([[known[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    image = np.array([f[FRESH] for f in todo], np.uint8)
    return follow, begins, extend, product, image


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One symbol per character; ``starts`` are the offsets of the texts, ascending."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    ends = first[1:].copy()
    ends[-1] = True
    visible = kind < SPACE
    before_visible = np.zeros(n, bool)
    before_visible[:-1] = visible[1:]
    before_visible &= ~ends
    out = kind.copy()
    white = ~visible
    out[white] = S_WHITE
    last = white & before_visible
    out[last & (kind == SPACE)] = S_LAST_SPACE
    out[last & (kind == WHITE)] = S_LAST_WHITE
    marks = np.flatnonzero(points == 39)
    if len(marks):
        limit = starts[np.searchsorted(starts, marks, "right").clip(max=len(starts) - 1)]
        limit = np.where(limit > marks, limit, n)
        padded = np.append(points, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(x) for x in SHORT_ENDINGS]) & (marks + 1 < limit)
        long = np.zeros(len(marks), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        long &= marks + 2 < limit
        out[marks[short]] = S_SHORT
        out[marks[long]] = S_LONG
    out[first[:n]] += FIRST
    return out


def match_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets at which matches begin, for texts laid end to end from the offsets ``starts``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    follow, begins, extend, product, image = tables()
    rows = -(-n // ROW)
    padded = np.full(rows * ROW, S_OTHER, np.uint8)
    padded[:n] = _symbols(points, starts)
    columns = np.ascontiguousarray(padded.reshape(rows, ROW).T)
    flat = extend.ravel()
    total = np.zeros(rows, np.uint16)
    for symbol in columns:
        total = flat[total * np.uint16(2 * SYMBOLS) + symbol]
    shift = 1
    while shift < rows:
        total[shift:] = product[total[:-shift], total[shift:]]
        shift *= 2
    state = np.empty(rows, np.uint8)
    state[0] = FRESH
    state[1:] = image[total[:-1]]
    marked = np.empty((ROW, rows), bool)
    flat_follow, flat_begins = follow.ravel(), begins.ravel()
    for symbol, out in zip(columns, marked, strict=True):
        at = state * np.uint8(2 * SYMBOLS) + symbol
        out[:] = flat_begins[at]
        state = flat_follow[at]
    return np.flatnonzero(marked.T.ravel()[:n])


class Pieces:
    """The matches of a batch of texts: each distinct one once, and which one stands where.

    ``distinct`` are byte strings (UTF-8); ``which`` has for every match, in order, its index in
    ``distinct``; ``first`` has for every text the index of its first match, and one more at the end.
    """

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = match_starts(points, np.unique(offsets[:-1][lengths > 0]))
        raw = joined.encode("utf-8", "surrogatepass")
        self.first = np.searchsorted(begins, offsets)
        at = begins
        if len(raw) > len(points):
            width = np.ones(len(points), np.int8)
            for bound in WIDER:
                width += points >= bound
            at = (np.cumsum(width, dtype=np.int64) - width)[begins]
        size = np.diff(at, append=len(raw))
        lead, self.which = self._distinct(raw, at, size)
        self.distinct = [raw[a : a + n] for a, n in zip(at[lead].tolist(), size[lead].tolist(), strict=True)]

    @staticmethod
    def _distinct(raw: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of one match for each distinct one, and for every match the place of its own in these.

        Matches of up to 16 bytes are told apart by these bytes as two integers (sorted by a hash
        of them, then compared in full); longer ones in a dictionary.
        """
        count = len(at)
        words = np.ndarray(len(raw) + 8, "<u8", raw + bytes(16), strides=(1,))
        low = words[at] & HELD[size.clip(max=8)]
        high = words[(at + 8).clip(max=len(raw))] & HELD[(size - 8).clip(0, 8)]
        mixed = (low ^ (high * SPREAD + size.astype(np.uint64))) * SPREAD
        mixed ^= mixed >> np.uint64(29)
        long = np.flatnonzero(size > 16)
        if len(long):
            seen: dict[bytes, int] = {}
            low[long] = [seen.setdefault(raw[a : a + n], i) for i, (a, n) in enumerate(zip(at[long].tolist(), size[long].tolist(), strict=True))]
            high[long] = 0
            mixed[long] = low[long] * SPREAD + np.uint64(1)
        order = np.argsort(mixed, kind="stable")
        new = np.ones(count, bool)
        if count:
            a, b = order[1:], order[:-1]
            new[1:] = (mixed[a] != mixed[b]) | (low[a] != low[b]) | (high[a] != high[b]) | (np.minimum(size[a], 17) != np.minimum(size[b], 17))
        which = np.empty(count, np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The matches of all texts in order, and for each text the index of its first one (one more at the end)."""
    found = Pieces(texts)
    return [found.distinct[i] for i in found.which.tolist()], found.first
