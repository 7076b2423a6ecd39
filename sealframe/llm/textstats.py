"""Statistics of batches of texts on numpy arrays: characters, words, repeated word windows and lines."""

from __future__ import annotations

import sys
import unicodedata
import zlib
from functools import cache

import numpy as np

from .pretokenize import Pieces

#: The characters between words, and those counted as symbols.
BETWEEN_WORDS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LETTER, DIGIT, SYMBOL, LOUD, PUNCTUATION, GAP, REST = range(8)
WINDOW = 3
_SYMBOL_BYTES = frozenset(SYMBOLS.encode())


@cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    by_category = {"Lu": UPPER, "Lt": UPPER, "Ll": LETTER, "Lo": LETTER, "Lm": LETTER, "Mn": LETTER, "Mc": LETTER, "Nd": DIGIT, "Po": PUNCTUATION, "Pd": PUNCTUATION, "Zs": GAP}
    table = np.fromiter((by_category.get(unicodedata.category(chr(c)), REST) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for chars, kind in ((SYMBOLS, SYMBOL), ("!?", LOUD), (BETWEEN_WORDS, GAP)):
        table[[ord(c) for c in chars]] = kind
    return table


class Texts:
    """Arrays over the texts of a batch laid end to end."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.count = len(texts)
        joined = "".join(texts)
        self.n_chars = np.fromiter(map(len, texts), np.int64, self.count)
        self.char_at = np.concatenate([[0], np.cumsum(self.n_chars)])
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        # A line break after every text keeps words of neighbours apart.
        raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
        octets = np.frombuffer(raw, np.uint8)
        inside = (octets != 32) & ((octets < 9) | (octets > 13))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.word_at, ends = edge[::2], edge[1::2]
        self.word_size = ends - self.word_at
        lead = (octets & 0xC0) != 0x80
        points_before = np.cumsum(lead) - lead
        text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, self.count))
        word_point = points_before[self.word_at]
        self.word_text = np.searchsorted(text_end, word_point, "right")
        self.n_words = np.bincount(self.word_text, minlength=self.count)
        self.first_word = np.concatenate([[0], np.cumsum(self.n_words)])
        self.word_chars = np.bincount(self.word_text, points_before[ends] - word_point, self.count).astype(np.int64)
        first, self.word = Pieces._distinct(raw, self.word_at, self.word_size)
        self.words = [raw[a : a + n] for a, n in zip(self.word_at[first].tolist(), self.word_size[first].tolist(), strict=True)]

    def per_kind(self) -> np.ndarray:
        """Characters of each kind, by text."""
        kind = kinds()[self.points]
        out = np.empty((self.count, 8), np.int64)
        for k in range(8):
            total = np.concatenate([[0], np.cumsum(kind == k)])
            out[:, k] = total[self.char_at[1:]] - total[self.char_at[:-1]]
        return out

    def n_symbols(self) -> np.ndarray:
        return np.fromiter((sum(map(t.count, SYMBOLS)) for t in self.texts), np.int64, self.count)

    def n_distinct_words(self) -> np.ndarray:
        return np.bincount(np.unique(self.word_text.astype(np.int64) << 32 | self.word) >> 32, minlength=self.count)

    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of three words that occur twice or more in their text, first occurrences included."""
        n = len(self.word)
        starts = np.arange(max(0, n - WINDOW + 1))
        starts = starts[self.word_text[starts] == self.word_text[starts + WINDOW - 1]]
        wide = self.word.astype(np.int64)
        base = np.int64(len(self.words) + 1)
        if base >= 1 << 21:  # three ids don't fit one integer: number the pairs first
            pair = np.unique(wide[:-1] * base + wide[1:], return_inverse=True)[1]
            key = pair[starts] * base + wide[starts + 2]
        else:
            key = (wide[starts] * base + wide[starts + 1]) * base + wide[starts + 2]
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        same = (key[a] == key[b]) & (self.word_text[starts[a]] == self.word_text[starts[b]])
        covered = np.zeros(n + 1, bool)
        for found in (starts[a[same]], starts[b[same]]):
            for i in range(WINDOW):
                covered[found + i] = True
        return np.bincount(self.word_text[covered[:n]], minlength=self.count)

    def n_doubled_words(self) -> np.ndarray:
        """Words equal to the word before them."""
        same = (self.word[1:] == self.word[:-1]) & (self.word_text[1:] == self.word_text[:-1])
        return np.bincount(self.word_text[1:][same], minlength=self.count)

    def n_bare_words(self) -> np.ndarray:
        """Words that end in a symbol."""
        bare = np.fromiter((w[-1] in _SYMBOL_BYTES for w in self.words), bool, len(self.words))
        return np.bincount(self.word_text[bare[self.word]], minlength=self.count)

    def n_dup_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that have a word: those equal to an earlier line, and all."""
        same, whole = np.zeros(self.count, np.int64), np.zeros(self.count, np.int64)
        for i, text in enumerate(self.texts):
            lines = [x for x in text.split("\n") if x.strip(BETWEEN_WORDS)]
            whole[i] = len(lines)
            same[i] = len(lines) - len(set(lines))
        return same, whole

    def word_hashes(self) -> np.ndarray:
        """A 32-bit hash of every word."""
        return np.fromiter(map(zlib.crc32, self.words), np.uint32, len(self.words))[self.word]
