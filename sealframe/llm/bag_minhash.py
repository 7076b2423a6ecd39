"""BagMinHash signatures of multisets of word shingles, for whole batches of texts.

A shingle that stands w times in a text weighs w. Its weight range is cut into the intervals
(0, 1], (1, 2], (2, 4], (4, 8] ... ; each interval carries a Poisson process whose rate is its width, and
every point has a time, a slot of the signature and a level within its interval, all drawn from
the shingle's hash. A text sees the points whose level its weight reaches, and each slot keeps the
earliest. Two texts agree in a slot with probability sum(min) / sum(max) of their weights, whatever their
sizes. Points are drawn in time order up to a horizon at which all slots are likely filled, so a
signature takes some m * log(m) points however long the text; where a slot stays empty the horizon moves on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from .textstats import Texts

WORDS = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=200_000)
def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(of: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of every distinct shingle, ordered by text and hash.

    A text of one to four words has one shingle, all its words; a text without words has none.
    """
    word = np.fromiter(map(_word_hash, of.words), np.uint64, len(of.words))[of.word]
    first, count = of.first_word[:-1], of.n_words
    n = len(word)
    at = np.arange(max(0, n - WORDS + 1))
    starts = at[of.word_text[at] == of.word_text[at + WORDS - 1]] if len(at) else at
    hashed = np.full(len(starts), WORDS, np.uint64)
    for i in range(WORDS):
        hashed = mix(hashed * _GOLDEN + word[starts + i])
    text = of.word_text[starts]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        made = count[short].astype(np.uint64)
        for i in range(WORDS - 1):
            some = count[short] > i
            made[some] = mix(made[some] * _GOLDEN + word[first[short[some]] + i])
        text, hashed = np.concatenate([text, short]), np.concatenate([hashed, made])
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    lead = np.flatnonzero(new)
    return text[lead], hashed[lead], np.diff(lead, append=len(text))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """One row of ``slots`` 32-bit values per text; texts without elements get zeros."""
    out = np.zeros((texts, slots), np.uint32)
    total = np.bincount(text, weight, texts)
    todo = total > 0
    reach = np.log(slots) + 2
    while todo.any():
        chosen = todo[text]
        filled = _draw(text[chosen], element[chosen], weight[chosen], reach / np.maximum(total, 1), slots, out)
        todo &= ~filled
        reach += 6
    return out


def _draw(text: np.ndarray, element: np.ndarray, weight: np.ndarray, horizon: np.ndarray, slots: int, out: np.ndarray) -> np.ndarray:
    """Write the signatures that the points up to each text's horizon give; which texts have all slots filled."""
    flat = out.reshape(-1)
    first = np.full(len(flat), np.inf)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top = np.ceil(np.log2(weight)).astype(np.int64)
    for step in range(int(top.max(initial=0)) + 1):
        some = np.flatnonzero(top >= step)
        low = 0 if step == 0 else 1 << (step - 1)
        width = max(low, 1)
        seed = mix(element[some] + np.uint64(int(_GOLDEN) * (step + 1) & (1 << 64) - 1))
        limit, base = horizon[text[some]], text[some] * slots
        # Streams that still run, the time each has come to, and how much weight they reach.
        live, time = np.arange(len(some)), np.zeros(len(some))
        turn = 0
        while len(live):
            turn += 1
            draw = mix(seed[live] + np.uint64(int(_GOLDEN) * turn & (1 << 64) - 1))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * slots)
            alive = time <= limit[live]
            live, time, draw = live[alive], time[alive], draw[alive]
            point = mix(draw ^ _B)
            place = base[live] + ((point >> np.uint64(40)) * np.uint64(slots) >> np.uint64(24)).astype(np.int64)
            when, value = time, (point * _A >> np.uint64(32)).astype(np.uint32)
            if step:
                level = low + 1 + ((point & np.uint64(0xFFFFF)).astype(np.int64) * width >> 20)
                keep = level <= weight[some[live]]
                place, when, value = place[keep], when[keep], value[keep]
            np.minimum.at(first, place, when)
            seen.append((place, when, value))
    for place, when, value in seen:
        best = first[place] == when
        flat[place[best]] = value[best] | np.uint32(1)
    return np.isfinite(first.reshape(out.shape)).all(1)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as ascending hashes and their weights."""
    total = int(a[1].sum() + b[1].sum())
    both = np.concatenate([a[0], b[0]])
    weights = np.concatenate([a[1], b[1]])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], weights[order]
    same = np.flatnonzero(both[1:] == both[:-1])
    shared = int(np.minimum(weights[same], weights[same + 1]).sum())
    return shared / (total - shared) if total > shared else 0.0
