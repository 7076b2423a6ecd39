"""Quality scores by Bradley-Terry pairwise ranking.

Every labelled row that is not held out takes part, and every pair of a good and a bad one: the mean
logistic loss on the differences of their features, over all pairs, is brought to its least by Newton
steps and gives a linear score, so that the better one of a pair ranks higher. The threshold is the
exact quantile of these rows' scores at the share of bad ones, and scores are laid so that this
threshold reads 0.7.

Pairs need not be listed. What a pair adds hangs on the difference of two scores alone, so each row's
mass is laid on the nodes of a fine grid of scores, by weights that interpolate (within 1e-11 of listed
pairs), and nodes are paired. A Newton step is one pass over the rows; the driver gets sums.

Cases: null and empty texts are scored like any other, on features of an empty text; texts of any
length are scored whole; repeated rows give repeated results; without labelled rows of both
qualities every score is the share of good rows (0.5 where there are none); an empty table gives an
empty result; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts
from .labelled import Part, Passes, passes, sigmoid
from .textstats import DIGIT, GAP, LETTER, LOUD, PUNCTUATION, REST, SYMBOL, UPPER, Texts

PENALTY = 1e-3
THRESHOLD = 0.7
#: Grid of scores for loss and slope, and how many nodes around a score get its mass.
STEP, NODES = 1 / 16, 8
#: Grid for the curvature, which only steers the steps.
COARSE = 1 / 2
#: The fit ends when no slope is steeper, or after so many passes.
LEVEL, MOST_PASSES = 1e-10, 200
#: Bits of a score that one pass of the quantile finds.
DIGIT_BITS = 13
_AROUND = np.arange(NODES) - (NODES // 2 - 1)
_INTERPOLATE = np.linalg.inv(np.vander(_AROUND.astype(np.float64), increasing=True))


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers per text; shares, mostly, so that they don't depend on its length."""
    of = Texts(texts)
    kind = of.per_kind()
    chars, words = np.maximum(of.n_chars, 1), np.maximum(of.n_words, 1)
    letters = np.maximum(kind[:, UPPER] + kind[:, LETTER], 1)
    same, lines = of.n_dup_lines()
    shares = [kind[:, k] / chars for k in (DIGIT, SYMBOL, LOUD, PUNCTUATION, GAP, REST)] + [kind[:, UPPER] / letters, of.n_doubled_words() / words, of.n_bare_words() / words, same / np.maximum(lines, 1), of.n_repeat_words() / words]
    return np.column_stack(
        [
            *shares,
            *map(np.sqrt, shares),
            np.square(shares[-1]),
            np.log1p(of.n_words),
            np.log1p(of.word_chars / words),
            np.log1p(of.n_distinct_words()) / np.log(words + 2),
            np.log1p(of.n_chars / np.maximum(lines, 1)),
            of.n_words == 0,
        ]
    ).astype(np.float64)


class Sums:
    """Rows of numbers, added up by a whole number that each comes with."""

    def __init__(self):
        self.at, self.rows = np.zeros(0, np.int64), None

    def add(self, at: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        if self.rows is not None:
            at, rows = np.concatenate([self.at, at]), np.concatenate([self.rows, rows])
        order = np.argsort(at, kind="stable")
        self.at, first = np.unique(at[order], return_index=True)
        self.rows = np.add.reduceat(rows[order], first, axis=0)


class Moments:
    """Count, mean and squared distance from it, of rows that come in parts."""

    def __init__(self):
        self.n, self.mean, self.apart = 0, 0.0, 0.0

    def add(self, n: int, mean: np.ndarray, apart: np.ndarray) -> None:
        if n:
            off, total = mean - self.mean, self.n + n
            self.mean = self.mean + off * (n / total)
            self.apart = self.apart + apart + off * off * (self.n * n / total)
            self.n = total

    def take(self, x: np.ndarray) -> None:
        if len(x):
            mean = x.mean(0)
            self.add(len(x), mean, np.square(x - mean).sum(0))

    def spread(self) -> np.ndarray:
        return np.sqrt(self.apart / self.n)


def _pairs(good: Sums, bad: Sums) -> tuple[float, np.ndarray]:
    """The loss of all pairs, and its slope, from the two labels' masses (and masses times features) at the nodes."""
    low, high = min(good.at[0], bad.at[0]), max(good.at[-1], bad.at[-1])
    laid = []
    for of in (good, bad):
        rows = np.zeros((high - low + 1, of.rows.shape[1]))
        rows[of.at - low] = of.rows
        laid.append(rows)
    good_at, bad_at = laid
    # The score of a bad row less that of a good one.
    apart = STEP * np.arange(low - high, high - low + 1)
    pull = sigmoid(apart)
    loss = good_at[:, 0] @ np.correlate(np.logaddexp(0, apart), bad_at[:, 0], "valid")[::-1]
    slope = np.convolve(pull, good_at[:, 0], "valid") @ bad_at[:, 1:] - np.correlate(pull, bad_at[:, 0], "valid")[::-1] @ good_at[:, 1:]
    return float(loss), slope


def _curvature(good: Sums, bad: Sums) -> np.ndarray:
    """The curvature of all pairs' loss with scores rounded to the coarse grid, from products of features (and of one)."""
    size = int(np.sqrt(2 * good.rows.shape[1]))
    upper = np.triu_indices(size)
    of_good, of_bad = (np.zeros((len(x.at), size, size)) for x in (good, bad))
    for to, of in ((of_good, good), (of_bad, bad)):
        to[:, upper[0], upper[1]] = to[:, upper[1], upper[0]] = of.rows
    p = sigmoid(COARSE * (bad.at - good.at[:, None]))
    bend = p * (1 - p)
    cross = of_good[:, 0, 1:].T @ bend @ of_bad[:, 0, 1:]
    return np.tensordot(bend @ of_bad[:, 0, 0], of_good[:, 1:, 1:], 1) + np.tensordot(of_good[:, 0, 0] @ bend, of_bad[:, 1:, 1:], 1) - cross - cross.T


class Ranker:
    """Weights of a linear score, and how it is laid on 0 to 1."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self._fit(lambda work: [work(iter([(x.astype(np.float64), label == 1)] if len(label) else []))])

    @classmethod
    def over(cls, each: Passes) -> Ranker:
        """The ranker of rows that are reached in passes."""
        made = cls.__new__(cls)
        made._fit(each)
        return made

    def _fit(self, each: Passes) -> None:
        def counts(parts: Iterator[Part]) -> tuple[int, Moments]:
            n_good, found = 0, Moments()
            for x, good in parts:
                n_good += int(good.sum())
                found.take(x)
            return n_good, found

        n_good, all_rows = 0, Moments()
        for n, found in each(counts):
            n_good += n
            all_rows.add(found.n, found.mean, found.apart)
        n_bad = all_rows.n - n_good
        self.flat = (n_good / all_rows.n if all_rows.n else 0.5) if not (n_good and n_bad) else None
        if self.flat is not None:
            return
        self.mean, self.scale = all_rows.mean, all_rows.spread() + 1e-6
        self.weights = self._least(each, n_good * n_bad)
        self.threshold, self.spread = self._lay(each, all_rows.n, n_bad / all_rows.n)

    def _at(self, each: Passes, weights: np.ndarray, n_pairs: int) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss, its slope and its curvature at ``weights``."""

        def masses(parts: Iterator[Part]) -> list[tuple[Sums, Sums]]:
            made = [(Sums(), Sums()) for _ in range(2)]
            one, other = np.triu_indices(len(weights) + 1)
            for x, good in parts:
                for (fine, coarse), used in zip(made, (good, ~good), strict=True):
                    if not used.any():
                        continue
                    z = self._scaled(x[used])
                    at = (z * weights).sum(1)
                    rows = np.column_stack([np.ones(len(z)), z])
                    cell = np.floor(at / STEP)
                    share = np.vander(at / STEP - cell, NODES, increasing=True) @ _INTERPOLATE
                    fine.add((cell.astype(np.int64)[:, None] + _AROUND).ravel(), (share[:, :, None] * rows[:, None, :]).reshape(-1, rows.shape[1]))
                    coarse.add(np.rint(at / COARSE).astype(np.int64), rows[:, one] * rows[:, other])
            return made

        total = [(Sums(), Sums()) for _ in range(2)]
        for found in each(masses):
            for to, of in zip(total, found, strict=True):
                for a, b in zip(to, of, strict=True):
                    a.add(b.at, b.rows)
        loss, slope = _pairs(total[0][0], total[1][0])
        bend = _curvature(total[0][1], total[1][1])
        return loss / n_pairs + PENALTY / 2 * (weights @ weights), slope / n_pairs + PENALTY * weights, bend / n_pairs + PENALTY * np.eye(len(weights))

    def _least(self, each: Passes, n_pairs: int) -> np.ndarray:
        """Weights of the least loss, which is the only one as the penalty bends it everywhere."""
        weights = np.zeros(len(self.mean))
        loss, slope, bend = self._at(each, weights, n_pairs)
        part, level = 1.0, np.abs(slope).max()
        for _ in range(MOST_PASSES):
            move = part * np.linalg.solve(bend, slope)
            if level < LEVEL or np.abs(move).max() < 1e-12:
                break
            tried = self._at(each, weights - move, n_pairs)
            # Where losses differ by rounding only, slopes tell which is lower.
            if tried[0] < loss - 1e-9 or (tried[0] < loss + 1e-9 and np.abs(tried[1]).max() < level):
                weights, (loss, slope, bend), part = weights - move, tried, min(1.0, 2 * part)
                level = np.abs(slope).max()
            else:
                part /= 2
        return weights

    def _lay(self, each: Passes, n: int, share: float) -> tuple[float, float]:
        """The exact quantile of all rows' scores at ``share``, between two neighbours in order as numpy has it, and their spread.
        The lower neighbour is found some bits at a time."""
        place = share * (n - 1)
        below, prefix = int(np.floor(place)), 0
        rank = below
        for shift in range(64 // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS):

            def digits(parts: Iterator[Part], shift: int = shift, prefix: int = prefix) -> np.ndarray:
                found = np.zeros(1 << DIGIT_BITS, np.int64)
                for x, _ in parts:
                    key = _ordered(self._raw(x)) >> np.uint64(shift)
                    found += np.bincount((key[key >> np.uint64(DIGIT_BITS) == prefix] & np.uint64(len(found) - 1)).astype(np.int64), minlength=len(found))
                return found

            upto = np.cumsum(sum(each(digits)))
            digit = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[digit - 1]) if digit else 0
            prefix = prefix << DIGIT_BITS | digit

        def around(parts: Iterator[Part]) -> tuple[int, float, float, Moments]:
            upto, lower, upper, found = 0, -np.inf, np.inf, Moments()
            for x, _ in parts:
                at = self._raw(x)
                low = _ordered(at) <= np.uint64(prefix)
                upto += int(low.sum())
                lower, upper = max(lower, at[low].max(initial=-np.inf)), min(upper, at[~low].min(initial=np.inf))
                found.take(at)
            return upto, lower, upper, found

        upto, lower, upper, found = zip(*each(around), strict=True)
        first = max(lower)
        second = first if sum(upto) > below + 1 or below + 1 == n else min(upper)
        all_scores = Moments()
        for x in found:
            all_scores.add(x.n, x.mean, x.apart)
        return float(first + (second - first) * (place - below)), float(max(all_scores.spread(), 1e-9))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return (self._scaled(x) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        apart = self._raw(x) - self.threshold
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(apart >= 0, np.maximum(sigmoid(apart / self.spread + at), THRESHOLD), np.minimum(sigmoid(apart / self.spread + at), np.nextafter(THRESHOLD, 0)))


def _ordered(score: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the scores (with one zero)."""
    bits = (score + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    with passes(docs, labels, features) as each:
        return Ranker.over(each)


def score(docs: DataFrame, model: Ranker, text: str = "text", keep: tuple[str, ...] = ("doc_id",), made: str = "score") -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` and the score, named ``made``."""

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(model.score(features(texts)), pa.float64())]

    return map_texts(docs, text, keep, run, {made: "double"})


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
