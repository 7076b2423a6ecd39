"""Quality rules: counted rules first, then a calibrated logistic regression on hashed n-grams.

Words, pairs of words, and runs of one to three characters are hashed into a fixed number of
buckets, each family's shares standing side by side; how often a text repeats its own three-word
windows fills buckets as well. The regression is fitted on a bounded sample of labelled rows, its
probabilities are calibrated on a part of the sample kept apart, and every text is scored whole, in
Arrow batches, against a fixed threshold.

Cases: a null text counts as empty and has no words, so it fails the base rules; texts of any length
are read whole; repeated rows give repeated results; without labelled rows of both qualities the
probability is the share of good rows (1 where there are none), so the base rules decide; an empty
table gives an empty result; only the named columns are read, so other columns may have any names, but a kept column
that is named like one made here is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .labelled import descend, sample, sigmoid
from .textstats import Texts

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 4000
#: Buckets of each family of n-grams (a power of two).
BUCKETS = 1024
CHAR_ORDERS = (1, 2, 3)
FAMILIES = 2 + len(CHAR_ORDERS)
#: Shares of words in repeated windows that have a bucket each.
STEPS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Share of the sample that calibrates.
APART = 0.25
PENALTY = 0.3
#: Added to the spread of every bucket, so that rare ones weigh little.
FLOOR = 0.01
#: Probability of label 1 that a kept text reaches.
KEEP = 0.5
#: Base rules: words at least, and percent of words in repeated windows at most.
MIN_WORDS = 50
MAX_REPEAT = 50
_SPREAD = np.uint32(0x9E3779B1)


def _bucket(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint32(15))) * _SPREAD
    return (mixed >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def grams(of: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: buckets of its n-grams in order, and each text's first and last (exclusive) n-gram."""
    word = of.word_hashes()
    first, last = of.first_word[:-1], of.first_word[1:]
    yield _bucket(word), first, last
    yield _bucket(word[:-1] * np.uint32(31) + word[1:]), first, np.maximum(first, last - 1)
    mixed = np.zeros(len(of.points), np.uint32)
    for order in CHAR_ORDERS:
        mixed = (mixed[: len(of.points) - order + 1] * np.uint32(0x01000193)) ^ of.points[order - 1 :] if len(of.points) >= order else mixed[:0]
        yield _bucket(mixed), of.char_at[:-1], np.maximum(of.char_at[:-1], of.char_at[1:] - order + 1)


def steps(of: Texts, repeated: np.ndarray) -> np.ndarray:
    """Buckets of repetition: which steps the share of words in repeated windows reaches."""
    return ((repeated / np.maximum(of.n_words, 1))[:, None] >= np.array(STEPS)).astype(np.float64)


def features(texts: list[str]) -> np.ndarray:
    of = Texts(texts)
    out = np.zeros((of.count, FAMILIES * BUCKETS + len(STEPS)))
    for family, (bucket, first, last) in enumerate(grams(of)):
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            if b > a:
                out[i, family * BUCKETS : (family + 1) * BUCKETS] = np.bincount(bucket[a:b], minlength=BUCKETS) / (b - a)
    out[:, FAMILIES * BUCKETS :] = steps(of, of.n_repeat_words())
    return out


class Regression:
    """Weights over the buckets, and the calibration of what they sum to."""

    def __init__(self, x: np.ndarray, label: np.ndarray, seed: int = 7):
        good = label == 1
        self.flat = (float(good.mean()) if len(label) else 1.0) if not len(label) or good.all() or not good.any() else None
        if self.flat is not None:
            return
        part = np.random.default_rng(seed).permutation(len(label))
        aside, used = np.split(part, [int(APART * len(part))])
        if len({*good[aside]}) < 2 or len({*good[used]}) < 2:
            aside = used = part
        y = np.where(good, 1.0, -1.0)
        mean, scale = x[used].mean(0, dtype=np.float64), x[used].std(0, dtype=np.float64) + FLOOR
        z = (x[used] - mean.astype(np.float32)) / scale.astype(np.float32)
        # Both labels weigh the same.
        weigh = np.where(good[used], 0.5 / good[used].sum(), 0.5 / (~good[used]).sum())

        def gradient(w: np.ndarray) -> np.ndarray:
            pull = -y[used] * weigh * sigmoid(-y[used] * (z @ w[:-1].astype(np.float32) + w[-1]))
            return np.append(pull.astype(np.float32) @ z + PENALTY * w[:-1], pull.sum())

        w = descend(gradient, x.shape[1] + 1, 200, 0.01)
        self.weights = w[:-1] / scale
        self.bias = float(w[-1] - self.weights @ mean)
        self.slope, self.shift = self._calibrate(x[aside] @ self.weights + self.bias, good[aside])

    @staticmethod
    def _calibrate(raw: np.ndarray, good: np.ndarray) -> tuple[float, float]:
        """Platt's sigmoid, with its smoothed targets, by Newton steps."""
        n = good.sum()
        target = np.where(good, (n + 1) / (n + 2), 1 / (len(good) - n + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = sigmoid(a * raw + b)
            off, heat = p - target, p * (1 - p) + 1e-9
            g = np.array([off @ raw, off.sum()])
            h = np.array([[heat @ (raw * raw) + 1e-6, heat @ raw], [heat @ raw, heat.sum() + 1e-6]])
            move = np.linalg.solve(h, g)
            move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
            a, b = max(a - move[0], 1e-3), b - move[1]
        return float(a), float(b)

    def probability(self, of: Texts, repeated: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(of.count, self.flat)
        raw = self.bias + (steps(of, repeated) * self.weights[FAMILIES * BUCKETS :]).sum(1)
        for family, (bucket, first, last) in enumerate(grams(of)):
            worth = self.weights[family * BUCKETS : (family + 1) * BUCKETS][bucket]
            some = np.flatnonzero(last > first)
            if len(some):
                bounds = np.column_stack([first[some], last[some]]).ravel()
                total = np.add.reduceat(np.append(worth, 0.0), bounds)[::2]
                raw[some] += total / (last - first)[some]
        return sigmoid(self.slope * raw + self.shift)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Regression:
    return Regression(*sample(docs, labels, features, rows))


def apply_rules(docs: DataFrame, model: Regression, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = KEEP) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, the counts, ``base_failed``, ``kept`` and ``probability``."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if clash := {*counts, "base_failed", "kept", "probability"} & {k.lower() for k in keep}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")

    def run(texts: list[str]) -> list[pa.Array]:
        of = Texts(texts)
        repeated = of.n_repeat_words()
        made = [of.n_words, of.word_chars, of.n_symbols(), of.n_dup_lines()[0], repeated]
        return [*(pa.array(x, pa.int64()) for x in made), pa.array(model.probability(of, repeated), pa.float64())]

    out = map_texts(docs, text, keep, run, dict.fromkeys(counts, "bigint") | {"probability": "double"})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select(*(F.col(f"`{k}`") for k in keep), *counts, failed.alias("base_failed"), (~failed & (F.col("probability") >= least)).alias("kept"), "probability")
