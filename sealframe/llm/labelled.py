"""Labelled rows, all of them in passes or a bounded sample, and small models fitted on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SCAN_CHARS, bound_batches, held_out, slices, texts_of

#: A pass over all labelled rows has a task for so many rows, but no more tasks than that, each with one result for the driver.
PASS_ROWS, PASS_TASKS = 5000, 64
#: Rows of one part that a pass works on.
PART_ROWS = 500
#: Features and whether the label is 1, of some rows.
Part = tuple[np.ndarray, np.ndarray]
#: Applies a function to the parts of each task's rows, and returns what it made, in the order of tasks.
Passes = Callable[[Callable[[Iterator[Part]], Any]], list]


def known_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One label for each id that is not held out. Rows without id or label, and ids with labels that differ, are left out."""
    return (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
    )


@contextmanager
def passes(docs: DataFrame, labels: DataFrame, features: Callable[[list[str]], np.ndarray], label: str = "quality") -> Iterator[Passes]:
    """Passes over the features and labels of all labelled documents that are not held out.

    Features are made once, before labels are known, so that they and no texts are shuffled, and kept on the
    executors' disks. Of repeated documents with one id the features' smallest in order is taken.
    """
    bound_batches(docs.sparkSession)
    read = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SCAN_CHARS):
                made = [x.astype("<f8").tobytes() for x in features(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(made, pa.binary())], ["doc_id", "features"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [b"".join(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), bool).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], ["features", "good"])

    measured = read.mapInArrow(measure, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, features binary")
    one_each = measured.groupBy("doc_id").agg(F.min("features").alias("features"))
    told = one_each.join(known_labels(labels, label), "doc_id").select("features", (F.col("label") == 1).alias("good"))
    # Passes are plain jobs: a plan for each would fill the driver.
    kept = told.mapInArrow(pack, "features binary, good binary").rdd.map(tuple).persist(StorageLevel.DISK_ONLY)

    def parts(packed: Iterator[tuple[bytes, bytes]]) -> Iterator[Part]:
        for x, good in packed:
            told = np.frombuffer(good, bool)
            of = np.frombuffer(x, "<f8").reshape(len(told), -1)
            for a in range(0, len(told), PART_ROWS):
                yield of[a : a + PART_ROWS], told[a : a + PART_ROWS]

    try:
        rows = kept.map(lambda r: len(r[1])).sum()
        few = kept.coalesce(max(1, min(PASS_TASKS, rows // PASS_ROWS)))
        yield lambda work: few.mapPartitions(lambda packed: [work(parts(packed))]).collect()
    finally:
        kept.unpersist()


def sample(docs: DataFrame, labels: DataFrame, features: Callable[[list[str]], np.ndarray], rows: int, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, the first by a hash of their id.

    Only labels of rows that are not held out are read. Rows without id or label, and ids with
    labels that differ, are left out; of repeated documents with one id the features' smallest
    in order is taken, so the sample doesn't depend on the order of rows.
    """
    bound_batches(docs.sparkSession)
    known = known_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of an id and a label: small by the limit above.
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SCAN_CHARS):
                made = [x.astype("<f4").tobytes() for x in features(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(made, pa.binary())], ["doc_id", "label", "features"])

    kinds = [chosen.schema[c].dataType.simpleString() for c in ("doc_id", "label")]
    got = chosen.mapInArrow(run, f"doc_id {kinds[0]}, label {kinds[1]}, features binary").groupBy("doc_id", "label").agg(F.min("features").alias("features"))
    table = got.toArrow().sort_by("doc_id")
    packed = table.column("features").to_pylist()
    x = np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1) if packed else np.zeros((0, 0), np.float32)
    return x, np.array(table.column("label").to_pylist(), np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def descend(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero, with a rate that falls to a tenth."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w
