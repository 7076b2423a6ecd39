"""Counters that are filled while a query runs, and the report made from them."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import codec


def counted(results: DataFrame, name: str = "progress", size: str = "size", ok: Column | None = None) -> tuple[DataFrame, Observation]:
    """``results`` unchanged, and an observation of bytes, files and errors that its first action fills."""
    seen = Observation(name)
    good = F.col("ok") if ok is None else ok
    watched = results.observe(seen, F.coalesce(F.sum(F.when(good, F.col(size))), F.lit(0)).alias("bytes_processed"), F.count_if(good).alias("files_processed"), F.count_if(~good).alias("files_errored"))
    return watched, seen


class Progress:
    """Files, bytes and errors so far, told to ``tell`` while jobs run (every ``every`` seconds, if they changed) and at the end.

    Tasks count with ``seen``, and a task's counts arrive when it ends; one that is run again may count twice, so these
    figures are for watching only. Use as a context manager around the action.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[int, int, int], None], every: float = 1.0):
        context = spark.sparkContext
        self.counts = [context.accumulator(0) for _ in range(3)]
        self.tell, self.every, self.told, self.ended = tell, every, None, threading.Event()
        self.watch = threading.Thread(target=self._watch, daemon=True)

    def __getstate__(self) -> dict:
        return {"counts": self.counts}  # all that tasks need

    def seen(self, files: int, size: int, errors: int = 0) -> None:
        for count, more in zip(self.counts, (files, size, errors), strict=True):
            count.add(more)

    def now(self) -> tuple[int, int, int]:
        files, size, errors = (c.value for c in self.counts)
        return files, size, errors

    def _tell(self) -> None:
        if (found := self.now()) != self.told:
            self.told = found
            self.tell(*found)

    def _watch(self) -> None:
        while not self.ended.wait(self.every):
            self._tell()

    def __enter__(self) -> Progress:
        self.watch.start()
        return self

    def __exit__(self, *problem: object) -> None:
        self.ended.set()
        self.watch.join()
        self._tell()


def totals(files: DataFrame, *by: str) -> DataFrame:
    """Files and bytes."""
    size = F.octet_length("content")
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def report(files: int, size: int, seconds: float) -> str:
    """The closing line of a run."""
    unit = next((u for u in codec.BYTE_UNITS if size >= u[0]), None)
    told = f"{size / unit[0]:.2f} {unit[1]}" if unit else f"{size} B"
    rate = size / seconds / (1 << 20) if seconds > 0 else 0.0
    return f"done: {files} file(s), {told} in {seconds:.2f}s ({rate:.0f} MB/s)"
