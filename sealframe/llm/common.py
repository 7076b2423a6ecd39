"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, also where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written rows.

    The folder is the cluster's ``spark.checkpoint.dir``; one of our own is set only in a
    local session that has none.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sealframe-checkpoints-"))
    return df.checkpoint(eager=True)


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` with about ``most`` characters each, one text at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels no model may learn from: crc32 of the id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Characters of text that a worker works on at once (one text at least).
SCAN_CHARS = 1 << 20


def map_texts(rows: DataFrame, text: str, keep: Sequence[str], made_of: Callable[[list[str]], list[pa.Array]], made: dict[str, str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and the columns ``made`` (names and types) that ``made_of`` returns for a
    list of texts. Inside, all columns have names of their own, so theirs may be any."""
    bound_batches(rows.sparkSession)
    inner = [f"kept_{i}" for i in range(len(keep))]
    fresh = [f"made_{i}" for i in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts, SCAN_CHARS):
                columns = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, *made_of(texts[a:b])], [*inner, *fresh])

    read = rows.select(F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{k}`").alias(n) for k, n in zip(keep, inner, strict=True)))
    kinds = [read.schema[n].dataType for n in inner]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(inner, kinds, strict=True)] + [T.StructField(n, T.DataType.fromDDL(k)) for n, k in zip(fresh, made.values(), strict=True)])
    out = read.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(k) for n, k in zip([*inner, *fresh], [*keep, *made], strict=True)))


#: Keys with one of so many parts of all rows, or more, are joined by broadcast.
COMMON_PART = 2000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``counted`` on ``key``, which ``counted`` has once each, with its number of ``rows``.

    Keys that have at least one of COMMON_PART parts of all rows number COMMON_PART at most, so they are
    broadcast whatever the size of the data; the rows of all other keys are shuffled. No task gets
    the rows of a common key.
    """
    total = counted.agg(F.sum(count).alias("_total"))
    often = counted.join(F.broadcast(total), F.col(count) * COMMON_PART >= F.col("_total")).drop("_total")
    marked = rows.join(F.broadcast(often.withColumn("_common", F.lit(True))), key, "left")
    found = marked.where("_common").drop("_common")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(counted, key)
    return found.unionByName(rest.select(found.columns))
