"""Files in and out, by path or URI, on storage that driver and executors share (``storage``).

The built-in binary source leaves out empty files and names that begin with '.' or '_', and fails on a missing
path; here each path gives a row, with an error where it cannot be read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.unseal import RECOVERABLE
from . import storage

FILES = "archive_id string, entry_ix bigint, name string, content binary, mtime timestamp, mode int, err struct<kind: string, code: string, message: string>"
_MADE = ["archive_id", "entry_ix", "name", "content", "mtime", "mode", "err"]


def read_files(spark: SparkSession, paths: list[str], archive_id: str = "archive", slices: int | None = None) -> DataFrame:
    """One row per path, in order: name (the last component), content, mtime, mode; or ``err`` READ_FAILED."""
    if not paths:
        raise ValueError("at least one path is needed")
    listed = spark.createDataFrame(list(enumerate(paths)), "entry_ix bigint, path string")
    listed = listed.repartition(slices or min(len(paths), 4 * spark.sparkContext.defaultParallelism), "entry_ix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ix, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content, when, mode, err = None, None, None, None
                try:
                    found = storage.about(path)
                    with storage.reading(path) as file:
                        content = file.read()
                    when, mode = found.mtime, found.mode
                except OSError:
                    err = {"kind": RECOVERABLE, "code": "READ_FAILED", "message": "read file"}
                name = os.path.basename(path.rstrip("/")) or ("/" if path else ".")
                columns = [pa.array([archive_id]), pa.array([ix], pa.int64()), pa.array([name]), pa.array([content], pa.binary()), pa.array([when], pa.timestamp("us", "UTC")), pa.array([mode], pa.int32())]
                columns.append(pa.array([err], pa.struct([("kind", pa.string()), ("code", pa.string()), ("message", pa.string())])))
                yield pa.RecordBatch.from_arrays(columns, _MADE)

    return listed.mapInArrow(run, FILES)


def readable(files: DataFrame) -> DataFrame:
    """The files that could be read."""
    return files.where("err is null").drop("err")


def unreadable(files: DataFrame) -> DataFrame:
    return files.where("err is not null").select("archive_id", "entry_ix", "name", "err")


def write_files(results: DataFrame, folder: str) -> DataFrame:
    """Write every opened entry to ``folder`` under the last component of its name, with its permissions.

    Returns the results without content; entries that cannot be written become WRITE_FAILED. Equal names
    overwrite each other, as ``operators.unseal.collisions`` tells beforehand. Rows are written as they
    are computed: act on the returned rows once.
    """
    schema = results.select("archive_id", "entry_ix", "filename", "size", "ok", "err").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                content, mode = row.pop("content"), row.pop("mode")
                if not row["ok"]:
                    continue
                target = storage.join(folder, os.path.basename(row["filename"].rstrip("/")) or ".")
                try:
                    storage.make_folder(folder)
                    with storage.writing(target) as file:
                        file.write(content)
                    storage.set_mode(target, mode)
                except OSError:
                    row |= {"ok": False, "size": None, "err": {"kind": RECOVERABLE, "code": "WRITE_FAILED", "message": "write file"}}
            names = [f.name for f in schema]
            types = [batch.schema.field(n).type for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return results.select("archive_id", "entry_ix", "filename", "size", "ok", "err", "content", "mode").mapInArrow(run, schema)


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Path and content of each readable file."""
    listed = spark.createDataFrame(list(enumerate(paths)), "entry_ix bigint, path string")
    return readable(read_files(spark, paths)).join(listed, "entry_ix").select("path", F.col("content"))
