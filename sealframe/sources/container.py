"""The single-file container: a data source that reads and writes archives of sealed entries.

Reading: all lengths are in the clear, so a task walks each file by seeking and tells where its entries are; other tasks
read ranges of them, so a large archive is read by many. The driver only lists files. Every length is checked against the file's size
before anything is read.
Writing: an archive's digest runs over its bytes in order, so an archive is written by one task, streaming;
archives are written in parallel. A file takes its name only when the job commits.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import codec
from ..operators import chunk
from ..operators.unseal import ERROR_TYPE, FATAL
from . import storage

NAME = "sealed"
SUFFIX = ".sealed"
ENTRIES = (
    "archive_id string, entry_ix bigint, entry_salt binary, frame_header binary, meta_sealed binary, interblock_pad binary, "
    "blocks array<binary>, trailer_pad binary, hmac_sealed binary, entry_checksum binary"
)
FOOTER_BYTES = codec.DIGEST_BYTES + codec.RESERVED_BYTES
FRAME_HEADER_BYTES = 32
#: Bytes of entries that one read partition takes, about.
SPLIT_BYTES = 64 << 20
#: Bytes that a read partition has at least, bytes of entries handed on at once, and tasks at most.
LEAST_SPLIT = 1 << 18
READ_BYTES = 4 << 20
MOST_TASKS = 10_000


class ArchiveError(Exception):
    """An archive that cannot be read at all."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


class Cursor:
    """Fields of a file up to a limit; with ``skim``, bytes are passed over instead of read."""

    def __init__(self, file, at: int, limit: int, skim: bool = False):
        self.file, self.at, self.limit, self.skim = file, at, limit, skim

    def take(self, count: int, keep: bool = True) -> bytes:
        if count > self.limit - self.at:
            raise EOFError
        self.at += count
        if self.skim and not keep:
            return b""
        self.file.seek(self.at - count)
        return self.file.read(count)

    def counted(self) -> bytes:
        return self.take(struct.unpack("<I", self.take(4))[0], keep=False)

    def framed(self) -> bytes:
        return self.take(codec.NONCE_BYTES) + self.counted()


def read_entry(cursor: Cursor) -> tuple[list, bool]:
    """The fields of the entry behind its type byte, in the order of ``ENTRIES``; and whether it is complete."""
    fields: list = [None] * 8
    try:
        fields[0] = cursor.take(codec.SALT_BYTES)
        fields[1] = cursor.take(FRAME_HEADER_BYTES)
        fields[2] = cursor.framed()
        fields[3] = cursor.counted()
        blocks = []
        while True:
            nonce = cursor.take(codec.NONCE_BYTES)
            size = struct.unpack("<I", cursor.take(4))[0]
            if size == 0:
                break
            blocks.append(nonce + cursor.take(size, keep=False))
        fields[4] = blocks
        fields[5] = cursor.counted()
        fields[6] = cursor.framed()
        fields[7] = cursor.take(codec.CHECKSUM_BYTES)
    except EOFError:
        return fields, False
    return fields, True


def read_header(path: str) -> tuple[bytes, bytes]:
    """The archive's salt and sealed file count; raises for what is no archive."""
    with storage.reading(path) as file:
        raw = file.read(codec.HEADER_BYTES)
    if len(raw) < len(codec.MAGIC):
        raise ArchiveError("TRUNCATED", "read magic")
    if not raw.startswith(codec.MAGIC):
        raise ArchiveError("BAD_MAGIC", "invalid magic bytes")
    if len(raw) < 6:
        raise ArchiveError("TRUNCATED", "read version")
    if (version := struct.unpack_from("<H", raw, 4)[0]) != codec.VERSION:
        raise ArchiveError("BAD_VERSION", f"unsupported version {version}")
    if len(raw) < codec.HEADER_BYTES:
        raise ArchiveError("TRUNCATED", "read header")
    return raw[6:38], raw[38:74]


def walk(path: str) -> list[tuple[int, int]]:
    """Start and end of every entry. The footer is told by the file's size; the walk ends at an entry
    that is cut off (which counts), or at an unknown type."""
    read_header(path)
    end = storage.size(path) - FOOTER_BYTES
    found, at = [], codec.HEADER_BYTES
    with storage.reading(path) as file:
        while at < end:
            file.seek(at)
            if file.read(1) != bytes([codec.ENTRY_FILE]):
                break
            cursor = Cursor(file, at + 1, end, skim=True)
            _, complete = read_entry(cursor)
            found.append((at, cursor.at if complete else end))
            if not complete:
                break
            at = cursor.at
    return found


@dataclass
class Whole(InputPartition):
    path: str


def paths_of(path: str) -> list[str]:
    return [storage.join(path, n) for n in storage.names(path) if n.endswith(SUFFIX) and not n.startswith(".")] if storage.is_folder(path) else [path]


def archive_id(path: str) -> str:
    return os.path.basename(path).removesuffix(SUFFIX)


class Reader(DataSourceReader):
    """One task an archive; ``read_archives`` splits archives."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[Whole]:
        return [Whole(p) for p in paths_of(self.path)] or [Whole("")]

    def read(self, partition: Whole) -> Iterator[tuple]:
        if not partition.path:
            return
        with storage.reading(partition.path) as file:
            for ix, (begin, end) in enumerate(walk(partition.path)):
                yield (archive_id(partition.path), ix, *read_entry(Cursor(file, begin + 1, end))[0])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Rows (archive_id, body), an archive's rows together and in order."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        storage.make_folder(self.path)
        files: list[tuple[str, str]] = []
        current, file, digest = None, None, None

        def close() -> None:
            if file is not None:
                file.write(digest.digest() + bytes(codec.RESERVED_BYTES))
                file.close()

        for batch in iterator:
            # Bodies are written from Arrow's memory, not copied.
            for whose, body in zip(batch.column(0).to_pylist(), (x.as_buffer() for x in batch.column(1)), strict=True):
                if whose != current:
                    close()
                    if body.slice(0, len(codec.MAGIC)).to_pybytes() != codec.MAGIC:
                        raise ValueError(f"entries of {whose}, which is not among the archives")
                    current = whose
                    target = storage.join(self.path, f"{current}{SUFFIX}")
                    files.append((storage.join(self.path, f".{current}-{self.job}-{uuid.uuid4().hex}"), target))
                    file, digest = storage.writing(files[-1][0]), hashlib.sha256()
                file.write(body)
                digest.update(body)
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for made, target in (x for m in messages if m for x in m.files):
            storage.move(made, target)

    def abort(self, messages: list[Written | None]) -> None:
        for left in storage.names(self.path) if storage.is_folder(self.path) else ():
            if left.startswith(".") and f"-{self.job}-" in left:
                storage.remove(storage.join(self.path, left))


class SealedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), MOST_TASKS)), "path")


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The entries of an archive file, or of all archives in a folder. What is no archive fails the job that reads it, a single file at once."""
    paths = paths_of(path)
    if len(paths) == 1:
        read_header(paths[0])
    # One row an entry: where it stands.
    places = pa.schema([("path", pa.string()), ("entry_ix", pa.int64()), ("first", pa.int64()), ("past", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                found = walk(file)
                columns = [[file] * len(found), range(len(found)), [x for x, _ in found], [x for _, x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, places.types, strict=True)], schema=places)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.binary()), *[pa.binary()] * 3]
        for batch in batches:
            rows, size = [], 0
            for name, ix, begin, past in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                with storage.reading(name) as file:
                    rows.append((archive_id(name), ix, *read_entry(Cursor(file, begin + 1, past))[0]))
                size += past - begin
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in ENTRIES.split(", ")]
    parts = 1 + min(MOST_TASKS, 2 * sum(map(storage.size, paths)) // max(split_bytes, LEAST_SPLIT))
    indexed = _listed(spark, paths).mapInArrow(index, "path string, entry_ix bigint, first bigint, past bigint")
    dealt = indexed.repartition(parts, "path", F.expr(f"first div {split_bytes}"))
    return dealt.mapInArrow(read, ENTRIES)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per archive file its id, and ``err`` if it cannot be read as an archive at all."""

    @F.udf(ERROR_TYPE)
    def failed(file):
        try:
            read_header(file)
        except ArchiveError as problem:
            return FATAL, problem.code, str(problem).partition("] ")[2]

    return _listed(spark, paths_of(path)).select(_id_of("path"), failed("path").alias("err"))


def _id_of(path: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.sealed$", "").alias("archive_id")


def entry_body(entries: DataFrame) -> DataFrame:
    """Every entry as the bytes that stand for it in a container."""
    blocks = chunk.joined(F.transform("blocks", codec.framed))
    body = F.concat(
        codec.binary(bytes([codec.ENTRY_FILE])),
        F.col("entry_salt"),
        F.col("frame_header"),
        codec.framed(F.col("meta_sealed")),
        codec.prefixed(F.col("interblock_pad")),
        blocks,
        codec.binary(bytes(codec.SENTINEL_BYTES)),
        codec.prefixed(F.col("trailer_pad")),
        codec.framed(F.col("hmac_sealed")),
        F.col("entry_checksum"),
    )
    return entries.select("archive_id", "entry_ix", body.alias("body"))


def archive_head() -> Column:
    """The bytes an archive begins with, from the columns of ``operators.seal.archives``."""
    return F.concat(codec.binary(codec.MAGIC), codec.le(F.col("version"), 2), F.col("archive_salt"), F.col("file_count_sealed"), codec.binary(bytes(codec.RESERVED_BYTES)))


def write_rows(rows: DataFrame, archives: DataFrame, path: str) -> None:
    """Write rows (archive_id, entry_ix, order, body) to files in the folder ``path``, one for each of ``archives``, in order."""
    rows.sparkSession.dataSource.register(SealedSource)
    none = F.lit(None).cast("bigint")  # comes first
    whole = archives.select("archive_id", none.alias("entry_ix"), none.alias("order"), archive_head().alias("body")).unionByName(rows)
    ordered = whole.select("archive_id", "entry_ix", "order", "body").repartition("archive_id").sortWithinPartitions("archive_id", "entry_ix", "order")
    ordered.select("archive_id", "body").write.format(NAME).mode("append").save(path)


def write_archives(entries: DataFrame, archives: DataFrame, path: str) -> None:
    """Write every archive to a file of its own in the folder ``path``. Both tables must be materialised."""
    bodies = entry_body(entries).select("archive_id", "entry_ix", F.lit(0).cast("bigint").alias("order"), "body")
    write_rows(bodies, archives, path)


def digest_fits(path: str, piece: int = 1 << 20) -> bool:
    """Whether a container's digest fits its bytes; read in pieces, so files of any size will do."""
    left = storage.size(path) - FOOTER_BYTES
    digest = hashlib.sha256()
    with storage.reading(path) as file:
        while left > 0:
            part = file.read(min(piece, left))
            if not part:
                return False
            digest.update(part)
            left -= len(part)
        return file.read(codec.DIGEST_BYTES) == digest.digest()


def verify_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per archive file: its id and whether its digest fits (null if it is too small to have one). One task per file."""
    paths = paths_of(path)

    @F.udf("boolean")
    def fits(file):
        return digest_fits(file) if storage.size(file) >= FOOTER_BYTES else None

    return _listed(spark, paths).select(_id_of("path"), fits("path").alias("digest_ok"))
