"""Files of any size, sealed and opened in parts: no file, entry or archive is ever one value.

A part is one block of an entry with the entry's salt, or its head (``block_ix`` null), which holds all that is not a block.
An HMAC runs over a file in order: sealing reads and hashes a file in one task, and opening sorts a file's parts to one
task, both streaming. Files are sealed and opened in parallel, and an archive's blocks are read in ranges.

Parts make the same archives as ``operators.seal`` does, and read those.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, secrets
from ..operators import chunk, unseal
from ..operators.unseal import RECOVERABLE
from ..plans.metrics import Progress
from . import container, storage

#: Bytes of blocks handed on at once.
HANDED_BYTES = 4 << 20
ERROR = pa.struct([("kind", pa.string()), ("code", pa.string()), ("message", pa.string())])
_HEAD = ("frame_header", "meta_sealed", "interblock_pad", "trailer_pad", "hmac_sealed", "entry_checksum")
PARTS = "archive_id string, entry_ix bigint, entry_salt binary, block_ix bigint, sealed binary, blocks bigint, " + ", ".join(f"{c} binary" for c in _HEAD)
_PART_NAMES = [x.split()[0] for x in PARTS.split(", ")]
_PART_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * len(_HEAD)]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def seal_files(spark: SparkSession, paths: list[str], password: str, iterations: int = secrets.ITERATIONS, variance: int = secrets.VARIANCE, archive_id: str = "archive", slices: int | None = None, progress: Progress | None = None) -> DataFrame:
    """The parts of every file in ``paths`` (paths or URIs), with columns ``name``, ``size`` (of heads) and ``err``: a file that
    cannot be opened has one row, with READ_FAILED. One that breaks off while it is read fails its task, which is tried again.

    Write the result before using it (``operators.seal.kept``): it is random each time it is computed.
    """
    secrets.check_password(password)
    if not paths:
        raise ValueError("at least one path is needed")
    names = ["entry_ix", "name", "mtime", "mode", "block_ix", "plain", "size", "blocks", "entry_salt", "key", "nonces", "frame_header", "interblock_pad", "trailer_pad", "entry_checksum", "hmac", "err"]
    types = [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 5, ERROR]
    kinds = "entry_ix bigint, name string, mtime timestamp, mode int, block_ix bigint, plain binary, size bigint, blocks bigint, entry_salt binary, key binary, nonces array<binary>, frame_header binary, interblock_pad binary, trailer_pad binary, entry_checksum binary, hmac binary, err " + unseal.ERROR_TYPE

    def of_file(ix: int, path: str) -> Iterator[tuple]:
        name = os.path.basename(path.rstrip("/")) or ("/" if path else ".")
        try:
            found = storage.about(path)
            file = storage.reading(path)
        except OSError:
            yield (ix, name, *[None] * 14, {"kind": RECOVERABLE, "code": "READ_FAILED", "message": "read file"})
            return
        salt = os.urandom(codec.SALT_BYTES)
        key = secrets.derive(password, salt, iterations)
        nonce = lambda: os.urandom(codec.NONCE_BYTES)
        digest, size, number = hmac.new(key, digestmod=hashlib.sha256), 0, 0
        with file:
            while piece := file.read(max(1, chunk.BASE + secrets.random_delta(variance))):
                digest.update(piece)
                yield (ix, None, None, None, number, piece, None, None, salt, key, [nonce()], *[None] * 6)
                size, number = size + len(piece), number + 1
        pads = [os.urandom(secrets.random_length(*b)) for b in (secrets.INTERBLOCK_PADDING, secrets.TRAILER_PADDING)]
        yield (ix, name, found.mtime, found.mode, None, None, size, number, salt, key, [nonce() for _ in range(3)], os.urandom(secrets.FRAME_HEADER_BYTES), *pads, os.urandom(codec.CHECKSUM_BYTES), digest.digest(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ix, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for row in of_file(ix, path):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if progress is not None:
                        whole = row[4] is None
                        progress.seen(int(whole and row[-1] is None), len(row[5] or b""), int(whole and row[-1] is not None))
                    if held > HANDED_BYTES:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    listed = spark.createDataFrame(list(enumerate(paths)), "entry_ix bigint, path string")
    listed = listed.repartition(slices or min(len(paths), 4 * spark.sparkContext.defaultParallelism), "entry_ix")
    drawn = listed.mapInArrow(run, kinds)
    key, nonce = F.col("key"), lambda i: F.get("nonces", F.lit(i))
    sealed_name = codec.seal_bytes(F.encode("name", "UTF-8"), key, nonce(0))
    mtime = F.coalesce("mtime", F.timestamp_seconds(F.lit(0)))
    metadata = codec.pack_metadata(sealed_name, codec.size_bucket(F.col("size")), codec.timestamp_hash(F.col("entry_salt"), mtime), F.col("mode"))
    head = F.col("block_ix").isNull() & F.col("err").isNull()
    return drawn.select(
        F.lit(archive_id).alias("archive_id"),
        "entry_ix",
        "entry_salt",
        "block_ix",
        F.when(F.col("block_ix").isNotNull(), codec.seal_bytes(F.col("plain"), key, nonce(0))).alias("sealed"),
        "blocks",
        "frame_header",
        F.when(head, codec.seal_bytes(metadata, key, nonce(1))).alias("meta_sealed"),
        "interblock_pad",
        "trailer_pad",
        F.when(head, codec.seal_bytes(F.col("hmac"), key, nonce(2))).alias("hmac_sealed"),
        "entry_checksum",
        "name",
        "size",
        "err",
    )


def parts(entries: DataFrame) -> DataFrame:
    """The parts of ``entries`` as ``operators.seal`` makes them."""
    empty = {"block_ix": "bigint", "sealed": "binary", "blocks": "bigint"} | dict.fromkeys(_HEAD, "binary")
    given = lambda **some: [some.get(c, F.lit(None).cast(k)).alias(c) for c, k in empty.items()]
    heads = entries.select("archive_id", "entry_ix", "entry_salt", *given(blocks=F.when(F.col("blocks").isNotNull(), F.size("blocks")).cast("bigint"), **{c: F.col(c) for c in _HEAD}))
    blocks = entries.select("archive_id", "entry_ix", "entry_salt", F.posexplode("blocks").alias("at", "block"))
    return heads.unionByName(blocks.select("archive_id", "entry_ix", "entry_salt", *given(block_ix=F.col("at").cast("bigint"), sealed=F.col("block"))))


def heads(made: DataFrame) -> DataFrame:
    """The heads among parts: one row an entry, without its blocks, to be counted or listed."""
    found = made.where("block_ix is null")
    return found.where("err is null") if "err" in made.columns else found


def write_archives(made: DataFrame, archives: DataFrame, path: str) -> None:
    """Write the archives of the parts ``made`` to the folder ``path``, an archive by one task, part after part. Both tables must be materialised."""
    begin = F.concat(codec.binary(bytes([codec.ENTRY_FILE])), F.col("entry_salt"), F.col("frame_header"), codec.framed(F.col("meta_sealed")), codec.prefixed(F.col("interblock_pad")))
    end = F.concat(codec.binary(bytes(codec.SENTINEL_BYTES)), codec.prefixed(F.col("trailer_pad")), codec.framed(F.col("hmac_sealed")), F.col("entry_checksum"))
    ends = F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("order"), begin.alias("body")), F.struct(F.lit((1 << 63) - 1).alias("order"), end.alias("body"))))
    whole = heads(made).select("archive_id", "entry_ix", ends.alias("of")).select("archive_id", "entry_ix", "of.order", "of.body")
    blocks = made.where("block_ix is not null").select("archive_id", "entry_ix", F.col("block_ix").alias("order"), codec.framed(F.col("sealed")).alias("body"))
    container.write_rows(whole.unionByName(blocks), archives, path)


def _indexed(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    """Heads (``first`` null), and ranges of blocks: the path, first and last byte, and the first block's number. One task an archive."""
    if len(paths) == 1:
        container.read_header(paths[0])

    def places(name: str) -> Iterator[tuple]:
        container.read_header(name)
        whose, at, ix, past = container.archive_id(name), codec.HEADER_BYTES, 0, storage.size(name) - container.FOOTER_BYTES
        with storage.reading(name) as file:
            while at < past:
                file.seek(at)
                if file.read(1) != bytes([codec.ENTRY_FILE]):
                    return
                cursor = container.Cursor(file, at + 1, past)
                fields, ranges = _head(cursor, split_bytes)
                for number, first, last in ranges:
                    yield (name, first, last, whose, ix, fields[0], number, *[None] * 8)
                yield (name, None, None, whose, ix, fields[0], None, None, fields[4], fields[1], fields[2], fields[3], *fields[5:8])
                if fields[7] is None:
                    return
                at, ix = cursor.at, ix + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for row in places(name):
                    rows.append(row)
                    if len(rows) == 500:
                        yield _batch(rows, names, types)
                        rows = []
                if rows:
                    yield _batch(rows, names, types)

    names, types = ["path", "first", "past", *_PART_NAMES], [pa.string(), pa.int64(), pa.int64(), *_PART_TYPES]
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), container.MOST_TASKS)), "path")
    return listed.mapInArrow(index, f"path string, first bigint, past bigint, {PARTS}")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """The heads of the entries of an archive, or of all archives in a folder: blocks are passed over."""
    return _indexed(spark, container.paths_of(path), container.SPLIT_BYTES).where("first is null").select(*_PART_NAMES)


def read_parts(spark: SparkSession, path: str, split_bytes: int = container.SPLIT_BYTES) -> DataFrame:
    """The parts of the entries of an archive, or of all archives in a folder. One task an archive reads the heads and tells where
    blocks are; other tasks read ranges of them. Of an entry that is cut off ``blocks`` is null, and what it lacks."""
    paths = container.paths_of(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, past, whose, ix, salt, number, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first is None:
                    yield _batch([(whose, ix, salt, number, *rest)], _PART_NAMES, _PART_TYPES)
                    continue
                rows, held = [], 0
                with storage.reading(name) as file:
                    cursor = container.Cursor(file, first, past)
                    while cursor.at < past:
                        rows.append((whose, ix, salt, number, cursor.framed(), *[None] * 7))
                        number, held = number + 1, held + len(rows[-1][4])
                        if held > HANDED_BYTES:
                            yield _batch(rows, _PART_NAMES, _PART_TYPES)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, _PART_NAMES, _PART_TYPES)

    tasks = 1 + min(container.MOST_TASKS, 2 * sum(map(storage.size, paths)) // max(split_bytes, container.LEAST_SPLIT))
    return _indexed(spark, paths, split_bytes).repartition(tasks, "path", "entry_ix", "first").mapInArrow(read, PARTS)


def _head(cursor: container.Cursor, split_bytes: int) -> tuple[list, list[tuple[int, int, int]]]:
    """An entry's fields as ``container.read_entry`` gives them, but the number of its blocks instead of them; and ranges of whole
    blocks: the first one's number, begin, end."""
    fields: list = [None] * 8
    ranges: list[tuple[int, int, int]] = []
    try:
        fields[0] = cursor.take(codec.SALT_BYTES)
        fields[1] = cursor.take(container.FRAME_HEADER_BYTES)
        fields[2] = cursor.framed()
        fields[3] = cursor.counted()
        cursor.skim = True
        count = start = 0
        begin = cursor.at
        while True:
            at = cursor.at
            cursor.take(codec.NONCE_BYTES)
            size = struct.unpack("<I", cursor.take(4))[0]
            if size:
                cursor.take(size, keep=False)
                count += 1
            if count > start and (not size or cursor.at - begin >= split_bytes):
                past = cursor.at if size else at
                ranges.append((start, begin, past))
                start, begin = count, past
            if not size:
                break
        cursor.skim = False
        fields[4] = count
        fields[5] = cursor.counted()
        fields[6] = cursor.framed()
        fields[7] = cursor.take(codec.CHECKSUM_BYTES)
    except EOFError:
        pass
    return fields, ranges


def open_parts(made: DataFrame, password: str, iterations: int = secrets.ITERATIONS, folder: str | None = None, progress: Progress | None = None) -> DataFrame:
    """Open every entry of the parts ``made`` and, if ``folder`` is given, write it there under the last component of its name.

    Per entry archive_id, entry_ix, filename, size, mode, sha256 (of the content), ok and err, with the outcomes of
    ``operators.unseal.unseal`` and WRITE_FAILED. A file takes its name only when all of it has opened and its HMAC fits. Rows are
    written as they are computed: act on the returned rows once.
    """
    # Sorted while they are sealed: neither plaintext nor keys are shuffled.
    rows = made.select(*_PART_NAMES).withColumn("block_ix", F.coalesce("block_ix", F.lit(-1).cast("bigint")))
    rows = rows.repartition("archive_id", "entry_ix").sortWithinPartitions("archive_id", "entry_ix", "block_ix")
    key = F.col("secret.key")
    opened = unseal.named(unseal.keyed(rows, password, iterations)).withColumn("hmac", codec.open_bytes(F.col("hmac_sealed"), key))
    early = unseal.error_chain().when(F.col("blocks").isNull(), unseal.error("TRUNCATED", "read block ciphertext"))
    late = F.when(F.col("hmac_sealed").isNull(), unseal.error("TRUNCATED", "read HMAC sealed")).when(F.col("hmac").isNull(), unseal.error("AUTH_FAILED", "decrypt HMAC"))
    late = late.when(F.octet_length("hmac") != codec.DIGEST_BYTES, unseal.error("INTEGRITY_FAIL", "HMAC length mismatch"))
    head = F.col("block_ix") == -1
    rows = opened.select("archive_id", "entry_ix", "block_ix", "filename", F.col("meta.mode").alias("mode"), "hmac", F.when(head, key).alias("key"), F.when(head, early).alias("early"), F.when(head, late).alias("late"), codec.open_bytes(F.col("sealed"), key).alias("plain"))
    names = ["archive_id", "entry_ix", "filename", "size", "mode", "sha256", "ok", "err"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), ERROR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = None

        def result(of: _Opening) -> tuple:
            row = of.result()
            if progress is not None:
                progress.seen(int(row[6]), row[3] or 0, int(not row[6]))
            return row

        for batch in batches:
            done = []
            plains = (x.as_buffer() if x.is_valid else None for x in batch.column(9))  # not copied
            for whose, ix, number, filename, mode, expected, own, early, late, plain in zip(*(c.to_pylist() for c in batch.columns[:9]), plains, strict=True):
                if number == -1:
                    if entry is not None:
                        done.append(result(entry))
                    entry = _Opening(whose, ix, filename, mode, expected, own, early, late, folder)
                elif entry is not None and entry.whose == (whose, ix):
                    entry.add(plain)
            yield _batch(done, names, types)
        if entry is not None:
            yield _batch([result(entry)], names, types)

    return rows.mapInArrow(run, "archive_id string, entry_ix bigint, filename string, size bigint, mode bigint, sha256 string, ok boolean, err " + unseal.ERROR_TYPE)


class _Opening:
    """One entry while its blocks come by."""

    def __init__(self, archive: str, ix: int, filename: str | None, mode: int | None, expected: bytes | None, key: bytes | None, early: dict | None, late: dict | None, folder: str | None):
        self.whose, self.filename, self.mode, self.expected, self.late = (archive, ix), filename, mode, expected, late
        self.err, self.size, self.content = early, 0, hashlib.sha256()
        self.digest = hmac.new(key or b"", digestmod=hashlib.sha256)
        self.file = self.made = self.target = None
        if folder is not None and early is None:
            name = os.path.basename(filename.rstrip("/")) or "."
            self.target, self.made = storage.join(folder, name), storage.join(folder, f".{uuid.uuid4().hex}.part")
            try:
                storage.make_folder(folder)
                if name in (".", "..") or storage.is_folder(self.target):
                    raise IsADirectoryError(self.target)
                self.file = storage.writing(self.made)
            except OSError:
                self.fail("WRITE_FAILED", "write file")

    def fail(self, code: str, message: str) -> None:
        self.err = self.err or {"kind": RECOVERABLE, "code": code, "message": message}

    def add(self, plain: pa.Buffer | None) -> None:
        if self.err is not None:
            return
        if plain is None:
            return self.fail("AUTH_FAILED", "decrypt block")
        self.digest.update(plain)
        self.content.update(plain)
        self.size += plain.size
        if self.file is not None:
            try:
                self.file.write(plain)
            except OSError:
                self.fail("WRITE_FAILED", "write file")

    def result(self) -> tuple:
        self.err = self.err or self.late
        if self.err is None and not hmac.compare_digest(self.digest.digest(), self.expected):
            self.fail("INTEGRITY_FAIL", "plaintext HMAC mismatch")
        if self.file is not None:
            try:
                self.file.close()
                if self.err is None:
                    storage.move(self.made, self.target)
                    storage.set_mode(self.target, self.mode)
                else:
                    storage.remove(self.made)
            except OSError:
                self.fail("WRITE_FAILED", "write file")
        ok = self.err is None
        return (*self.whose, self.filename, self.size if ok else None, self.mode if ok else None, self.content.hexdigest() if ok else None, ok, self.err)
