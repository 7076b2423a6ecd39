"""Sealing: files in, one row per entry out, by narrow transformations only.

A sealed entry holds its blocks as an array, in order: opening needs no join or shuffle, and a query
that does not name the column (listing, say) does not read it from storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, secrets
from . import chunk

#: Bytes of a row group of what is kept: a reader holds up to a group's rows at once, and rows are large.
GROUP_BYTES = 16 << 20
FILE_COLUMNS = ("archive_id", "entry_ix", "name", "content", "mtime", "mode")


def as_files(df: DataFrame, name: str | Column, content: str | Column, mtime: Column | None = None, mode: int | Column = 0o644, archive: Column | None = None, entry: Column | None = None) -> DataFrame:
    """A file table from any rows: what is not given gets a default."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        (F.lit("archive") if archive is None else archive).alias("archive_id"),
        (F.monotonically_increasing_id() if entry is None else entry).cast("bigint").alias("entry_ix"),
        col(name).alias("name"),
        col(content).cast("binary").alias("content"),
        (F.timestamp_seconds(F.lit(0)) if mtime is None else mtime).alias("mtime"),
        (F.lit(mode) if isinstance(mode, int) else mode).cast("int").alias("mode"),
    )


def seal(files: DataFrame, password: str, iterations: int = secrets.ITERATIONS, variance: int = secrets.VARIANCE, spread: int | None = None, seed: int | None = None) -> DataFrame:
    """Seal every file: AES-256-GCM under a key of its own, in blocks of varying length, with an HMAC over the
    whole content. Write the result (``kept``) before using it more than once: it is random each time it is computed.

    ``spread`` deals the files over so many partitions before keys are derived (a small table is one
    partition, and deriving is slow by design). Null content counts as empty, null names as ''.
    """
    secrets.check_password(password)
    if spread:
        files = files.repartition(spread, "archive_id", "entry_ix")
    content = F.coalesce("content", F.unhex(F.lit("")))
    rows = files.select("archive_id", "entry_ix", F.coalesce("name", F.lit("")).alias("name"), content.alias("content"), F.coalesce("mtime", F.timestamp_seconds(F.lit(0))).alias("mtime"), F.coalesce("mode", F.lit(0)).alias("mode"))
    most = chunk.most_chunks(F.octet_length("content"), variance)
    drawn = rows.select("*", secrets.entry_draws(most, variance, seed).alias("drawn")).select(*rows.columns, "drawn.*")
    keyed = drawn.withColumn("secret", secrets.derived_key(F.col("entry_salt"), password, iterations))
    key = F.col("secret.key")
    nonce = lambda i: F.get("nonces", F.lit(i) if isinstance(i, int) else i)
    sealed_name = codec.seal_bytes(F.encode("name", "UTF-8"), key, nonce(0))
    metadata = codec.pack_metadata(sealed_name, codec.size_bucket(F.octet_length("content")), codec.timestamp_hash(F.col("entry_salt"), F.col("mtime")), F.col("mode"))
    laid = keyed.withColumn("layout", chunk.layout(F.octet_length("content"), F.col("deltas")))
    blocks = chunk.pieces(F.col("content"), F.col("layout"), lambda piece, i: codec.seal_bytes(piece, key, nonce(i + 3)))
    return laid.select(
        "archive_id",
        "entry_ix",
        "entry_salt",
        "frame_header",
        codec.seal_bytes(metadata, key, nonce(1)).alias("meta_sealed"),
        "interblock_pad",
        blocks.alias("blocks"),
        "trailer_pad",
        codec.seal_bytes(codec.hmac_sha256(F.col("secret"), F.col("content")), key, nonce(2)).alias("hmac_sealed"),
        "entry_checksum",
    )


def kept(made: DataFrame, at: str) -> DataFrame:
    """What was sealed, written to the folder ``at`` in row groups that readers of little memory can hold, and read from there.
    It is not compressed or put in dictionaries, as sealed bytes are random."""
    made.write.options(**{"parquet.block.size": GROUP_BYTES, "parquet.enable.dictionary": "false", "compression": "none"}).parquet(at)
    return made.sparkSession.read.parquet(at)


def archives(entries: DataFrame, password: str, iterations: int = secrets.ITERATIONS, seed: int | None = None) -> DataFrame:
    """One row per archive of written ``entries``: salt, and the number of entries sealed under the archive's key."""
    counted = entries.groupBy("archive_id").agg(F.count(F.lit(1)).alias("files"))
    drawn = counted.select("*", secrets.salts(F.col("files"), seed).alias("archive_salt"), secrets.random_bytes(F.col("files"), codec.NONCE_BYTES, seed).alias("nonce"))
    keyed = drawn.withColumn("secret", secrets.derived_key(F.col("archive_salt"), password, iterations))
    count = codec.seal_bytes(codec.le(F.col("files"), 8), F.col("secret.key"), F.col("nonce"))
    return keyed.select("archive_id", F.lit(codec.VERSION).alias("version"), "archive_salt", count.alias("file_count_sealed"))


def blocks(entries: DataFrame) -> DataFrame:
    """One row per block of ``entries``; entries of empty files have none."""
    return entries.select("archive_id", "entry_ix", F.posexplode("blocks").alias("block_ix", "sealed"))


def from_tables(entries: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Entries with their blocks gathered from a block table; entries without block rows keep an empty array."""
    gathered = block_rows.groupBy("archive_id", "entry_ix").agg(F.array_sort(F.collect_list(F.struct("block_ix", "sealed"))).alias("found"))
    joined = entries.drop("blocks").join(gathered, ["archive_id", "entry_ix"], "left")
    return joined.withColumn("blocks", F.coalesce(F.transform("found", lambda x: x["sealed"]), F.expr("cast(array() as array<binary>)"))).drop("found")
