"""Opening, listing and checking sealed entries. Every entry has an outcome of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec, secrets
from . import chunk

FATAL, RECOVERABLE = "fatal", "recoverable"
#: Codes of outcomes.
CODES = ("BAD_MAGIC", "BAD_VERSION", "AUTH_FAILED", "TRUNCATED", "INTEGRITY_FAIL", "WRITE_FAILED", "READ_FAILED")
ERROR_TYPE = "struct<kind: string, code: string, message: string>"


def error(code: str, message: str, kind: str = RECOVERABLE) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(message).alias("message"))


def error_text(err: Column) -> Column:
    """An error as it is printed."""
    return F.format_string("[%s] %s", err["code"], err["message"])


def keyed(entries: DataFrame, password: str, iterations: int) -> DataFrame:
    return entries.withColumn("secret", secrets.derived_key(F.col("entry_salt"), password, iterations))


def named(entries: DataFrame) -> DataFrame:
    """``entries`` that have a ``secret`` with ``meta`` and ``filename``; null where they do not open."""
    key = F.col("secret.key")
    meta = entries.withColumn("meta_plain", codec.open_bytes(F.col("meta_sealed"), key)).withColumn("meta", codec.unpack_metadata(F.col("meta_plain")))
    return meta.withColumn("name_plain", codec.open_bytes(F.col("meta.name"), key)).withColumn("filename", F.decode("name_plain", "UTF-8"))


def error_chain(chain=F):
    """The errors of what ``named`` made, first to last; more can be added."""
    return (
        chain.when(F.col("meta_sealed").isNull(), error("TRUNCATED", "read metadata ciphertext"))
        .when(F.col("meta_plain").isNull() | F.col("meta").isNull(), error("AUTH_FAILED", "decrypt metadata"))
        .when(F.col("name_plain").isNull(), error("AUTH_FAILED", "decrypt filename"))
    )


def unseal(entries: DataFrame, password: str, iterations: int = secrets.ITERATIONS) -> DataFrame:
    """Open every entry: filename, content, size, mode, ok and err.

    An entry is ok if its metadata, its name, every block and its HMAC open and the HMAC fits the content; the first of
    these that fails gives ``err``, and content and size are null. Other entries are not affected.
    """
    key = F.col("secret.key")
    told = named(keyed(entries, password, iterations))
    opened = told.withColumn("pieces", F.transform("blocks", lambda b: codec.open_bytes(b, key))).withColumn("hmac", codec.open_bytes(F.col("hmac_sealed"), key))
    whole = opened.withColumn("pieces_ok", F.col("pieces").isNotNull() & F.forall("pieces", lambda p: p.isNotNull()))
    whole = whole.withColumn("plain", F.when(F.col("pieces_ok"), chunk.joined(F.col("pieces"))))
    err = (
        error_chain()
        .when(F.col("blocks").isNull() | F.exists("blocks", lambda b: b.isNull()), error("TRUNCATED", "read block ciphertext"))
        .when(~F.col("pieces_ok"), error("AUTH_FAILED", "decrypt block"))
        .when(F.col("hmac_sealed").isNull(), error("TRUNCATED", "read HMAC sealed"))
        .when(F.col("hmac").isNull(), error("AUTH_FAILED", "decrypt HMAC"))
        .when(F.octet_length("hmac") != codec.DIGEST_BYTES, error("INTEGRITY_FAIL", "HMAC length mismatch"))
        .when(F.col("hmac") != codec.hmac_sha256(F.col("secret"), F.col("plain")), error("INTEGRITY_FAIL", "plaintext HMAC mismatch"))
    )
    judged = whole.withColumn("err", err).withColumn("ok", F.col("err").isNull())
    return judged.select(
        "archive_id",
        "entry_ix",
        "filename",
        F.when(F.col("ok"), F.col("plain")).alias("content"),
        F.when(F.col("ok"), F.octet_length("plain").cast("bigint")).alias("size"),
        F.when(F.col("ok"), F.col("meta.mode")).alias("mode"),
        "ok",
        "err",
    )


def listing(entries: DataFrame, password: str, iterations: int = secrets.ITERATIONS) -> DataFrame:
    """Names and size classes of all entries; blocks are neither read nor opened. Entries that do not open have
    null names and an error."""
    told = named(keyed(entries.select("archive_id", "entry_ix", "entry_salt", "meta_sealed"), password, iterations))
    judged = told.withColumn("err", error_chain())
    return judged.select("archive_id", "entry_ix", "filename", F.col("meta.bucket").alias("size_bucket"), F.when(F.col("err").isNull(), codec.bucket_label(F.col("meta.bucket"))).alias("bucket_label"), F.col("meta.day_hash").alias("day_hash"), F.col("meta.mode").alias("mode"), "err")


def summary(results: DataFrame) -> DataFrame:
    """How many entries opened, how many failed, and the bytes of those that opened."""
    return results.groupBy("archive_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def require_ok(results: DataFrame) -> None:
    """Raise if any entry failed."""
    failed = results.where(~F.col("ok")).count()
    if failed:
        raise RuntimeError(f"{failed} file(s) failed to extract")


def collisions(results: DataFrame) -> DataFrame:
    """Base names that more than one entry of an archive would be written to."""
    return results.where("ok").groupBy("archive_id", codec.basename(F.col("filename")).alias("target")).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def missing_entries(archives: DataFrame, entries: DataFrame, password: str, iterations: int = secrets.ITERATIONS) -> DataFrame:
    """Archives whose sealed count and rows differ (a sealed count of 0, as older writers leave it, says nothing)."""
    known = archives.withColumn("secret", secrets.derived_key(F.col("archive_salt"), password, iterations))
    told = known.select("archive_id", codec.from_le(F.substring(codec.open_bytes(F.col("file_count_sealed"), F.col("secret.key")), 1, 7)).alias("sealed_count"))
    found = entries.groupBy("archive_id").agg(F.count(F.lit(1)).alias("found"))
    both = told.join(found, "archive_id", "left").select("archive_id", "sealed_count", F.coalesce("found", F.lit(0)).alias("found"))
    return both.where("sealed_count is null or (sealed_count <> 0 and sealed_count <> found)")


def digest_ok(content: Column) -> Column:
    """Whether a whole archive file's digest fits; null for one too small to have a footer. Keys are not needed."""
    tail = codec.DIGEST_BYTES + codec.RESERVED_BYTES
    body = F.octet_length(content) - tail
    stored = F.substr(content, body + 1, F.lit(codec.DIGEST_BYTES))
    return F.when(body >= 0, codec.sha256(F.substr(content, F.lit(1), body)) == stored)
