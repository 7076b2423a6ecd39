"""Scalar expressions of the sealed format: sizes, names, little-endian integers, HMAC, metadata.

All are Catalyst expressions over columns and run inside generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = b"SARC"
VERSION = 1
ENTRY_FILE = 1
KEY_BYTES = 32
SALT_BYTES = 32
NONCE_BYTES = 12
TAG_BYTES = 16
DIGEST_BYTES = 32
RESERVED_BYTES = 32
HEADER_BYTES = 106
SENTINEL_BYTES = 16
CHECKSUM_BYTES = 8
BUCKET_BOUNDS = (1_024, 10_240, 102_400, 1_048_576)
BUCKET_LABELS = ("0-1 KB", "1-10 KB", "10-100 KB", "100 KB-1 MB", ">1 MB")
BYTE_UNITS = ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"))
DAY_SECONDS = 86_400
MOST_NAME_BYTES = 65_535
#: Bytes of packed metadata beside the name.
METADATA_FIXED = 2 + 1 + 32 + 4


def binary(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def size_bucket(size: Column) -> Column:
    """The class 0 to 4 of a size; the bounds belong to the smaller class."""
    chain = reduce(lambda c, b: c.when(size <= b[1], b[0]), enumerate(BUCKET_BOUNDS), F)
    return chain.otherwise(len(BUCKET_BOUNDS)).cast("int")


def bucket_label(bucket: Column) -> Column:
    """The text of a size class; any other number reads as the largest."""
    chain = reduce(lambda c, b: c.when(bucket == b[0], b[1]), enumerate(BUCKET_LABELS[:-1]), F)
    return chain.otherwise(BUCKET_LABELS[-1])


def basename(path: Column) -> Column:
    """The last component of a path: '.' for an empty one, '/' for slashes only."""
    return F.when(path == "", ".").when(path.rlike("^/+$"), "/").otherwise(F.regexp_extract(path, "([^/]+)/*$", 1))


def format_bytes(size: Column) -> Column:
    """A size in its largest unit of 1024, with two decimals from KB on, ties to even."""
    chain = reduce(lambda c, u: c.when(size >= u[0], F.format_string(f"%.2f {u[1]}", F.bround(size / float(u[0]), 2))), BYTE_UNITS, F)
    return chain.otherwise(F.format_string("%d B", size))


def throughput(size: Column, seconds: Column) -> Column:
    """MB (of 2^20 bytes) a second; null for no time."""
    return F.when(seconds > 0, size / seconds / float(1 << 20))


def chart_rate(milliseconds: Column, gigabytes: float = 1.0) -> Column:
    """MB a second of a benchmark over ``gigabytes`` of 1024 MB; 0 for no time."""
    return F.when(milliseconds <= 0, 0.0).otherwise(F.lit(gigabytes * 1024) / (milliseconds / 1000))


def le(value: Column, width: int) -> Column:
    """An integer as ``width`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0") if width == 8 else F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * width))
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def from_le(raw: Column) -> Column:
    """The integer that up to seven little-endian bytes stand for."""
    digits = F.hex(raw)
    pairs = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.substr(digits, i, F.lit(2)))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("bigint")


def day_start(moment: Column) -> Column:
    """Epoch seconds of the UTC day's start (the session's time zone must be UTC for timestamps without zone)."""
    return (F.floor(F.unix_seconds(moment.cast("timestamp")) / DAY_SECONDS) * DAY_SECONDS).cast("bigint")


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hmac_sha256(pads: Column, data: Column) -> Column:
    """HMAC-SHA256 from the key's two pads (a struct of ``ipad`` and ``opad``)."""
    return sha256(F.concat(pads["opad"], sha256(F.concat(pads["ipad"], data))))


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """The two pads of a key of up to 64 bytes."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_column(key: Column, data: Column) -> Column:
    """HMAC-SHA256 with a key column of up to 64 bytes, by table look-ups on its hexadecimal digits."""
    padded = F.rpad(F.hex(key), 128, "0")
    flipped = [F.unhex(F.translate(padded, "0123456789ABCDEF", "".join(f"{i ^ d:X}" for i in range(16)))) for d in (3, 6, 5, 12)]
    # A byte's two digits are flipped by different masks; take every other digit from each.
    odd = F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: i)
    weave = lambda a, b: F.unhex(F.array_join(F.transform(odd, lambda i: F.concat(F.substr(F.hex(a), i, F.lit(1)), F.substr(F.hex(b), i + 1, F.lit(1)))), ""))
    ipad, opad = weave(flipped[0], flipped[1]), weave(flipped[2], flipped[3])
    return hmac_sha256(F.struct(ipad.alias("ipad"), opad.alias("opad")), data)


def timestamp_hash(salt: Column, moment: Column) -> Column:
    """HMAC-SHA256 of the UTC day of ``moment`` under an entry's salt."""
    return hmac_column(salt, le(day_start(moment), 8))


def pack_metadata(name: Column, bucket: Column, day_hash: Column, mode: Column) -> Column:
    """Name length, sealed name, size class, day hash and permissions; null if the name is too long."""
    packed = F.concat(le(F.octet_length(name), 2), name, le(bucket, 1), day_hash, le(mode, 4))
    return F.when(F.octet_length(name) <= MOST_NAME_BYTES, packed)


def unpack_metadata(raw: Column) -> Column:
    """A struct of name, bucket, day_hash and mode; null if ``raw`` is cut short."""
    size = F.octet_length(raw)
    named = from_le(F.substring(raw, 1, 2)).cast("int")
    at = lambda offset, count: F.substr(raw, named + F.lit(offset), F.lit(count))
    fields = F.struct(
        F.substr(raw, F.lit(3), named).alias("name"),
        from_le(at(3, 1)).cast("int").alias("bucket"),
        at(4, 32).alias("day_hash"),
        from_le(at(36, 4)).cast("bigint").alias("mode"),
    )
    return F.when(size >= 2, F.when(size >= named + METADATA_FIXED, fields))


def prefixed(data: Column) -> Column:
    """``data`` behind its length in four little-endian bytes."""
    return F.concat(le(F.octet_length(data), 4), data)


def framed(sealed: Column) -> Column:
    """A sealed value (nonce before ciphertext) as nonce, ciphertext length, ciphertext."""
    return F.concat(F.substr(sealed, F.lit(1), F.lit(NONCE_BYTES)), prefixed(F.substr(sealed, F.lit(NONCE_BYTES + 1), F.octet_length(sealed))))


def seal_bytes(plain: Column, key: Column, nonce: Column) -> Column:
    """AES-256-GCM: nonce, ciphertext, tag. The nonce is always given: left to the engine, it is reused."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce)


def open_bytes(sealed: Column, key: Column) -> Column:
    """The plaintext; null where the tag does not fit."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"))
