"""The registered queries over the engine's operators, and the DuckDB SQL that each must agree with.

Sealed bytes are random, so queries compare facts about them: contents after a round trip, sizes, counts, outcomes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, secrets
from ..operators import chunk, seal, unseal
from ..sources import container, files, large
from ..streaming import seal_stream
from . import metrics, sql_functions

Query = Callable[[SparkSession, str], DataFrame]
PASSWORD, WRONG = "a password for tests", "another password"
#: Work per key where a query seals every document; the engine's default is 100,000.
LIGHT = 1_000
SALT = bytes(range(32))
KEY = bytes([1]) * 32
#: Documents of one virtual file of several blocks.
VOLUME = 100
_folders = itertools.count()

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder on storage that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sealframe-")
    return f"{shared.removeprefix('file://').rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{next(_folders)}"


def _spread(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return seal.as_files(docs, F.concat(F.lit("doc_"), F.col("doc_id")), F.encode("text", "UTF-8"), entry=F.col("doc_id"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    return seal.as_files(rows, F.concat(F.lit("nations/"), F.col("n_name")), F.encode("n_name", "UTF-8"), entry=F.col("n_nationkey"))


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``VOLUME`` documents as one file, their texts in order."""
    docs = _table(spark, sf_dir, "documents").groupBy(F.expr(f"doc_id div {VOLUME}").alias("volume"))
    rows = docs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return seal.as_files(rows, F.concat(F.lit("volume_"), F.col("volume")), F.encode("text", "UTF-8"), entry=F.col("volume"))


def _written(spark: SparkSession, entries: DataFrame, name: str) -> DataFrame:
    """Sealed entries, materialised: they are random each time they are computed."""
    return seal.kept(entries, _folder(spark, name))


def _flip(data: Column, byte: int) -> Column:
    """``data`` with one byte (from 1) changed."""
    changed = F.unhex(F.lpad(F.hex((F.conv(F.hex(F.substring(data, byte, 1)), 16, 10).cast("int") + 1) % 256), 2, "0"))
    return F.concat(F.substring(data, 1, byte - 1), changed, F.substr(data, F.lit(byte + 1), F.octet_length(data)))


def _values(spark: SparkSession, columns: str, *rows: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'({r})' for r in rows)} AS t({columns})")


_BUCKET_SQL = "CASE WHEN {0} <= 1024 THEN 0 WHEN {0} <= 10240 THEN 1 WHEN {0} <= 102400 THEN 2 WHEN {0} <= 1048576 THEN 3 ELSE 4 END"
_LABEL_SQL = "CASE {0} WHEN 0 THEN '0-1 KB' WHEN 1 THEN '1-10 KB' WHEN 2 THEN '10-100 KB' WHEN 3 THEN '100 KB-1 MB' ELSE '>1 MB' END"


def _hmac_sql(key: bytes, data: str) -> str:
    ipad, opad = codec.key_pads(key)
    return f"sha256(unhex('{opad.hex()}') || unhex(sha256(unhex('{ipad.hex()}') || {data})))"


def _le_sql(value: str, width: int) -> str:
    """Hexadecimal digits of an integer's little-endian bytes."""
    digits = f"printf('%016x', CAST({value} AS BIGINT))"
    return " || ".join(f"substr({digits}, {17 - 2 * (i + 1)}, 2)" for i in range(width))


# Scalar operators.


@query(f"""
SELECT size_bucket, {_LABEL_SQL.format("size_bucket")} AS bucket_label, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes
FROM (SELECT strlen("text") AS n, {_BUCKET_SQL.format('strlen("text")')} AS size_bucket FROM documents) GROUP BY size_bucket
""")
def size_bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint")
    sized = _table(spark, sf_dir, "documents").select(size.alias("n"), codec.size_bucket(size).alias("size_bucket"))
    counted = sized.groupBy("size_bucket").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"))
    return counted.withColumn("bucket_label", codec.bucket_label(F.col("size_bucket")))


_SIZES = {0: 0, 1024: 0, 1025: 1, 10240: 1, 10241: 2, 102400: 2, 102401: 3, 1048576: 3, 1048577: 4}


@query("SELECT * FROM (VALUES " + ", ".join(f"(CAST({n} AS BIGINT), {b}, {_LABEL_SQL.format(b)})" for n, b in _SIZES.items()) + ") t(n, size_bucket, bucket_label)")
def bucket_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _values(spark, "n", *(f"{n}L" for n in _SIZES))
    return sizes.withColumn("size_bucket", codec.size_bucket(F.col("n"))).withColumn("bucket_label", codec.bucket_label(F.col("size_bucket")))


@query("""
SELECT doc_id, n, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE)
    WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS told
FROM (SELECT doc_id, strlen("text") * [1, 1000, 1000000][1 + doc_id % 3] AS n FROM documents)
""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("bigint") * F.get(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("doc_id") % 3).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", size.alias("n")).withColumn("told", codec.format_bytes(F.col("n")))


@query("SELECT page_id, CASE WHEN url = '' THEN '.' WHEN regexp_matches(url, '^/+$') THEN '/' ELSE regexp_extract(url, '([^/]+)/*$', 1) END AS name FROM pages")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", codec.basename(F.col("url")).alias("name"))


@query("SELECT o_orderkey, o_totalprice / 2.5::DOUBLE / 1048576.0::DOUBLE AS rate, CASE WHEN o_totalprice <= 0 THEN 0 ELSE 1024.0::DOUBLE / (o_totalprice / 1000) END AS chart FROM orders")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _table(spark, sf_dir, "orders").select("o_orderkey", codec.throughput(price, F.lit(2.5)).alias("rate"), codec.chart_rate(price).alias("chart"))


@query(f"SELECT event_id, {_hmac_sql(SALT, 'unhex(' + _le_sql('floor(epoch(ts) / 86400) * 86400', 8) + ')')} AS day_hash FROM events")
def day_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.lower(F.hex(codec.timestamp_hash(codec.binary(SALT), F.col("ts")))).alias("day_hash"))


@query(f"""SELECT doc_id, {_hmac_sql(KEY, 'encode("text")')} AS hmac FROM documents""")
def content_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    ipad, opad = map(codec.binary, codec.key_pads(KEY))
    pads = F.struct(ipad.alias("ipad"), opad.alias("opad"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(codec.hmac_sha256(pads, F.encode("text", "UTF-8")))).alias("hmac"))


@query("""SELECT doc_id, true AS fits, false AS other_fits FROM documents""")
def hmac_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("data", F.encode("text", "UTF-8"))
    one, other = (codec.hmac_column(codec.binary(bytes([i]) * 32), F.col("data")) for i in (1, 2))
    ipad, opad = map(codec.binary, codec.key_pads(KEY))
    told = codec.hmac_sha256(F.struct(ipad.alias("ipad"), opad.alias("opad")), F.col("data"))
    return docs.select("doc_id", (one == told).alias("fits"), (other == told).alias("other_fits"))



def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    name = F.encode(F.concat(F.lit("doc_"), F.col("doc_id")), "UTF-8")
    return docs.select("doc_id", codec.pack_metadata(name, codec.size_bucket(F.octet_length("text")), codec.binary(bytes([0xAB]) * 32), F.lit(0o644)).alias("packed"))


@query(f"""
SELECT doc_id, upper({_le_sql("strlen(name)", 2)} || hex(encode(name)) || {_le_sql(_BUCKET_SQL.format("n"), 1)} || repeat('ab', 32) || {_le_sql("420", 4)}) AS packed
FROM (SELECT doc_id, 'doc_' || doc_id AS name, strlen("text") AS n FROM documents)
""")
def metadata_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata(spark, sf_dir).select("doc_id", F.hex("packed").alias("packed"))


@query(f"""SELECT doc_id, 'doc_' || doc_id AS name, {_BUCKET_SQL.format('strlen("text")')} AS bucket, repeat('AB', 32) AS day_hash, CAST(420 AS BIGINT) AS mode, true AS cut_is_null FROM documents""")
def metadata_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _metadata(spark, sf_dir)
    cut = codec.unpack_metadata(F.substr("packed", F.lit(1), F.octet_length("packed") - 1))
    read = packed.select("doc_id", codec.unpack_metadata(F.col("packed")).alias("m"), cut.isNull().alias("cut_is_null"))
    return read.select("doc_id", F.decode("m.name", "UTF-8").alias("name"), "m.bucket", F.hex("m.day_hash").alias("day_hash"), "m.mode", "cut_is_null")


def _derived_rows(iterations: int, names: list[str]) -> str:
    return ", ".join(f"('{n}', '{secrets.derive(PASSWORD, hashlib.sha256(n.encode()).digest(), iterations).hex()}')" for n in names)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query()
def key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _values(spark, "name", *(f"'{n}'" for n in _REGIONS)).repartition(_spread(spark), "name")
    return names.select("name", F.lower(F.hex(secrets.derived_key(codec.sha256(F.encode("name", "UTF-8")), PASSWORD)["key"])).alias("key"))


# Chunks.


def _steady(count: Column, variance: int) -> Column:
    """Repeatable deviations."""
    return F.transform(F.sequence(F.lit(0), count), lambda i: ((i * 4099) % (2 * variance + 1) - variance).cast("int"))


def _layout_sql(size: str, base: int, variance: int) -> str:
    return f"""
    SELECT doc_id, i AS block_ix, start, least(n - start, wide) AS length FROM (
        SELECT doc_id, n, i, wide, coalesce(CAST(sum(wide) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
        FROM (SELECT doc_id, n, CAST(i AS INTEGER) AS i, {base} + (i * 4099) % {2 * variance + 1} - {variance} AS wide
            FROM (SELECT doc_id, {size} AS n, unnest(range(0, 1 + CAST(ceil({size} / {base - variance}) AS BIGINT))) AS i FROM documents))
    ) WHERE start < n"""


@query(_layout_sql('strlen("text")', 1024, 128))
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    laid = chunk.layout(size, _steady(F.ceil(size / 896.0).cast("int"), 128), base=1024)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(laid).alias("block_ix", "c"))
    return rows.select("doc_id", "block_ix", "c.start", "c.length")


@query("""SELECT doc_id, sha256("text") AS content_sha256, strlen("text") AS size FROM documents WHERE "text" <> ''""")
def chunk_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    deltas = _steady(F.ceil(F.octet_length("content") / 896.0).cast("int"), 128)
    whole = chunk.reassemble(chunk.chunks(docs, deltas, base=1024), ["doc_id"])
    return whole.select("doc_id", F.sha2("content", 256).alias("content_sha256"), F.octet_length("content").cast("bigint").alias("size"))


@query("SELECT true AS all_within, true AS covers, CAST(10 AS BIGINT) AS files")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random chunks of virtual content: all but the last within 57,344 to 73,728 bytes, and they cover it."""
    size = F.lit(1_000_000) + F.col("id") * 37
    rows = spark.range(10).withColumn("deltas", secrets.random_deltas(chunk.most_chunks(size)))
    laid = rows.withColumn("laid", chunk.layout(size, F.col("deltas")))
    inner = F.slice("laid", F.lit(1), F.size("laid") - 1)
    within = F.forall(inner, lambda c: c["length"].between(57_344, 73_728)) & F.forall("laid", lambda c: c["length"] <= 73_728)
    covers = F.aggregate("laid", F.lit(0).cast("bigint"), lambda a, c: a + c["length"]) == size
    return laid.agg(F.bool_and(within).alias("all_within"), F.bool_and(covers).alias("covers"), F.count(F.lit(1)).alias("files"))


# Sealing and opening.


@query("""SELECT doc_id, strlen("text") AS size, true AS ok, sha256("text") AS content_sha256, 'doc_' || doc_id AS filename FROM documents""")
def seal_open_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = unseal.unseal(seal.seal(_documents(spark, sf_dir), PASSWORD, LIGHT, spread=_spread(spark)), PASSWORD, LIGHT)
    return opened.select(F.col("entry_ix").alias("doc_id"), "size", "ok", F.sha2("content", 256).alias("content_sha256"), "filename")


_VOLUME_SQL = f"""SELECT doc_id // {VOLUME} AS volume, string_agg("text", chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1"""


@query(f"SELECT volume, strlen(body) AS size, true AS ok, sha256(body) AS content_sha256, strlen(body) > 73728 AS several FROM ({_VOLUME_SQL})")
def seal_open_multiblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several blocks."""
    sealed = seal.seal(_volumes(spark, sf_dir), PASSWORD, LIGHT, spread=_spread(spark)).withColumn("several", F.size("blocks") > 1)
    kept = _written(spark, sealed, "multiblock")
    opened = unseal.unseal(kept, PASSWORD, LIGHT).join(kept.select("entry_ix", "several"), "entry_ix")
    return opened.select(F.col("entry_ix").alias("volume"), "size", "ok", F.sha2("content", 256).alias("content_sha256"), (F.col("several") & (F.col("size") > 73728)).alias("several"))


@query(f"SELECT volume, strlen(body) AS size, true AS ok, sha256(body) AS content_sha256 FROM ({_VOLUME_SQL})")
def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and blocks kept as two tables, gathered again before opening."""
    kept = _written(spark, seal.seal(_volumes(spark, sf_dir), PASSWORD, LIGHT, spread=_spread(spark)), "tables")
    opened = unseal.unseal(seal.from_tables(kept.drop("blocks"), seal.blocks(kept)), PASSWORD, LIGHT)
    return opened.select(F.col("entry_ix").alias("volume"), "size", "ok", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT 0 AS blocks, CAST(0 AS BIGINT) AS size, true AS ok, sha256('') AS content_sha256, 'AUTH_FAILED' AS wrong_code")
def empty_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seal.as_files(spark.range(1), F.lit("empty.txt"), F.unhex(F.lit("")), entry=F.col("id"))
    kept = _written(spark, seal.seal(rows, PASSWORD), "empty")
    opened = unseal.unseal(kept, PASSWORD).join(kept.select("entry_ix", F.size("blocks").alias("blocks")), "entry_ix")
    wrong = unseal.unseal(kept, WRONG).select("entry_ix", F.col("err.code").alias("wrong_code"))
    return opened.join(wrong, "entry_ix").select("blocks", "size", "ok", F.sha2("content", 256).alias("content_sha256"), "wrong_code")


@query("""SELECT n_nationkey AS entry_ix, 'nations/' || n_name AS filename, 0 AS size_bucket, '0-1 KB' AS bucket_label, CAST(420 AS BIGINT) AS mode FROM nation""")
def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At full strength: 25 keys."""
    sealed = seal.seal(_nations(spark, sf_dir), PASSWORD, spread=_spread(spark))
    listed = unseal.listing(sealed, PASSWORD)
    return listed.select(F.col("entry_ix").cast("int").alias("entry_ix"), "filename", "size_bucket", "bucket_label", "mode")


@query("SELECT n_nationkey AS entry_ix, false AS ok, 'recoverable' AS kind, 'AUTH_FAILED' AS code, '[AUTH_FAILED] decrypt metadata' AS told FROM nation")
def wrong_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = unseal.unseal(seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), WRONG, LIGHT)
    return opened.select(F.col("entry_ix").cast("int").alias("entry_ix"), "ok", "err.kind", "err.code", unseal.error_text(F.col("err")).alias("told"))


def _tampered(spark: SparkSession, sf_dir: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    opened = unseal.unseal(change(seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT)), PASSWORD, LIGHT)
    told = (F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("err.code", F.lit("")).alias("code"), F.coalesce("err.message", F.lit("")).alias("message"))
    return opened.select(F.col("entry_ix").cast("int").alias("entry_ix"), "ok", *told)


def _tampered_sql(code: str, message: str) -> str:
    return f"SELECT n_nationkey AS entry_ix, false AS ok, CAST(-1 AS BIGINT) AS size, '{code}' AS code, '{message}' AS message FROM nation"


@query(_tampered_sql("AUTH_FAILED", "decrypt block"))
def tampered_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir, lambda e: e.withColumn("blocks", F.transform("blocks", lambda b: _flip(b, 14))))


@query(_tampered_sql("AUTH_FAILED", "decrypt metadata"))
def tampered_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir, lambda e: e.withColumn("meta_sealed", _flip(F.col("meta_sealed"), 20)))


@query(_tampered_sql("AUTH_FAILED", "decrypt HMAC"))
def tampered_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir, lambda e: e.withColumn("hmac_sealed", _flip(F.col("hmac_sealed"), 30)))


@query(_tampered_sql("INTEGRITY_FAIL", "plaintext HMAC mismatch"))
def dropped_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir, lambda e: e.withColumn("blocks", F.slice("blocks", F.lit(1), F.size("blocks") - 1)))


@query(_tampered_sql("TRUNCATED", "read HMAC sealed"))
def truncated_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tampered(spark, sf_dir, lambda e: e.withColumn("hmac_sealed", F.lit(None).cast("binary")))


@query("SELECT n_nationkey AS entry_ix, n_nationkey <> 7 AS ok, CASE WHEN n_nationkey <> 7 THEN strlen(n_name) ELSE -1 END AS size, CASE WHEN n_nationkey = 7 THEN 'AUTH_FAILED' ELSE '' END AS code, CASE WHEN n_nationkey = 7 THEN 'decrypt block' ELSE '' END AS message FROM nation")
def tamper_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry is damaged; all others open."""
    change = F.when(F.col("entry_ix") == 7, F.transform("blocks", lambda b: _flip(b, 14))).otherwise(F.col("blocks"))
    return _tampered(spark, sf_dir, lambda e: e.withColumn("blocks", change))


@query(f"SELECT 'archive' AS archive_id, count(*) - 1 AS ok, CAST(1 AS BIGINT) AS failed, CAST(sum(CASE WHEN n_nationkey <> 7 THEN strlen(n_name) END) AS BIGINT) AS bytes FROM nation")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("entry_ix") == 7, F.transform("blocks", lambda b: _flip(b, 14))).otherwise(F.col("blocks"))
    sealed = seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT).withColumn("blocks", change)
    return unseal.summary(unseal.unseal(sealed, PASSWORD, LIGHT))


# Properties of sealed data.


@query("SELECT true AS nonces_differ, true AS salts_differ, count(*) AS entries FROM documents")
def nonce_salt_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = seal.seal(_documents(spark, sf_dir), PASSWORD, 1, spread=_spread(spark))
    head = lambda c: F.substring(c, 1, codec.NONCE_BYTES)
    all_nonces = F.concat(F.array(head("meta_sealed"), head("hmac_sealed")), F.transform("blocks", lambda b: F.substring(b, 1, codec.NONCE_BYTES)))
    kept = _written(spark, sealed.select("entry_salt", all_nonces.alias("nonces")), "nonces")
    nonces = kept.select(F.explode("nonces").alias("nonce")).agg((F.count(F.lit(1)) == F.count_distinct("nonce")).alias("nonces_differ"))
    return nonces.crossJoin(kept.agg((F.count(F.lit(1)) == F.count_distinct("entry_salt")).alias("salts_differ"), F.count(F.lit(1)).alias("entries")))


@query("SELECT CAST(0 AS BIGINT) AS equal_blocks, CAST(0 AS BIGINT) AS equal_salts")
def dedup_resist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files sealed twice share no block and no salt."""
    rows = _documents(spark, sf_dir)
    one, two = (_written(spark, seal.seal(rows, PASSWORD, 1, spread=_spread(spark)), f"sealed-{i}") for i in (1, 2))
    cipher = lambda e: e.select(F.explode("blocks").alias("b")).select(F.sha2(F.substr("b", F.lit(13), F.octet_length("b")), 256).alias("h"))
    equal = cipher(one).join(cipher(two), "h").agg(F.count(F.lit(1)).alias("equal_blocks"))
    return equal.crossJoin(one.join(two, "entry_salt").agg(F.count(F.lit(1)).alias("equal_salts")))


@query("SELECT 'frame_header' AS part, true AS within UNION ALL SELECT 'interblock_pad', true UNION ALL SELECT 'trailer_pad', true UNION ALL SELECT 'entry_checksum', true UNION ALL SELECT 'header_pad', true")
def pad_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ix"))
    bounds = {"frame_header": (32, 32), "interblock_pad": secrets.INTERBLOCK_PADDING, "trailer_pad": secrets.TRAILER_PADDING, "entry_checksum": (8, 8), "header_pad": secrets.HEADER_PADDING}
    drawn = rows.select(*(F.octet_length(secrets.random_padding(F.col("ix"), b)).alias(n) for n, b in bounds.items()))
    within = drawn.agg(*(F.bool_and(F.col(n).between(*b)).alias(n) for n, b in bounds.items()))
    return within.unpivot([], list(bounds), "part", "within")


@query("""SELECT doc_id, true AS good, false AS bad, true AS small_is_null FROM documents""")
def verify_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.encode("text", "UTF-8")
    file = F.concat(body, codec.sha256(body), codec.binary(bytes(32)))
    bad = F.concat(F.lit(b"x"), body, codec.sha256(body), codec.binary(bytes(32)))
    return _table(spark, sf_dir, "documents").select("doc_id", unseal.digest_ok(file).alias("good"), unseal.digest_ok(bad).alias("bad"), unseal.digest_ok(F.substring(file, 1, 0)).isNull().alias("small_is_null"))


@query("""SELECT count(*) AS files, CAST(sum(strlen("text")) AS BIGINT) AS bytes FROM documents""")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(_documents(spark, sf_dir))


@query("SELECT count(*) AS files_processed, CAST(0 AS BIGINT) AS files_errored, CAST(sum(strlen(n_name)) AS BIGINT) AS bytes_processed FROM nation")
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened, seen = metrics.counted(unseal.unseal(seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), PASSWORD, LIGHT))
    opened.write.format("noop").mode("overwrite").save()
    told = seen.get
    return _values(spark, "files_processed, files_errored, bytes_processed", f"{told['files_processed']}L, {told['files_errored']}L, {told['bytes_processed']}L")


@query("SELECT 'archive' AS archive_id, count(*) AS sealed_count, count(*) - 1 AS found FROM nation")
def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sealed count tells that an entry was taken out."""
    kept = _written(spark, seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), "counted")
    return unseal.missing_entries(seal.archives(kept, PASSWORD, LIGHT), kept.where("entry_ix <> 3"), PASSWORD, LIGHT)


@query("SELECT n_regionkey AS target, count(*) AS entries FROM nation GROUP BY 1 HAVING count(*) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    named = seal.as_files(rows, F.concat(F.col("n_name"), F.lit("/"), F.col("n_regionkey")), F.encode("n_name", "UTF-8"), entry=F.col("n_nationkey"))
    met = unseal.collisions(unseal.unseal(seal.seal(named, PASSWORD, LIGHT), PASSWORD, LIGHT))
    return met.select(F.col("target").cast("int").alias("target"), "entries")


@query(f"""SELECT page_id, {_BUCKET_SQL.format("strlen(html)")} AS size_bucket, {_LABEL_SQL.format(_BUCKET_SQL.format("strlen(html)"))} AS bucket_label, regexp_extract(url, '([^/]+)/*$', 1) AS name FROM pages""")
def sql_functions_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar operators called from SQL text."""
    sql_functions.register(spark)
    _table(spark, sf_dir, "pages").createOrReplaceTempView("sealframe_pages")
    return spark.sql("SELECT page_id, size_bucket(octet_length(html)) AS size_bucket, bucket_label(size_bucket(octet_length(html))) AS bucket_label, path_basename(url) AS name FROM sealframe_pages")


# Files, containers, streams.


@query(f"SELECT volume, strlen(body) AS size, true AS ok, sha256(body) AS content_sha256, true AS digest_ok FROM ({_VOLUME_SQL})")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a single-file archive and read back."""
    kept = _written(spark, seal.seal(_volumes(spark, sf_dir), PASSWORD, LIGHT, spread=_spread(spark)), "entries")
    heads = _written(spark, seal.archives(kept, PASSWORD, LIGHT), "archives")
    at = _folder(spark, "container")
    container.write_archives(kept, heads, at)
    opened = unseal.unseal(container.read_archives(spark, at, split_bytes=1 << 20), PASSWORD, LIGHT)
    named = opened.select("archive_id", F.regexp_extract("filename", "volume_(.*)", 1).cast("bigint").alias("volume"), "size", "ok", F.sha2("content", 256).alias("content_sha256"))
    return named.join(container.verify_archives(spark, at), "archive_id").drop("archive_id")


def _nations_archive(spark: SparkSession, sf_dir: str) -> str:
    """The nations in a container: the archive's file."""
    kept = _written(spark, seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), "entries")
    heads = _written(spark, seal.archives(kept, PASSWORD, LIGHT), "archives")
    at = _folder(spark, "container")
    container.write_archives(kept, heads, at)
    return f"{at}/archive{container.SUFFIX}"


#: Damage to a container that nothing can be read from, and what it raises.
_FATAL = {
    "no_archive": (lambda raw: bytes(256), "BAD_MAGIC", "invalid magic bytes"),
    "next_version": (lambda raw: raw[:4] + b"\x02\x00" + raw[6:], "BAD_VERSION", "unsupported version 2"),
    "short_magic": (lambda raw: raw[:3], "TRUNCATED", "read magic"),
    "short_version": (lambda raw: raw[:5], "TRUNCATED", "read version"),
    "short_header": (lambda raw: raw[:50], "TRUNCATED", "read header"),
}


def _damaged(path: str) -> str:
    """A folder with the archive at ``path`` and one for each kind of fatal damage."""
    folder, _, name = path.rpartition("/")
    with open(path, "rb") as file:
        raw = file.read()
    for kind, (change, _, _) in _FATAL.items():
        with open(f"{folder}/{kind}{container.SUFFIX}", "wb") as file:
            file.write(change(raw))
    return folder


@query("SELECT * FROM (VALUES ('archive', '', '', ''), " + ", ".join(f"('{k}', 'fatal', '{c}', '{m}')" for k, (_, c, m) in _FATAL.items()) + ") t(archive_id, kind, code, message)")
def fatal_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no archive: each with the error that reading it raises, beside one that is fine."""
    read = container.read_headers(spark, _damaged(_nations_archive(spark, sf_dir)))
    return read.select("archive_id", *(F.coalesce(f"err.{c}", F.lit("")).alias(c) for c in ("kind", "code", "message")))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of an archive that lacks its last 100 bytes."""
    path = _nations_archive(spark, sf_dir)
    with open(path, "rb") as file:
        raw = file.read()
    cut = f"{path.rpartition('/')[0]}/cut{container.SUFFIX}"
    with open(cut, "wb") as file:
        file.write(raw[:-100])
    return unseal.unseal(container.read_archives(spark, cut, split_bytes=4096), PASSWORD, LIGHT)


@query("SELECT n_nationkey AS entry_ix, n_nationkey < m AS ok, CASE WHEN n_nationkey < m THEN strlen(n_name) ELSE -1 END AS size, CASE WHEN n_nationkey < m THEN '' ELSE 'TRUNCATED' END AS code FROM nation, (SELECT max(n_nationkey) AS m FROM nation)")
def cut_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry is cut off; all before it open."""
    return _cut(spark, sf_dir).select(F.col("entry_ix").cast("int").alias("entry_ix"), "ok", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("err.code", F.lit("")).alias("code"))


def _one_unwritable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened entries written to a folder in which one of their names is a folder already."""
    at = _folder(spark, "unwritable")
    os.makedirs(f"{at}/NATION_7")
    return files.write_files(unseal.unseal(seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), PASSWORD, LIGHT), at)


@query("SELECT 'nations/' || n_name AS filename, n_name <> 'NATION_7' AS ok, CASE WHEN n_name = 'NATION_7' THEN 'recoverable' ELSE '' END AS kind, CASE WHEN n_name = 'NATION_7' THEN 'WRITE_FAILED' ELSE '' END AS code FROM nation")
def unwritable_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_unwritable(spark, sf_dir).select("filename", "ok", *(F.coalesce(f"err.{c}", F.lit("")).alias(c) for c in ("kind", "code")))


_TOLD = ["[BAD_MAGIC] invalid magic bytes", "[BAD_VERSION] unsupported version 2", "[TRUNCATED] read magic", "[TRUNCATED] read version", "[TRUNCATED] read header", "[AUTH_FAILED] decrypt metadata", "[INTEGRITY_FAIL] plaintext HMAC mismatch", "[WRITE_FAILED] write file", "[READ_FAILED] read file"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in _TOLD) + ") t(told)")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code as it is printed where it comes up."""
    fatal = container.read_headers(spark, _damaged(_nations_archive(spark, sf_dir))).select("err")
    sealed = seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT)
    wrong = unseal.unseal(sealed, WRONG, LIGHT).select("err")
    short = unseal.unseal(sealed.withColumn("blocks", F.slice("blocks", F.lit(1), F.size("blocks") - 1)), PASSWORD, LIGHT).select("err")
    gone = files.read_files(spark, [f"{_folder(spark, 'none')}/gone"]).select("err")
    rows = [fatal, wrong, short, _one_unwritable(spark, sf_dir).select("err"), gone]
    return functools.reduce(DataFrame.unionByName, rows).where("err is not null").select(unseal.error_text(F.col("err")).alias("told")).distinct()


_PASSWORDS = ["", "short", "sevenbt", "eight by", "ééééé", "a password for tests"]


@query("SELECT password, strlen(password) >= 8 AS accepted FROM (VALUES " + ", ".join(f"('{w}')" for w in _PASSWORDS) + ") t(password)")
def password_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which passwords may seal: what the check raises, in UTF-8 bytes."""

    def accepted(password: str) -> bool:
        try:
            return secrets.check_password(password) == password
        except ValueError:
            return False

    return _values(spark, "password, accepted", *(f"'{w}', {str(accepted(w)).lower()}" for w in _PASSWORDS))


@query("""SELECT n_nationkey AS entry_ix, 'nations/' || n_name AS filename, strlen(n_name) AS size, true AS ok FROM nation""")
def serial_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed by one task, entry after entry."""
    kept = _written(spark, seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT, spread=1), "serial")
    if kept.rdd.getNumPartitions() != 1:
        raise AssertionError("serial sealing wrote several parts")
    return unseal.unseal(kept, PASSWORD, LIGHT).select(F.col("entry_ix").cast("int").alias("entry_ix"), "filename", "size", "ok")


@query("SELECT 'nations/' || n_name AS filename, true AS ok, strlen(n_name) AS size, hex(encode(n_name)) AS content, '' AS code FROM nation UNION ALL SELECT 'gone', false, -1, '', 'READ_FAILED'")
def file_source_and_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened entries written as files, and the files, with one that is missing, read by path."""
    at = _folder(spark, "files")
    opened = unseal.unseal(seal.seal(_nations(spark, sf_dir), PASSWORD, LIGHT), PASSWORD, LIGHT)
    written = files.write_files(opened, at)
    names = [r.filename for r in written.collect()]  # the paths to read: a list on the driver by nature
    read = files.read_files(spark, [f"{at}/{n.rpartition('/')[2]}" for n in names] + [f"{at}/gone"])
    name = F.when(F.col("err").isNull(), F.concat(F.lit("nations/"), F.col("name"))).otherwise(F.col("name"))
    return read.select(name.alias("filename"), F.col("err").isNull().alias("ok"), F.coalesce(F.octet_length("content"), F.lit(-1)).cast("bigint").alias("size"), F.coalesce(F.hex("content"), F.lit("")).alias("content"), F.coalesce("err.code", F.lit("")).alias("code"))


@query(f"SELECT 'volume_' || volume AS filename, strlen(body) AS size, true AS ok, sha256(body) AS content_sha256, CAST(1 AS BIGINT) AS heads FROM ({_VOLUME_SQL})")
def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files sealed block by block, through an archive that is read in ranges, to files again: none is ever one value."""
    at = _folder(spark, "large")
    rows = _volumes(spark, sf_dir).select("archive_id", "entry_ix", F.col("name").alias("filename"), F.octet_length("content").cast("bigint").alias("size"), F.lit(True).alias("ok"), F.lit(None).cast(unseal.ERROR_TYPE).alias("err"), "content", "mode")
    names = [r.filename for r in files.write_files(rows, f"{at}/files").collect()]  # the paths to read: a list on the driver by nature
    parts = seal.kept(large.seal_files(spark, [f"{at}/files/{n}" for n in names], PASSWORD, LIGHT), f"{at}/parts")
    heads = _written(spark, seal.archives(large.heads(parts), PASSWORD, LIGHT), "archives")
    large.write_archives(parts, heads, f"{at}/out")
    opened = large.open_parts(large.read_parts(spark, f"{at}/out", split_bytes=1 << 20), PASSWORD, LIGHT)
    listed = unseal.listing(large.read_heads(spark, f"{at}/out"), PASSWORD, LIGHT).groupBy("filename").agg(F.count(F.lit(1)).alias("heads"))
    return opened.join(listed, "filename").select("filename", "size", "ok", F.col("sha256").alias("content_sha256"), "heads")


@query("""SELECT doc_id, strlen("text") AS size, true AS ok, sha256("text") AS content_sha256 FROM documents""")
def stream_seal_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, sealed batch by batch, then opened."""
    at = _folder(spark, "stream")
    schema = _table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = stream.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), F.encode("text", "UTF-8").alias("content"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.lit(0o644).alias("mode"))
    running = seal_stream.seal_stream(rows.repartition(_spread(spark)), f"{at}/sealed", f"{at}/checkpoint", PASSWORD, LIGHT)
    running.awaitTermination()
    opened = unseal.unseal(spark.read.parquet(f"{at}/sealed"), PASSWORD, LIGHT)
    return opened.select(F.regexp_extract("filename", "doc_(.*)", 1).cast("bigint").alias("doc_id"), "size", "ok", F.sha2("content", 256).alias("content_sha256"))


def oracle_sql() -> dict[str, str]:
    keys = f"SELECT * FROM (VALUES {_derived_rows(secrets.ITERATIONS, _REGIONS)}) t(name, key)"
    return ORACLES | {"key_derivation": keys}
