"""The format's scalar operators as SQL functions. Their bodies are SQL, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.codec import BUCKET_BOUNDS, BUCKET_LABELS, BYTE_UNITS

_cases = " ".join(f"WHEN size <= {b} THEN {i}" for i, b in enumerate(BUCKET_BOUNDS))
_labels = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(BUCKET_LABELS[:-1]))
_units = " ".join(f"WHEN size >= {n} THEN format_string('%.2f {u}', bround(size / {n}D, 2))" for n, u in BYTE_UNITS)

FUNCTIONS = {
    "size_bucket(size BIGINT) RETURNS INT": f"CASE {_cases} ELSE {len(BUCKET_BOUNDS)} END",
    "bucket_label(bucket INT) RETURNS STRING": f"CASE bucket {_labels} ELSE '{BUCKET_LABELS[-1]}' END",
    "format_bytes(size BIGINT) RETURNS STRING": f"CASE {_units} ELSE format_string('%d B', size) END",
    "path_basename(path STRING) RETURNS STRING": "CASE WHEN path = '' THEN '.' WHEN path RLIKE '^/+$' THEN '/' ELSE regexp_extract(path, '([^/]+)/*$', 1) END",
    "archive_digest_ok(content BINARY) RETURNS BOOLEAN": "CASE WHEN octet_length(content) >= 64 THEN unhex(sha2(substring(content, 1, octet_length(content) - 64), 256)) = substring(content, octet_length(content) - 63, 32) END",
}


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
