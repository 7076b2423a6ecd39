import datetime
import hashlib
import hmac

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealframe.functions import codec, secrets


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_aes_gcm_vector(spark):
    """The all-zero test vector of the published AES-256-GCM set."""
    zero = codec.binary(bytes(16))
    sealed = bytes(one(spark, x=codec.seal_bytes(zero, codec.binary(bytes(32)), codec.binary(bytes(12)))).x)
    assert sealed.hex() == "00" * 12 + "cea7403d4d606b6e074ec5d3baf39d18" + "d0d1c8a799996bf0265b98b5d48ab919"
    assert bytes(one(spark, x=codec.open_bytes(codec.binary(sealed), codec.binary(bytes(32)))).x) == bytes(16)
    assert one(spark, x=codec.open_bytes(codec.binary(sealed[:-1] + b"x"), codec.binary(bytes(32)))).x is None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(key=st.binary(min_size=1, max_size=64), data=st.binary(max_size=200), value=st.integers(0, 2**32 - 1))
def test_hmac_and_integers(spark, key, data, value):
    row = one(spark, h=codec.hmac_column(codec.binary(key), codec.binary(data)), v=codec.le(F.lit(value), 4), back=codec.from_le(codec.le(F.lit(value), 4)))
    assert bytes(row.h) == hmac.digest(key, data, "sha256")
    assert bytes(row.v) == value.to_bytes(4, "little")
    assert row.back == value


def test_day_hash(spark):
    at = lambda h, m, s: F.lit(datetime.datetime(2026, 7, 1, h, m, s))
    row = one(spark, a=codec.timestamp_hash(codec.binary(bytes(32)), at(0, 0, 0)), b=codec.timestamp_hash(codec.binary(bytes(32)), at(23, 59, 59)))
    day = int(datetime.datetime(2026, 7, 1, tzinfo=datetime.UTC).timestamp())
    assert row.a == row.b == bytearray(hmac.digest(bytes(32), day.to_bytes(8, "little"), "sha256"))
    assert one(spark, x=codec.day_start(F.lit(datetime.datetime(1969, 12, 31, 12)))).x == -86400


@pytest.mark.parametrize("path,name", [("", "."), ("/", "/"), ("//", "/"), ("a", "a"), ("a/b", "b"), ("a/b/", "b"), ("../../x", "x")])
def test_basename(spark, path, name):
    assert one(spark, x=codec.basename(F.lit(path))).x == name


@pytest.mark.parametrize("size,told", [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1 << 20, "1.00 MB"), (3 << 30, "3.00 GB")])
def test_format_bytes(spark, size, told):
    assert one(spark, x=codec.format_bytes(F.lit(size).cast("bigint"))).x == told


def test_metadata_limits(spark):
    pack = lambda n: codec.pack_metadata(F.unhex(F.lit("ab" * n)), F.lit(1), codec.binary(bytes(32)), F.lit(420))
    assert one(spark, x=pack(65_536)).x is None
    packed = bytes(one(spark, x=pack(3)).x)
    for n in (0, 1, len(packed) - 1):
        assert one(spark, x=codec.unpack_metadata(codec.binary(packed[:n]) if n else F.unhex(F.lit("")))).x is None


def test_keys(spark):
    salt = bytes([0xAB]) * 32
    row = one(spark, k=secrets.derived_key(codec.binary(salt), "mypassword", 1000)).k
    assert bytes(row.key) == hashlib.pbkdf2_hmac("sha256", b"mypassword", salt, 1000, 32)
    with pytest.raises(ValueError):
        secrets.check_password("short")
    with pytest.raises(ValueError):
        secrets.random_bytes(F.lit(1), 0)


def test_random_ranges():
    for low, high in (secrets.HEADER_PADDING, secrets.TRAILER_PADDING, secrets.INTERBLOCK_PADDING):
        assert all(low <= secrets.random_length(low, high) <= high for _ in range(200))
    assert secrets.random_delta(0) == 0
    assert {secrets.random_length(0, 3) for _ in range(400)} == {0, 1, 2, 3}
