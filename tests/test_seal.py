import datetime

import pytest
from pyspark.sql import functions as F

from sealframe.functions import codec
from sealframe.operators import chunk, seal, unseal

PASSWORD = "password123"
WHEN = datetime.datetime(2026, 7, 1, 15, 30)


def file_rows(spark, *contents):
    rows = [("a", i, f"dir/file{i}", c, WHEN, 0o644) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "archive_id string, entry_ix bigint, name string, content binary, mtime timestamp, mode int")


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sealed") / "entries")
    rows = file_rows(spark, b"", b"hello", b"ABCD" * 40_960, bytes(range(256)) * 3000)
    seal.seal(rows, PASSWORD, 10).write.parquet(at)
    return spark.read.parquet(at)


def test_round_trip(spark, sealed):
    rows = unseal.unseal(sealed, PASSWORD, 10).orderBy("entry_ix").collect()
    assert [bytes(r.content) for r in rows] == [b"", b"hello", b"ABCD" * 40_960, bytes(range(256)) * 3000]
    assert all(r.ok and r.err is None and r.mode == 0o644 for r in rows)
    assert [r.size for r in rows] == [0, 5, 163_840, 768_000]
    counts = [len(r.blocks) for r in sealed.orderBy("entry_ix").collect()]
    assert counts[:2] == [0, 1] and counts[2] >= 2 and counts[3] >= 10


def test_block_sizes_vary(sealed):
    blocks = sealed.where("entry_ix = 3").first().blocks
    sizes = [len(b) - 28 for b in blocks]
    assert all(57_344 <= n <= 73_728 for n in sizes[:-1]) and len(set(sizes)) > 2


def test_reordered_blocks_fail(sealed):
    assert not unseal.unseal(sealed.where("entry_ix = 3").withColumn("blocks", F.reverse("blocks")), PASSWORD, 10).first().ok


def test_null_parts(sealed):
    for column, code in (("meta_sealed", "TRUNCATED"), ("blocks", "TRUNCATED"), ("hmac_sealed", "TRUNCATED")):
        damaged = sealed.withColumn(column, F.lit(None).cast(sealed.schema[column].dataType))
        assert {r.err.code for r in unseal.unseal(damaged, PASSWORD, 10).collect()} == {code}


def test_summary_raises(sealed):
    unseal.require_ok(unseal.unseal(sealed, PASSWORD, 10))
    with pytest.raises(RuntimeError, match="4 file"):
        unseal.require_ok(unseal.unseal(sealed, "wrongpassword", 10))


def test_plans(spark, sealed):
    """Listing doesn't read blocks; opening doesn't shuffle; no secret is in a plan; every nonce is given."""
    text = lambda df: df._jdf.queryExecution().toString()
    assert "blocks" not in text(unseal.listing(sealed, PASSWORD, 10)).split("ReadSchema")[1]
    opened = text(unseal.unseal(sealed, PASSWORD, 10))
    assert "Exchange" not in opened and PASSWORD not in opened
    made = text(seal.seal(file_rows(spark, b"x"), PASSWORD, 10))
    assert "Exchange" not in made and PASSWORD not in made
    physical = made.split("== Physical Plan ==")[1]
    assert physical.count("derive_all(") <= 2


def test_seeded_is_repeatable(spark):
    one, two = (seal.seal(file_rows(spark, b"same").coalesce(1), PASSWORD, 1, seed=5).first() for _ in range(2))
    assert one == two


def test_no_rows(spark):
    assert unseal.unseal(seal.seal(file_rows(spark, b"x").where("false"), PASSWORD, 1), PASSWORD, 1).count() == 0


def test_nulls(spark):
    rows = spark.createDataFrame([("a", 0, None, None, None, None)], "archive_id string, entry_ix bigint, name string, content binary, mtime timestamp, mode int")
    row = unseal.unseal(seal.seal(rows, PASSWORD, 1), PASSWORD, 1).first()
    assert row.ok and row.filename == "" and row.size == 0 and row.mode == 0


@pytest.mark.parametrize("size,deltas,want", [(0, [0], []), (1, [0], [(0, 1)]), (10, [0, 0, 0], [(0, 4), (4, 4), (8, 2)]), (6, [-9, -9, 5], [(0, 1), (1, 1), (2, 4)])])
def test_layout(spark, size, deltas, want):
    laid = spark.range(1).select(chunk.layout(F.lit(size), F.array(*map(F.lit, deltas)), base=4).alias("c")).first().c
    assert [(x.start, x.length) for x in laid] == want


def test_file_count(spark, sealed):
    heads = seal.archives(sealed, PASSWORD, 10)
    row = heads.first()
    assert row.version == codec.VERSION and len(row.file_count_sealed) == 36
    assert unseal.missing_entries(heads, sealed, PASSWORD, 10).count() == 0
    assert unseal.missing_entries(heads, sealed.where("entry_ix > 0"), PASSWORD, 10).count() == 1
