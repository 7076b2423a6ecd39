import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from sealframe import cli
from sealframe.functions import codec, secrets
from sealframe.operators import seal, unseal
from sealframe.plans import metrics
from sealframe.sources import container, files, large, storage
from sealframe.streaming import seal_stream
from tests.test_seal import PASSWORD, file_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("container")
    seal.seal(file_rows(spark, b"", b"hello" * 100, b"x" * 200_000), PASSWORD, 10).write.parquet(f"{at}/entries")
    entries = spark.read.parquet(f"{at}/entries")
    seal.archives(entries, PASSWORD, 10).write.parquet(f"{at}/archives")
    container.write_archives(entries, spark.read.parquet(f"{at}/archives"), f"{at}/out")
    return str(at / "out")


def test_layout_of_bytes(folder):
    raw = open(f"{folder}/a.sealed", "rb").read()
    assert raw[:4] == codec.MAGIC and raw[4:6] == b"\x01\x00" and raw[74:106] == bytes(32)
    assert raw[106] == 1
    assert hashlib.sha256(raw[:-64]).digest() == raw[-64:-32] and raw[-32:] == bytes(32)
    assert os.listdir(folder) == ["a.sealed"]


def hand_made(password: str, iterations: int, content: bytes) -> bytes:
    """One entry put together from the published layout with fixed bytes, its blocks opened by nobody."""
    salt = bytes(range(32))
    framed = lambda n: bytes(12) + struct.pack("<I", n) + bytes(n)
    entry = b"\x01" + salt + bytes(32) + framed(60) + struct.pack("<I", 256) + bytes(256) + framed(len(content) + 16) + bytes(16) + struct.pack("<I", 512) + bytes(512) + framed(48) + bytes(8)
    body = codec.MAGIC + b"\x01\x00" + salt + bytes(36) + bytes(32) + entry
    return body + hashlib.sha256(body).digest() + bytes(32)


def test_reads_hand_made_bytes(spark, tmp_path):
    path = tmp_path / "hand.sealed"
    path.write_bytes(hand_made(PASSWORD, 1, b"abc"))
    row = container.read_archives(spark, str(path)).first()
    assert row.archive_id == "hand" and bytes(row.entry_salt) == bytes(range(32)) and [len(b) for b in row.blocks] == [31]
    assert len(row.interblock_pad) == 256 and len(row.trailer_pad) == 512 and len(row.hmac_sealed) == 60
    assert container.digest_fits(str(path))


@pytest.mark.parametrize("split", [1, 1 << 30])
def test_read_and_open(spark, folder, split):
    read = container.read_archives(spark, folder, split_bytes=split)
    rows = unseal.unseal(read, PASSWORD, 10).orderBy("entry_ix").collect()
    assert [bytes(r.content) for r in rows] == [b"", b"hello" * 100, b"x" * 200_000]
    assert [r.filename for r in rows] == ["dir/file0", "dir/file1", "dir/file2"]


def damaged(folder, tmp_path, change) -> str:
    raw = bytearray(open(f"{folder}/a.sealed", "rb").read())
    at = tmp_path / "damaged.sealed"
    at.write_bytes(bytes(change(raw)))
    return str(at)


def test_digest(spark, folder, tmp_path):
    assert container.verify_archives(spark, folder).first().digest_ok
    bad = damaged(folder, tmp_path, lambda r: r[:200] + bytes([r[200] ^ 1]) + r[201:])
    assert container.verify_archives(spark, bad).first().digest_ok is False
    small = tmp_path / "small.sealed"
    small.write_bytes(b"x")
    assert container.verify_archives(spark, str(small)).first().digest_ok is None


def test_one_byte_damages_one_entry(spark, folder, tmp_path):
    """Byte 200 is in the first entry's metadata; later entries are found all the same."""
    bad = damaged(folder, tmp_path, lambda r: r[:200] + bytes([r[200] ^ 1]) + r[201:])
    rows = unseal.unseal(container.read_archives(spark, bad), PASSWORD, 10).orderBy("entry_ix").collect()
    assert [r.ok for r in rows] == [False, True, True] and rows[0].err.code == "AUTH_FAILED"


def test_truncated(spark, folder, tmp_path):
    bad = damaged(folder, tmp_path, lambda r: r[:-5000])
    rows = unseal.unseal(container.read_archives(spark, bad), PASSWORD, 10).orderBy("entry_ix").collect()
    assert [r.ok for r in rows] == [True, True, False] and rows[2].err.code == "TRUNCATED"


@pytest.mark.parametrize("change,code", [(lambda r: bytes(256), "BAD_MAGIC"), (lambda r: r[:4] + b"\x02\x00" + r[6:], "BAD_VERSION"), (lambda r: r[:50], "TRUNCATED")])
def test_fatal(spark, folder, tmp_path, change, code):
    with pytest.raises(container.ArchiveError, match=code):
        container.walk(damaged(folder, tmp_path, change))


def test_huge_length_is_not_trusted(folder, tmp_path):
    bad = damaged(folder, tmp_path, lambda r: r[:183] + b"\xff\xff\xff\xff" + r[187:])
    assert len(container.walk(bad)) == 1


def test_file_source(spark, tmp_path):
    for name in ("plain", "_under", ".dot"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").write_bytes(b"")
    paths = [str(tmp_path / n) for n in ("plain", "_under", ".dot", "empty", "missing")] + [str(tmp_path)]
    rows = files.read_files(spark, paths).orderBy("entry_ix").collect()
    assert [r.content and bytes(r.content) for r in rows] == [b"plain", b"_under", b".dot", bytearray(), None, None]
    assert [r.err and r.err.code for r in rows] == [None] * 4 + ["READ_FAILED"] * 2
    with pytest.raises(ValueError):
        files.read_files(spark, [])


def test_file_sink_stays_in_its_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "../../up/name", 4, True, None, b"data", 0o600)], "archive_id string, entry_ix bigint, filename string, size bigint, ok boolean, err struct<kind: string, code: string, message: string>, content binary, mode bigint")
    out = files.write_files(rows, str(tmp_path / "out")).collect()
    assert out[0].ok and (tmp_path / "out/name").read_bytes() == b"data" and (tmp_path / "out/name").stat().st_mode & 0o777 == 0o600
    (tmp_path / "file").write_bytes(b"")
    assert files.write_files(rows, str(tmp_path / "file")).first().err.code == "WRITE_FAILED"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one").write_bytes(b"first")
    for extra in (None, "two"):
        if extra:
            (tmp_path / "in" / extra).write_bytes(b"second")
        running = seal_stream.seal_stream(seal_stream.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), PASSWORD, 10)
        running.awaitTermination()
    rows = unseal.unseal(spark.read.parquet(str(tmp_path / "out")), PASSWORD, 10).collect()
    assert sorted(bytes(r.content) for r in rows) == [b"first", b"second"] and len({r.archive_id for r in rows}) == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda parallel: spark)
    (tmp_path / "one.txt").write_bytes(b"roundtrip test data" * 500)
    (tmp_path / "two.txt").write_bytes(b"")
    made = str(tmp_path / "x.sealed")
    few = ["--iterations", "10"]
    assert cli.main(["archive", "-p", "short", "-o", made, str(tmp_path / "one.txt")]) == 1
    assert cli.main(["archive", "-p", PASSWORD, "-o", made, *few, str(tmp_path / "one.txt"), str(tmp_path / "two.txt"), str(tmp_path / "none")]) == 0
    assert "done: 2 file(s), 9.28 KB" in capsys.readouterr().out
    assert cli.main(["verify", "-a", made]) == 0
    assert cli.main(["list", "-p", PASSWORD, "-a", made, *few]) == 0
    told = capsys.readouterr().out
    assert "1-10 KB" in told and "2 file(s)" in told
    assert cli.main(["extract", "-p", PASSWORD, "-a", made, "-o", str(tmp_path / "out"), *few]) == 0
    assert (tmp_path / "out/one.txt").read_bytes() == b"roundtrip test data" * 500
    assert cli.main(["extract", "-p", "wrongpassword", "-a", made, "-o", str(tmp_path / "bad"), *few]) == 1
    assert secrets.ITERATIONS == 100_000


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """Files sealed in parts, and their archive, with all paths given as URIs."""
    at = tmp_path_factory.mktemp("parted")
    (at / "empty").write_bytes(b"")
    (at / "short").write_bytes(b"short")
    (at / "long").write_bytes(bytes(range(256)) * 4000)
    (at / "short").chmod(0o600)
    uris = [f"file://{at}/{n}" for n in ("empty", "short", "none", "long")]
    made = seal.kept(large.seal_files(spark, uris, PASSWORD, 10), f"{at}/parts")
    seal.archives(large.heads(made), PASSWORD, 10).write.parquet(f"{at}/archives")
    large.write_archives(made, spark.read.parquet(f"{at}/archives"), f"file://{at}/out")
    return at


CONTENTS = [b"", b"short", bytes(range(256)) * 4000]


def test_parts_are_ordinary_entries(spark, parted):
    made = spark.read.parquet(f"{parted}/parts")
    bad = made.where("err is not null").collect()
    assert [(r.entry_ix, r.name, r.err.code) for r in bad] == [(2, "none", "READ_FAILED")]
    sizes = [len(r.sealed) - 28 for r in made.where("entry_ix = 3 and block_ix is not null").orderBy("block_ix").collect()]
    assert sum(sizes) == 1_024_000 and all(57_344 <= n <= 73_728 for n in sizes[:-1]) and len(set(sizes)) > 2
    assert made.where("sealed is not null").selectExpr("substr(sealed, 1, 12) as n").distinct().count() == len(sizes) + 1
    rows = unseal.unseal(container.read_archives(spark, f"file://{parted}/out"), PASSWORD, 10).orderBy("entry_ix").collect()
    assert [bytes(r.content) for r in rows] == CONTENTS and [r.filename for r in rows] == ["empty", "short", "long"]
    assert container.verify_archives(spark, f"file://{parted}/out").first().digest_ok
    assert container.read_headers(spark, f"file://{parted}/out").first().err is None


@pytest.mark.parametrize("split", [1, 100_000, 1 << 30])
def test_open_parts(spark, parted, tmp_path, split):
    read = large.read_parts(spark, f"{parted}/out", split_bytes=split)
    for to in (None, f"file://{tmp_path}/uri", f"{tmp_path}/plain"):
        rows = large.open_parts(read, PASSWORD, 10, to).orderBy("entry_ix").collect()
        assert [(r.filename, r.size, r.sha256, r.ok, r.err) for r in rows] == [(n, len(c), hashlib.sha256(c).hexdigest(), True, None) for n, c in zip(("empty", "short", "long"), CONTENTS, strict=True)]
        if to:
            assert {n: (tmp_path / to.rpartition("/")[2] / n).read_bytes() for n in storage.names(to)} == dict(zip(("empty", "short", "long"), CONTENTS, strict=True))


def test_parts_of_entries(spark, folder):
    """Entries that are whole rows, as parts: opened alike."""
    rows = large.open_parts(large.parts(container.read_archives(spark, folder)), PASSWORD, 10).orderBy("entry_ix").collect()
    assert [r.size for r in rows] == [0, 500, 200_000] and all(r.ok for r in rows)
    assert [r.filename for r in unseal.listing(large.read_heads(spark, folder), PASSWORD, 10).orderBy("entry_ix").collect()] == ["dir/file0", "dir/file1", "dir/file2"]


def test_damage_to_parts_is_told_as_for_entries(spark, folder, tmp_path):
    changes = [lambda r: r[:200] + bytes([r[200] ^ 1]) + r[201:], lambda r: r[:-5000], lambda r: r[:-100_000], lambda r: r[:-9000] + b"\0" + r[-8999:], lambda r: r[:130], lambda r: r[:120]]
    for change in changes:
        bad = damaged(folder, tmp_path, change)
        whole = [(r.entry_ix, r.ok, r.err) for r in unseal.unseal(container.read_archives(spark, bad), PASSWORD, 10).orderBy("entry_ix").collect()]
        assert [(r.entry_ix, r.ok, r.err) for r in large.open_parts(large.read_parts(spark, bad), PASSWORD, 10, f"{tmp_path}/out").orderBy("entry_ix").collect()] == whole
        assert not any(n.endswith(".part") for n in storage.names(f"{tmp_path}/out"))


def test_lost_and_swapped_blocks(spark, parted):
    made = spark.read.parquet(f"{parted}/parts").where("entry_ix = 3")
    for change in ("case when block_ix = 2 then 3 when block_ix = 3 then 2 else block_ix end", "case when block_ix <> 4 then block_ix end"):
        kept = made.where("block_ix is null").unionByName(made.where("block_ix is not null").withColumn("block_ix", F.expr(change)).where("block_ix is not null"))
        assert large.open_parts(kept, PASSWORD, 10).first().err.code == "INTEGRITY_FAIL"
    wrong = large.open_parts(made, "wrongpassword", 10).first()
    assert wrong.err.code == "AUTH_FAILED" and wrong.filename is None


def test_parts_that_cannot_be_written(spark, parted, tmp_path):
    (tmp_path / "file").write_bytes(b"")
    (tmp_path / "out/long").mkdir(parents=True)
    read = large.read_parts(spark, f"{parted}/out")
    assert {r.err.code for r in large.open_parts(read, PASSWORD, 10, f"{tmp_path}/file").collect()} == {"WRITE_FAILED"}
    assert [r.ok for r in large.open_parts(read, PASSWORD, 10, f"{tmp_path}/out").orderBy("entry_ix").collect()] == [True, True, False]
    assert sorted(os.listdir(tmp_path / "out")) == ["empty", "long", "short"]


def test_plans_of_parts(spark, parted):
    """What is shuffled is sealed, and no plan holds the password."""
    plan = large.open_parts(large.read_parts(spark, f"{parted}/out"), PASSWORD, 10)._jdf.queryExecution().toString()
    above, _, below = plan.split("== Physical Plan ==")[1].partition("Exchange")
    assert PASSWORD not in plan and "derive_all" in above and "derive_all" not in below


def test_storage(tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    for base in (str(tmp_path), f"file://{tmp_path}"):
        assert storage.size(f"{base}/a") == 3 and storage.names(base) == ["a"] and storage.is_folder(base)
        for gone in (f"{base}/none", base):
            with pytest.raises(OSError):
                storage.about(gone)
        storage.remove(f"{base}/none")
        storage.remove_folder(f"{base}/none")
    with pytest.raises(OSError):
        storage.reading("nothing://of/this")


def test_progress(spark, parted, tmp_path):
    """Told while the job runs and at its end: files, bytes and errors, of sealing and of opening."""
    told = []
    with metrics.Progress(spark, lambda *now: told.append(now), every=0.05) as progress:
        large.seal_files(spark, [f"{parted}/{n}" for n in ("empty", "short", "none", "long")], PASSWORD, 10, slices=4, progress=progress).write.format("noop").mode("overwrite").save()
    assert told[-1] == progress.now() == (3, 1_024_005, 1) and told == sorted(told)
    with metrics.Progress(spark, lambda *now: told.append(now)) as progress:
        large.open_parts(large.read_parts(spark, f"{parted}/out"), PASSWORD, 10, progress=progress).collect()
    assert told[-1] == (3, 1_024_005, 0)
