"""Command line: archive, extract, verify, list."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import secrets
from .operators import seal, unseal
from .plans.metrics import Progress, report
from .sources import container, large, storage


def session(parallel: int) -> SparkSession:
    made = SparkSession.builder.appName("sealframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if not os.environ.get("SPARK_REMOTE") and "MASTER" not in os.environ:
        made = made.master(f"local[{parallel or '*'}]")
    return made.getOrCreate()


def log(level: str, message: str, **more: object) -> None:
    print(json.dumps({"level": level, "msg": message, **more}), file=sys.stderr)


def told(files: int, size: int, errors: int) -> None:
    log("INFO", "progress", files=files, bytes=size, errors=errors)


def archive(spark: SparkSession, given: argparse.Namespace) -> None:
    secrets.check_password(given.password)
    began = time.time()
    folder, _, name = (given.output if "://" in given.output else os.path.abspath(given.output)).rpartition("/")
    work = f"{folder}/.{name}-{uuid.uuid4().hex}"
    try:
        with Progress(spark, told) as progress:
            parts = seal.kept(large.seal_files(spark, given.files, given.password, given.iterations, progress=progress), f"{work}/parts")
        for row in parts.where("err is not null").orderBy("entry_ix").toLocalIterator():
            log("ERROR", "file failed", name=row.name, err=f"[{row.err.code}] {row.err.message}")
        good = large.heads(parts)
        if given.debug:
            for row in good.select("name", "size").toLocalIterator():
                log("DEBUG", "archiving", file=row.name, size=row.size)
        heads = seal.archives(good, given.password, given.iterations)
        if not heads.head(1):
            salt, nonce = os.urandom(32), os.urandom(12)
            one = spark.createDataFrame([("archive", salt, nonce, secrets.derive(given.password, salt, given.iterations))], "archive_id string, archive_salt binary, nonce binary, key binary")
            heads = one.select("archive_id", F.lit(1).alias("version"), "archive_salt", F.aes_encrypt(F.unhex(F.lit("00" * 8)), "key", F.lit("GCM"), F.lit("DEFAULT"), "nonce").alias("file_count_sealed"))
        heads.write.parquet(f"{work}/archives")
        large.write_archives(parts, spark.read.parquet(f"{work}/archives"), f"{work}/out")
        storage.move(f"{work}/out/archive{container.SUFFIX}", f"{folder}/{name}")
        total = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    finally:
        storage.remove_folder(work)
    print(report(total[0], total[1], time.time() - began))


def extract(spark: SparkSession, given: argparse.Namespace) -> None:
    ok = failed = 0
    with Progress(spark, told) as progress:
        opened = large.open_parts(large.read_parts(spark, given.archive), given.password, given.iterations, folder=given.output, progress=progress)
        rows = opened.collect()  # one an entry, without content: what is printed; a sort would open all twice
    for row in sorted(rows, key=lambda r: r.entry_ix):
        ok, failed = ok + row.ok, failed + (not row.ok)
        if not row.ok:
            print(f"  ERROR {row.filename or ''}: [{row.err.code}] {row.err.message}")
        elif given.debug:
            log("DEBUG", "extracted", file=row.filename, size=row.size)
    print(f"extracted {ok} file(s), {failed} error(s)")
    if failed:
        raise RuntimeError(f"{failed} file(s) failed to extract")


def verify(spark: SparkSession, given: argparse.Namespace) -> None:
    if storage.size(given.archive) < container.FOOTER_BYTES:
        raise RuntimeError("archive too small to contain a valid footer")
    if not container.digest_fits(given.archive):
        raise RuntimeError("integrity check FAILED: archive has been tampered with")
    print("integrity check PASSED")


def listing(spark: SparkSession, given: argparse.Namespace) -> None:
    print(f"{'FILENAME':<40}  SIZE BUCKET\n{'--------':<40}  -----------")
    count = 0
    for row in unseal.listing(large.read_heads(spark, given.archive), given.password, given.iterations).orderBy("entry_ix").toLocalIterator():
        if row.err is None:
            print(f"{row.filename:<40}  {row.bucket_label}")
            count += 1
        else:
            log("ERROR", "entry failed", err=f"[{row.err.code}] {row.err.message}")
    print(f"\n{count} file(s)")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sealframe", description=__doc__)
    top.add_argument("--version", action="version", version="sealframe 1")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, password: bool = True) -> argparse.ArgumentParser:
        made = verbs.add_parser(name)
        made.set_defaults(run=run)
        if password:
            made.add_argument("-p", "--password", required=True)
            made.add_argument("--iterations", type=int, default=secrets.ITERATIONS)
        return made

    made = verb("archive", archive)
    made.add_argument("files", nargs="+")
    made.add_argument("-o", "--output", required=True)
    made.add_argument("--parallel", type=int, default=0)
    made.add_argument("--debug", action="store_true")
    made = verb("extract", extract)
    made.add_argument("-a", "--archive", required=True)
    made.add_argument("-o", "--output", default=".")
    made.add_argument("--debug", action="store_true")
    verb("verify", verify, password=False).add_argument("-a", "--archive", required=True)
    verb("list", listing).add_argument("-a", "--archive", required=True)
    return top


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    try:
        given.run(session(getattr(given, "parallel", 0)), given)
    except Exception as problem:
        print(problem, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
