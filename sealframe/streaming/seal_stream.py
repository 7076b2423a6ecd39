"""Sealing a stream of files: every micro-batch becomes an archive of its own in a sealed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import secrets
from ..operators import seal

#: The schema of the built-in binary source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files of a folder (the source leaves out empty files and names that begin with '.' or '_')."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(folder)
    return found.select(F.col("path").alias("name"), "content", F.col("modificationTime").alias("mtime"), F.lit(0o644).alias("mode"))


def seal_stream(files: DataFrame, target: str, checkpoint: str, password: str, iterations: int = secrets.ITERATIONS, once: bool = True) -> StreamingQuery:
    """Seal a stream of files (name, content, mtime, mode) into the folder ``target``.

    A batch writes the partition of its own number, whole, so a batch that is run again replaces what it left.
    """
    secrets.check_password(password)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("archive_id", F.lit(f"batch-{number}")).withColumn("entry_ix", F.monotonically_increasing_id())
        seal.seal(rows.select(*seal.FILE_COLUMNS), password, iterations).write.mode("overwrite").parquet(f"{target}/batch={number}")

    started = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()
