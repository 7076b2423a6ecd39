"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, and byte-level BPE.

Every stage takes all rows that the stage before it kept, and what it decides takes effect: rejected
documents go, recurring lines go, of near duplicates one document stays, rows take their mixed order,
and in the end every text is encoded and stands with its slot and place in the mixed order.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealframe.llm import bpe, line_templates, mixing, near_dup, quality_ranker

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_runs = itertools.count()


def _fresh(docs: DataFrame, count: int) -> list[str]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return list(itertools.islice((n for n in map("made_{}".format, itertools.count()) if n not in taken), count))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the ranker's threshold."""
    model = quality_ranker.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (made,) = _fresh(docs, 1)
    scored = quality_ranker.score(docs, model, keep=tuple(docs.columns), made=made)
    return scored.where(F.col(made) >= quality_ranker.THRESHOLD).drop(made)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents."""
    cleaned = line_templates.drop_recurring(docs, made=tuple(_fresh(docs, 2)), keep_copies=True)
    columns = [F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.select(columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves their sources to the target weights."""
    made = _fresh(docs, 4)
    return mixing.mix(docs, mixing.own_lanes(docs), made=tuple(made)).orderBy(*made[2:]).drop(*made)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its ids, whether they decode to its text, and its slot and place in the mixed order. A table read again does
    not come in the order of its files, so these are laid anew: the same rows always get the same ones."""
    made = _fresh(docs, 4)
    placed = mixing.mix(docs, mixing.own_lanes(docs), made=tuple(made))
    coded = bpe.encode(placed, public_tokenizers.path(VOCABULARY), keep=("doc_id", "source", "text", *made[2:]), decoded=True)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "n_tokens", "ids", whole.alias("round_trip"), F.col(made[2]).alias("slot"), F.col(made[3]).alias("place"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The ranker's fit and the tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each is written to the shared folder and read again by the next, after which it goes.
    Sorted by ``slot`` and ``place`` the result is in mixed order."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corpus-pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{next(_runs)}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        if before is not None:
            _remove(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
