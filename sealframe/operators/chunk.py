"""Variable-length chunks of binary content, laid out within the row: no shuffle, no explode.

Chunks have ``BASE`` bytes and a deviation each; empty content has no chunk, the last one may be short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secrets import VARIANCE

#: Fixed value of the format: the size of a chunk before its deviation.
BASE = 65_536


def most_chunks(size: Column, variance: int = VARIANCE, base: int = BASE) -> Column:
    """How many chunks content of this size can have at most."""
    return F.ceil(size / float(max(1, base - variance))).cast("int")


def layout(size: Column, deltas: Column, base: int = BASE) -> Column:
    """Chunks (``start`` from 0, ``length``) that cover ``size`` bytes, deviating by ``deltas`` in turn."""
    # The size goes along in the accumulator: named in the lambda, content would be read anew at every step.
    chunk = lambda acc, length: F.struct(
        acc["size"].alias("size"), (acc["at"] + length).alias("at"), F.concat(acc["made"], F.array(F.struct(acc["at"].alias("start"), length.alias("length")))).alias("made")
    )
    none = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")
    first = F.struct(size.cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("at"), none.alias("made"))
    step = lambda acc, delta: F.when(acc["at"] >= acc["size"], acc).otherwise(chunk(acc, F.least(F.greatest(F.lit(base) + delta, F.lit(1)).cast("bigint"), acc["size"] - acc["at"])))
    return F.aggregate(deltas, first, step, lambda acc: acc["made"])


def sliced(content: Column, chunk: Column) -> Column:
    return F.substr(content, (chunk["start"] + 1).cast("int"), chunk["length"].cast("int"))


def pieces(content: Column, laid: Column, made: Callable[[Column, Column], Column] = lambda piece, i: piece) -> Column:
    """``made`` of every chunk of ``content`` (and its number), as an array.

    The content is bound once, as an array's only element: a column named in the lambda would be copied out of
    its row for every chunk, which is quadratic in a file's size.
    """
    return F.transform(F.array(content), lambda whole: F.transform(laid, lambda c, i: made(sliced(whole, c), i)))[0]


def joined(parts: Column) -> Column:
    """The parts end to end, in linear time; null if one is null. (Bytes pass through strings unchecked.)"""
    text = F.array_join(F.transform(parts, lambda p: p.cast("string")), "").cast("binary")
    return F.when(F.forall(parts, lambda p: p.isNotNull()), text)


def chunks(df: DataFrame, deltas: Column, content: str = "content", base: int = BASE) -> DataFrame:
    """One row per chunk: the other columns of ``df``, ``block_ix`` and ``chunk``."""
    rest = [c for c in df.columns if c != content]
    laid = df.withColumn("_layout", layout(F.octet_length(content), deltas, base))
    return laid.select(*rest, F.posexplode(pieces(F.col(content), F.col("_layout"))).alias("block_ix", "chunk"))


def reassemble(chunked: DataFrame, keys: list[str], piece: str = "chunk", order: str = "block_ix") -> DataFrame:
    """Content from its chunks, by ``keys``. The chunks of one key meet in one row, which content bounds."""
    ordered = F.array_sort(F.collect_list(F.struct(order, piece)))
    return chunked.groupBy(*keys).agg(ordered.alias("_parts")).select(*keys, joined(F.col(f"_parts.{piece}")).alias("content"))
