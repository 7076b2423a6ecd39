"""Interleaving sources to target weights by Pfair scheduling, with DataFrame operations only.

Every source is a lane (sources without a weight of their own share one, or with ``own_lanes`` have
one each), and its rows, in an
order hashed from their ids, form blocks. With u of W units of weight, a lane's k-th block may be
released at slot floor(k*W/u) and is due by slot ceil((k+1)*W/u); at every slot the released block
with the earliest deadline goes next. Such a schedule repeats every W slots and keeps every lane
within less than one block of its weight at any time. So one period, W slots long whatever the
data, is folded in SQL, and every row finds its slot from its rank in its lane.

Ranks come from counts of hash ranges within lanes (aggregated before they are shuffled) and a
window within each range, so no lane has to pass through one task.

Cases: every row gets a place, none is dropped or repeated; when a lane runs out, its later slots stay
empty and the others keep their order; a null source falls to the shared lane; null ids are ordered
by their text, where there is one; rows with equal ids follow each other by source and text; empty
texts are rows like any other; an empty table gives an empty result; all columns are kept, and
columns made here are named by ``made``, which must not clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Name of the lane of all sources without a weight of their own.
SHARED = "*"
#: Target weights, in units.
WEIGHTS = {"src0": 12, "src1": 9, "src2": 8, "src3": 7, "src4": 6, "src5": 5, "src6": 5, "src7": 5, "src8": 4, "src9": 4, SHARED: 35}
#: Rows of a block.
BLOCK_ROWS = 32
#: Ranges of the hash within a lane that are ranked apart.
RANGES = 4096
#: A period has at most this many slots, so its table is small enough to broadcast.
MOST_UNITS = 10_000
MADE = ("lane", "block", "slot", "place")


def own_lanes(docs: DataFrame, weights: dict[str, int] = WEIGHTS) -> dict[str, int]:
    """``weights`` for which every source of ``docs`` has a lane to itself: those without a weight of their own get equal
    parts of the shared lane's. The shared lane keeps one of them: null where it occurs, else the last by name.

    All units are multiplied to stay whole, and MOST_UNITS bounds their sum, so with weights of 100 in all there may be
    100 such sources; more of them are an error.
    """
    if SHARED not in weights or any(not isinstance(u, int) or u < 1 for u in weights.values()):
        raise ValueError(f"weights are whole numbers from 1, with one for '{SHARED}'")
    own = [x for x in weights if x != SHARED]
    kept = docs.select(F.col("source").cast("string").alias("source")).where(F.col("source").isNull() | ~F.col("source").isin(own))
    found = [r.source for r in kept.distinct().limit(MOST_UNITS + 1).collect()]
    others = sorted(x for x in found if x is not None)
    parts = max(1, len(found))
    units = {x: u * parts for x, u in weights.items()}
    if parts > 1:
        # A source of the shared lane's own name has that lane.
        pooled = None if None in found else SHARED if SHARED in others else others[-1]
        units |= {x: weights[SHARED] for x in others if x not in (pooled, SHARED)}
        units[SHARED] = weights[SHARED] * (2 if None in found and SHARED in others else 1)
    least = math.gcd(*units.values())
    units = {x: u // least for x, u in units.items()}
    if sum(units.values()) > MOST_UNITS:
        raise ValueError(f"{len(found)} sources without a weight of their own need a period of {sum(units.values())} slots, over {MOST_UNITS}")
    return units


def schedule(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """One period: the slot of each lane's j-th block, with the lane's units."""
    names, units = list(weights), list(weights.values())
    if SHARED not in weights or any(not isinstance(u, int) or u < 1 for u in units) or sum(units) > MOST_UNITS:
        raise ValueError(f"weights are whole numbers from 1, {MOST_UNITS} in all at most, with one for '{SHARED}'")
    whole, lanes = sum(units), len(units)
    row = spark.range(1).select(F.array(*map(F.lit, units)).alias("units"), F.array(*map(F.lit, names)).alias("names"))
    # Each lane's next block as deadline * lanes + lane; blocks not yet released are left out.
    due = f"cast(ceil((c + 1) * {whole}L / units[i]) as bigint) * {lanes} + i"
    released = f"(pair.c * {whole}L) div units[pair.i] <= t"
    pick = f"array_min(transform(filter(transform(acc.done, (c, i) -> struct(c, i, {due} as due)), pair -> {released}), pair -> pair.due)) % {lanes}"
    fold = f"""
        aggregate(
            sequence(0, {whole - 1}),
            struct(transform(units, u -> 0L) as done, cast(array() as array<bigint>) as picked),
            (acc, t) -> aggregate(
                array({pick}),
                acc,
                (state, lane) -> struct(transform(state.done, (c, i) -> if(i = lane, c + 1, c)) as done, concat(state.picked, array(cast(lane as bigint))) as picked)
            ),
            acc -> acc.picked
        )"""
    slots = row.select("names", "units", F.posexplode(F.expr(fold)).alias("slot", "at"))
    lane, unit = F.element_at("names", (F.col("at") + 1).cast("int")), F.element_at("units", (F.col("at") + 1).cast("int"))
    turn = F.row_number().over(W.partitionBy("at").orderBy("slot")) - 1
    return slots.select(lane.alias("lane"), unit.cast("bigint").alias("units"), turn.cast("bigint").alias("turn"), F.col("slot").cast("bigint").alias("slot"))


def _order(docs: DataFrame) -> Column:
    """The first 12 hexadecimal digits of the md5 of the id, as a number."""
    named = F.col("doc_id").cast("string")
    rest = F.concat(F.lit("null "), F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit("null")
    return F.conv(F.substring(F.md5(F.coalesce(named, rest).cast("binary")), 1, 12), 16, 10).cast("bigint")


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, made: tuple[str, str, str, str] = MADE) -> DataFrame:
    """All rows of ``docs`` with their lane, block in the lane, slot in the schedule and place in the
    block; in mixed order these are sorted by slot and place."""
    if clash := {c.lower() for c in made} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    given = docs.columns
    own = [x for x in weights if x != SHARED]
    whole = sum(weights.values())
    lane = F.when(F.col("source").isin(own), F.col("source")).otherwise(F.lit(SHARED))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), lane.alias("lane"), _order(docs).alias("hash"))
    keyed = keyed.withColumn("range", F.expr(f"hash div {2**48 // RANGES}L"))
    counts = keyed.groupBy("lane", "range").agg(F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("lane").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("lane", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    ties = [F.col(f"row.{c}") for c in ("doc_id", "source", "text") if c in given]
    within = F.row_number().over(W.partitionBy("lane", "range").orderBy("hash", *ties)) - 1
    ranked = keyed.withColumn("within", within).join(before, ["lane", "range"]).withColumn("rank", F.col("before") + F.col("within"))
    period = schedule(docs.sparkSession, weights)
    # One row for each lane, and one for each slot of the period: bounded by the weights.
    units = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    placed = (
        ranked.withColumn("block", F.expr(f"rank div {block_rows}"))
        .withColumn("units", F.element_at(units, F.col("lane")).cast("bigint"))
        .withColumn("turn", F.col("block") % F.col("units"))
        .join(F.broadcast(period.drop("units")), ["lane", "turn"])
    )
    values = ("lane", "block", F.expr(f"(block div units) * {whole} + slot"), F.col("rank") % block_rows)
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in given), *((F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, made, strict=True)))


def oracle_sql(weights: dict[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS, docs: str = "documents") -> str:
    """DuckDB SQL of ``mix`` with the columns doc_id, source and ``MADE``."""
    whole, lanes = sum(weights.values()), len(weights)
    named = ", ".join(f"({i}, '{x}', {u})" for i, (x, u) in enumerate(weights.items()))
    units = list(weights.values())
    own = ", ".join(f"'{x}'" for x in weights if x != SHARED)
    return f"""
WITH RECURSIVE lanes(lane_ix, lane, units) AS (VALUES {named}),
simulated(t, done, picked) AS (
    SELECT 0, {[0] * lanes}::BIGINT[], -1
    UNION ALL
    SELECT t + 1, list_transform(range({lanes}), lambda i: done[i + 1] + CAST(i = pick AS BIGINT)), pick
    FROM (
        SELECT t, done, CAST(list_min(list_transform(
            list_filter(range({lanes}), lambda i: (done[i + 1] * {whole}) // {units}[i + 1] <= t),
            lambda i: (((done[i + 1] + 1) * {whole} + {units}[i + 1] - 1) // {units}[i + 1]) * {lanes} + i)) % {lanes} AS INTEGER) AS pick
        FROM simulated WHERE t < {whole}
    )
),
period AS (
    SELECT lane, units, t - 1 AS slot, row_number() OVER (PARTITION BY lane ORDER BY t) - 1 AS turn
    FROM simulated JOIN lanes ON lane_ix = picked
),
ranked AS (
    SELECT doc_id, source, lane, row_number() OVER (PARTITION BY lane ORDER BY hash, doc_id, source) - 1 AS rank
    FROM (
        SELECT doc_id, source, CASE WHEN source IN ({own}) THEN source ELSE '{SHARED}' END AS lane,
            CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS hash
        FROM {docs}
    )
)
SELECT doc_id, source, r.lane, rank // {block_rows} AS block,
    CAST((rank // {block_rows}) // units * {whole} + slot AS BIGINT) AS slot, rank % {block_rows} AS place
FROM ranked r JOIN period p ON r.lane = p.lane AND (rank // {block_rows}) % units = turn
"""
