"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, html_extract, line_templates, mixing, near_dup, quality_ranker, quality_rules, token_counts
from .common import table

#: Rows of op10 over this many tokens are marked.
TOKEN_LIMIT = 512


#: op5 takes every so many-th vector as a query, and returns so many neighbours.
NEIGHBOUR_QUERIES, NEIGHBOURS = 50, 5

#: A conversation whose texts hold the template's own control strings.
HARD_CONVERSATION = -7
HARD_TEXT = "\\### Assistant: </turn> ok"


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ranker.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % NEIGHBOUR_QUERIES == 0, NEIGHBOURS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD_CONVERSATION).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    events = rows.unionByName(hard).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("event"), F.lit(None).cast("string").alias("message"), "role", "text")
    return chat.digests(chat.format_conversations(events))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A hash stands for the text: only the order of equal and null ids asks for it.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))
    return mixing.mix(docs).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_quality": op2_quality,
        "op3_line_templates": op3_line_templates,
        "op4_bpe": op4_bpe,
        "op5_ann": op5_ann,
        "op6_quality_rules": op6_quality_rules,
        "op7_near_dup": op7_near_dup,
        "op8_chat": op8_chat,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
    }


#: DuckDB SQL of op8: what reading the formatted conversations back must give.
OP8_SQL = r"""
WITH texts AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS body FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT
    conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(body, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(role) + length(body)
        + len(regexp_extract_all(body, '\\|###|</turn>'))
        + len(regexp_extract_all(role, '\\|###|</turn>|:'))) AS BIGINT) AS formatted_chars
FROM texts
GROUP BY conv_id
"""


#: DuckDB SQL of op5: the exact neighbours.
OP5_SQL = f"""
SELECT query_id, rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, v.vec_id, score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS INTEGER) AS rank
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % {NEIGHBOUR_QUERIES} = 0) q
    JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v ON q.vec_id <> v.vec_id,
    LATERAL (SELECT list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score)
) WHERE rank <= {NEIGHBOURS}
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ann": OP5_SQL, "op3_line_templates": line_templates.oracle_sql(), "op8_chat": OP8_SQL, "op9_mixing": mixing.oracle_sql()}
