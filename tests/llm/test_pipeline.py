import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sealframe.llm import bpe, mixing, near_dup, queries

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])
    assert steps[-1].columns == ["doc_id", "source", "n_tokens", "ids", "round_trip", "slot", "place"]


def test_quality(spark, steps):
    ranked = {r.doc_id: r.predicted for r in queries.op2_quality(spark, DIR).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, p in ranked.items() if p}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    told = [(labels[i] == 1) == bool(p) for i, p in ranked.items() if i in labels]
    assert sum(told) / len(told) > 0.95


def test_lines(steps):
    before = {r.doc_id: r for r in steps[1].collect()}
    after = {r.doc_id: r for r in steps[2].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        lines = iter(before[i].text.split("\n"))
        assert all(line in lines for line in r.text.split("\n")) and r.n_chars == len(r.text)


def test_near_duplicates(spark, steps):
    named = {r.doc_id: r.class_id for r in near_dup.classes(steps[2]).collect()}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(named.values()))


def test_mixing_and_ids(steps):
    mixed = steps[4].collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in steps[3].collect())
    assert len({r.source for r in mixed[:40]}) > 1
    last = {r.doc_id: r for r in steps[5].collect()}
    assert len(last) == len(mixed) and all(r.round_trip for r in last.values())
    coder = bpe.codec(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    for r in mixed[:20]:
        assert bytes(last[r.doc_id].ids) == coder.encode([r.text])[0].astype("<u4").tobytes()


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, DIR)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in steps[-1].collect())


def test_run_keeps_the_mixed_order(spark, steps):
    got = sorted(corpus_pipeline.run(spark, DIR).select("doc_id", "slot", "place").collect(), key=lambda r: (r.slot, r.place))
    assert len({(r.slot, r.place) for r in got}) == len(got)
    placed = mixing.mix(steps[4], mixing.own_lanes(steps[4])).collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(placed, key=lambda r: (r.slot, r.place))]


def test_prefixes_hold_the_target_shares(spark, tmp_path, monkeypatch):
    """Through ``run``, over several files, with the two stages that place rows and encode them."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 20).alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).select("slot", "place", "source").collect(), key=lambda r: (r.slot, r.place))
    weights = mixing.own_lanes(docs)
    names, whole = [f"src{i}" for i in range(20)], sum(weights.values())
    count = dict.fromkeys(names, 0)
    for i, r in enumerate(got[:4800], 1):
        count[r.source] += 1
        if i % mixing.BLOCK_ROWS == 0:
            assert all(abs(count[x] - weights.get(x, weights["*"]) * i / whole) < mixing.BLOCK_ROWS for x in names)


def test_stages_on_hard_rows(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and a table without rows."""
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, "word " * 30_000, "en", "src1", 1), (2, "word " * 30_000, "en", "src1", 1), (3, "short", None, None, None)]
    rows += [(10 + i, f"A line in all of them\nand own words {chr(97 + i) * 5} that no other text here has at all", "en", "src2", 1) for i in range(6)]
    hard = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"made_0": F.lit(1), "Made_1": F.lit("x"), "slot": F.lit(2), "hash": F.lit(3)})
    for table in (hard, hard.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DIR)
            kept = out.count()
            assert kept <= table.count()
            if name in ("line_dedup", "mixing", "bpe"):
                assert kept == table.count()
    kept = corpus_pipeline.without_near_duplicates(spark, hard, DIR)
    assert {r.doc_id for r in kept.collect()} >= {None, 1, 2, 3} and kept.count() == 10
