import pytest

from sealframe.llm import mixing, queries
from tests.oracles import check, connect


def placed(spark, docs, weights, block_rows=1):
    return sorted(mixing.mix(docs, weights, block_rows).collect(), key=lambda r: (r.slot, r.place))


def test_oracle(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        check(queries.op9_mixing(spark, folder), connect(folder), queries.oracle_sql()["op9_mixing"])


@pytest.mark.parametrize("weights", [{"*": 1}, {"a": 1, "*": 1}, {"a": 5, "b": 3, "*": 2}, {"a": 7, "b": 7, "c": 7, "d": 1, "*": 1}, {f"s{i}": 1 + i * i % 13 for i in range(20)} | {"*": 9}, {"a": 99, "*": 1}])
def test_schedule_deviates_less_than_a_block(spark, weights):
    """At every slot, and each block between its release and its deadline."""
    rows = sorted(mixing.schedule(spark, weights).collect(), key=lambda r: r.slot)
    whole = sum(weights.values())
    assert [r.slot for r in rows] == list(range(whole))
    done = dict.fromkeys(weights, 0)
    for t, r in enumerate(rows):
        assert r.turn == done[r.lane] and r.units == weights[r.lane]
        assert r.turn * whole // r.units <= t < -(-(r.turn + 1) * whole // r.units)
        done[r.lane] += 1
        assert all(abs(done[x] - weights[x] * (t + 1) / whole) < 1 for x in weights)


def test_rows_are_interleaved(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(3000)], "doc_id bigint, source string")
    rows = placed(spark, docs, {"a": 5, "b": 3, "*": 2}, 10)
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    count = {"a": 0, "b": 0, "*": 0}
    for i, r in enumerate(rows[:1800], 1):
        count[r.lane] += 1
        if i % 10 == 0:
            assert all(abs(count[x] - w * i / 10) < 10 for x, w in (("a", 5), ("b", 3), ("*", 2)))


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0, "*": 1}, {"*": 1.5}, {"*": 20_000}])
def test_bad_weights(spark, weights):
    with pytest.raises(ValueError):
        mixing.schedule(spark, weights)


def test_tables(spark):
    rows = [(1, "a", "t", 1), (1, "a", "t", 1), (1, "b", None, 2), (None, "a", "x", 3), (None, "a", "y", 3), (None, None, None, None), (2, None, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, rank int")
    got = placed(spark, docs, {"a": 2, "*": 1})
    assert len(got) == 7 and len({(r.slot, r.place) for r in got}) == 7
    assert sorted(r.lane for r in got) == ["*"] * 3 + ["a"] * 4
    assert mixing.mix(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumnRenamed("rank", "Slot"))
    assert mixing.mix(docs.withColumnRenamed("rank", "slot"), made=("k", "l", "m", "n")).columns == ["doc_id", "source", "text", "slot", "k", "l", "m", "n"]


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, source string")
    text = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_every_source_has_a_lane(spark):
    """Ten sources without a weight, one of them hot: each keeps within a block of its part of the shared weight."""
    rows = [(i, f"src{i % 20}") for i in range(8000)] + [(8000 + i, "src15") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    weights = mixing.own_lanes(docs)
    assert sum(weights.values()) == 200 and weights["src0"] == 24 and weights["src10"] == weights["src15"] == weights["*"] == 7
    got = placed(spark, docs, weights, 8)
    assert sorted(r.doc_id for r in got) == list(range(16000))
    names = [f"src{i}" for i in range(20)]
    count = dict.fromkeys(names, 0)
    for i, r in enumerate(got[:3000], 1):
        count[r.source] += 1
        if i % 8 == 0:
            assert all(abs(count[x] - weights.get(x, weights["*"]) * i / 200) < 8 for x in names)


def test_own_lanes(spark):
    lanes = lambda *sources: mixing.own_lanes(spark.createDataFrame([(s,) for s in sources], "source string"), {"a": 1, "*": 1})
    assert lanes("a") == {"a": 1, "*": 1} == lanes("a", "b") == lanes(None)
    assert lanes("a", "b", "c", "c") == {"a": 2, "*": 1, "b": 1} and lanes("b", None) == {"a": 2, "*": 1, "b": 1}
    with pytest.raises(ValueError):
        lanes(*(f"s{i}" for i in range(5001)))
