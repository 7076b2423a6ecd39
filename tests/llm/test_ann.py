import numpy as np
import pytest
from pyspark.sql import functions as F

from sealframe.llm import ann, queries
from tests.oracles import check, connect


def brute(rows, k=5, every=50):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, v in fine:
        if i % every == 0:
            found = sorted((-ann.cosines(v[None], w[None])[0], j) for j, w in fine if j != i and len(w) == len(v))
            out |= {(i, r + 1, j, round(-s, 12)) for r, (s, j) in enumerate(found[:k])}
    return out


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.search(table, F.col("vec_id") % 50 == 0, **more).collect()
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in got}


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, folder):
    check(queries.op5_ann(spark, folder), connect(folder), queries.oracle_sql()["op5_ann"])


@pytest.mark.parametrize("size", [3, 64, 100])
def test_recall(spark, size):
    """Random vectors are the hardest: nothing is near."""
    rng = np.random.default_rng(size)
    rows = single((i, rng.standard_normal(size).tolist()) for i in range(3000))
    want, got = brute(rows), found(spark, rows)
    pairs = lambda x: {(q, v) for q, _, v, _ in x}
    assert len(got) == len(want) and len(pairs(got) & pairs(want)) / len(want) >= 0.97


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(1)
    unit = rng.standard_normal((2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes, scalar = ann.encode(unit)
    assert codes.shape == (2000, 8)
    guess, bound = ann.estimate(unit[:50] @ ann.rotation(64), codes, scalar)
    off = guess - unit[:50] @ unit.T
    assert (np.abs(off) <= bound).mean() > 0.99 and abs(off.mean()) < 0.01


def test_cases(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(0, one), (7, one), (3, one), (3, one), (1, [-1.0, -2.0, -2.0]), (2, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 1.0]), (6, [float("nan"), 1.0, 1.0])]
    rows += [(8, [float("inf"), 1.0, 1.0]), (None, one), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (9, [])]
    assert found(spark, rows) == {(0, 1, 3, 1.0), (0, 2, 3, 1.0), (0, 3, 7, 1.0), (0, 4, 1, -1.0)}
    assert found(spark, rows[:0] + [(None, None)]) == set()


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    rows = single([(i, [1.0] * 8) for i in range(0, 4000, 2)] + [(i, rng.standard_normal(8).tolist()) for i in range(1, 1000, 2)])
    assert found(spark, rows) == brute(rows)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 200)
    monkeypatch.setattr(ann, "CHUNK", 13)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 16))
    rows = single((i, (centre[i % 5] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2500))
    assert len(found(spark, rows) & brute(rows)) / len(brute(rows)) > 0.97
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2), "block": F.lit(3)})
    assert ann.search(table, F.col("vec_id") % 50 == 0).count() == 250
