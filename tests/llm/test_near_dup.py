import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sealframe.llm import bag_minhash, near_dup
from sealframe.llm.textstats import Texts

DIR = "/root/testdata/sf0.001"


def bag(text):
    words = text.encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def similarity(a, b):
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def brute(rows):
    """Connected components over all pairs; rows of one id are one node."""
    bags = {}
    for i, t in rows:
        if i is not None:
            bags.setdefault(i, []).append(bag(t or ""))
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(similarity(x, y) >= 0.8 for x in bags[a] for y in bags[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def classes_of(spark, rows):
    out = near_dup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    return {r.doc_id: r.class_id for r in out}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=2, max_size=5))
def test_shingles_and_overlap(batch):
    text, hashed, weight = bag_minhash.shingles(Texts(batch))
    got = [(hashed[text == i], weight[text == i]) for i in range(len(batch))]
    for (h, w), t in zip(got, batch, strict=True):
        assert sorted(w.tolist()) == sorted(bag(t).values()) and (np.diff(h.astype(object)) > 0).all()
    for i in range(len(batch)):
        assert abs(bag_minhash.overlap(got[0], got[i]) - similarity(bag(batch[0]), bag(batch[i]))) < 1e-12


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(60):
        a = rng.integers(0, 9, 50)
        b = np.where(rng.random(50) < 0.6, a, rng.integers(0, 9, 50))
        element = rng.integers(1, 1 << 62, 50).astype(np.uint64)
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        made = bag_minhash.signatures(text, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)
        off.append((made[0] == made[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03


def test_a_signature_is_its_text_alone():
    batch = ["a b c d e f g " * 30, "x y", "", "q w e r t y u i o p " * 3]
    whole = bag_minhash.signatures(*bag_minhash.shingles(Texts(batch)), 4, 140)
    for i, t in enumerate(batch):
        assert np.array_equal(bag_minhash.signatures(*bag_minhash.shingles(Texts([t])), 1, 140)[0], whole[i])
    assert not whole[2].any() and whole[0].all()


def test_tables_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert classes_of(spark, rows) == brute(rows)


def edited(rng, words, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def test_groups_around_a_centre(spark):
    """Near copies of one text that are mostly not similar to each other, the centre having the largest id."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, edited(rng, base, 0.018)) for i in range(70)] + [(500, " ".join(base))]
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    want = brute(rows)
    assert len({want[i] for i in range(70)}) < 25
    assert classes_of(spark, rows) == want


def test_pairs_among_texts_of_one_template(spark):
    """Texts with a shared body, mutually just under the threshold, and a few pairs over it that no hub is in."""
    rng = random.Random(1)
    body = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(body + [f"z{rng.randrange(10**6)}" for _ in range(42)])) for i in range(150)]
    for i in range(0, 120, 6):
        words = rows[i][1].split()
        rows[i + 1] = (i + 1, " ".join(words[:308] + [f"y{rng.randrange(10**6)}" for _ in range(34)]))
    want = brute(rows)
    assert sum(want[i] != i for i in want) == 20
    assert classes_of(spark, rows) == want


def test_cases(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same), (3, same.replace(" ", "\n")), (3, same), (8, "two words"), (9, "two  words"), (10, "words two"), (11, ""), (12, None), (13, " \n"), (None, same), (14, "x " * 40_000), (15, "x " * 45_000), (16, "x " * 20_000)]
    got = classes_of(spark, rows)
    assert got == {5: 3, 3: 3, 8: 8, 9: 8, 10: 10, 11: 11, 12: 12, 13: 13, None: None, 14: 14, 15: 14, 16: 16}


def test_keep_one(spark):
    same = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(5, same, "a", 1), (3, same, "b", 2), (3, same, "b", 2), (None, same, "c", 3), (7, "other words", None, None)], "doc_id bigint, text string, rep string, key int")
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.rep or "") for r in kept.collect()) == [(-1, "c"), (3, "b"), (7, "")]
    none = docs.where("false")
    assert near_dup.keep_one(none).count() == 0 and near_dup.classes(none.select("doc_id", "text")).count() == 0
