import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sealframe.llm import labelled, quality_ranker, quality_rules
from sealframe.llm.queries import op2_quality, op6_quality_rules
from sealframe.llm.textstats import Texts

DIR, SMALLEST = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, same = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


def counted(batch):
    of = Texts(batch)
    return list(zip(*(x.tolist() for x in (of.n_words, of.word_chars, of.n_symbols(), of.n_dup_lines()[0], of.n_repeat_words())), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b #|\xa0漢", max_size=60), max_size=6))
def test_counts(batch):
    assert counted(batch) == [brute(t) for t in batch]


def test_counts_of_long_words_and_texts():
    batch = ["word" * 50 + " " + "word" * 50 + "x " + "word" * 50, "a b c " * 40_000, "", "only"]
    assert counted(batch) == [brute(t) for t in batch]


GAPS = " \t\n\x0b\x0c\r"


def brute_features(text):
    """The ranker's features, one character and one word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(GAPS)]
    n_words, word_chars, _, same, repeated = brute(text)

    def kind(c):
        if c in GAPS:
            return "gap"
        if c in "!?":
            return "loud"
        if c in "#*$%&|<>":
            return "symbol"
        of = unicodedata.category(c)
        return {"Lu": "upper", "Lt": "upper", "Nd": "digit", "Po": "mark", "Pd": "mark", "Zs": "gap"}.get(of, "letter" if of in ("Ll", "Lo", "Lm", "Mn", "Mc") else "rest")

    count = Counter(map(kind, text))
    chars, most = max(len(text), 1), max(n_words, 1)
    shares = [count[k] / chars for k in ("digit", "symbol", "loud", "mark", "gap", "rest")]
    shares += [count["upper"] / max(count["upper"] + count["letter"], 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / most, sum(w[-1] in "#*$%&|<>" for w in words) / most, same / max(len(lines), 1), repeated / most]
    rest = [shares[-1] ** 2, math.log1p(n_words), math.log1p(word_chars / most), math.log1p(len(set(words))) / math.log(most + 2), math.log1p(len(text) / max(len(lines), 1)), float(n_words == 0)]
    return [*shares, *map(math.sqrt, shares), *rest]


HARD = st.lists(st.text(alphabet="abAB é\n\t\x0b #|$!?.,-1٣\xa0漢ǅ😀", max_size=60), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(HARD)
def test_features_against_brute_force(batch):
    assert quality_ranker.features(batch) == pytest.approx(np.array([brute_features(t) for t in batch]))


def test_scores_against_brute_force(spark):
    """The query's scores of all documents, from its model and features made one text at a time."""
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_ranker.fit(docs, labels)
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for r in op2_quality(spark, DIR).collect():
        z = [min(max((x - m) / s, -8), 8) for x, m, s in zip(brute_features(text[r.doc_id]), model.mean, model.scale, strict=True)]
        apart = sum(a * w for a, w in zip(z, model.weights, strict=True)) - model.threshold
        want = 1 / (1 + math.exp(-(apart / model.spread + math.log(0.7 / 0.3))))
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.predicted == (r.score >= 0.7) and (abs(apart) < 1e-9 or r.predicted == (apart >= 0))


def brute_buckets(text):
    """The regression's inputs: the share of each family's n-grams in every bucket, and the steps of repetition."""

    def bucket(mixed):
        mixed = ((mixed ^ (mixed >> 15)) * 0x9E3779B1) & 0xFFFFFFFF
        return mixed >> 22

    words = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    families = [words, [(a * 31 + b) & 0xFFFFFFFF for a, b in zip(words, words[1:], strict=False)]]
    for order in (1, 2, 3):
        found = []
        for i in range(len(text) - order + 1):
            mixed = 0
            for c in text[i : i + order]:
                mixed = ((mixed * 0x01000193) & 0xFFFFFFFF) ^ ord(c)
            found.append(mixed)
        families.append(found)
    out = []
    for found in families:
        count = Counter(map(bucket, found))
        out += [count[i] / len(found) if found else 0.0 for i in range(1024)]
    n_words, *_, repeated = brute(text)
    return out + [float(repeated / max(n_words, 1) >= s) for s in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)]


@settings(max_examples=50, deadline=None)
@given(HARD)
def test_buckets_against_brute_force(batch):
    assert quality_rules.features(batch) == pytest.approx(np.array([brute_buckets(t) for t in batch]))


def test_verdicts_against_brute_force(spark):
    """The query's verdicts on whole texts, from its model and buckets counted one n-gram at a time."""
    docs, labels = (spark.read.parquet(f"{SMALLEST}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit(docs, labels)
    text = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for r in op6_quality_rules(spark, SMALLEST).collect():
        raw = float(np.dot(brute_buckets(text[r.doc_id]), model.weights)) + model.bias
        want = 1 / (1 + math.exp(-(model.slope * raw + model.shift)))
        assert r.probability == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_calibration_against_brute_force():
    """Newton's steps end where a search over a fine grid finds the likeliest sigmoid."""
    rng = np.random.default_rng(5)
    raw = rng.normal(0, 2, 300)
    good = rng.random(300) < 1 / (1 + np.exp(-(0.7 * raw - 0.4)))
    n = good.sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (300 - n + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum()

    a, b = quality_rules.Regression._calibrate(raw, good)
    grid = min((loss(x, y), x, y) for x in np.arange(0.3, 1.2, 0.01) for y in np.arange(-1, 0.3, 0.01))
    assert loss(a, b) <= grid[0] + 1e-6 and abs(a - grid[1]) < 0.02 and abs(b - grid[2]) < 0.02


def test_many_distinct_words():
    batch = [" ".join(map(str, range(5000))) + " 1 2 3"]
    assert counted(batch) == [brute(batch[0])]


def made(n=400):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 60)) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(["alpha***", "beta###", "|", "$$$"], 60)) for _ in range(n)]
    return good + bad, np.array([1] * n + [0] * n)


def test_ranker_orders_pairs():
    batch, label = made()
    x = quality_ranker.features(batch)
    model = quality_ranker.Ranker(x[::2], label[::2])
    score = model.score(x[1::2])
    assert score[label[1::2] == 1].min() > score[label[1::2] == 0].max()
    assert ((score >= quality_ranker.THRESHOLD) == label[1::2]).mean() > 0.98
    assert score.min() >= 0 and score.max() <= 1


def steepest(model, x, good):
    """The steepest slope of the loss of all pairs, every pair listed."""
    z = model._scaled(x)
    at = z @ model.weights
    lost = 1 / (1 + np.exp(at[good][:, None] - at[~good][None, :]))
    return np.abs((lost.sum(0) @ z[~good] - lost.sum(1) @ z[good]) / lost.size + quality_ranker.PENALTY * model.weights).max()


def noisy(n=700, share=0.3):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, 6)) * [1, 10, 0.01, 1, 1, 0] + [0, 5, 0, 0, 0, 0.3]
    at = x @ [2, 0.1, 50, -1, 0, 0] + rng.normal(0, 1, n)
    return x, at > np.quantile(at, 1 - share)


def test_ranker_against_all_pairs():
    x, good = noisy()
    model = quality_ranker.Ranker(x, good.astype(int))
    assert steepest(model, x, good) < 1e-9
    at = model._raw(x)
    loss, slope, _ = model._at(lambda work: [work(iter([(x, good)]))], model.weights / 2, good.sum() * (~good).sum())
    half = at / 2
    want = np.logaddexp(0, half[~good][None, :] - half[good][:, None]).mean() + quality_ranker.PENALTY / 8 * (model.weights @ model.weights)
    assert loss == pytest.approx(want, abs=1e-11) and np.abs(slope).max() > 1e-4
    assert model.threshold == np.quantile(at, (~good).mean()) and model.spread == pytest.approx(at.std())


def test_ranker_in_parts():
    """Parts of one label or one row, tasks without rows, and equal rows at the threshold."""
    x, good = noisy(200)
    x, good = np.concatenate([x, np.repeat(x[:1], 90, 0)]), np.append(good, np.arange(90) % 2 == 0)
    whole = quality_ranker.Ranker(x, good.astype(int))
    order = np.argsort(good, kind="stable")
    tasks = [[], [order[:150]], [], [order[i : i + 1] for i in range(150, 290)]]
    model = quality_ranker.Ranker.over(lambda work: [work((x[i], good[i]) for i in task) for task in tasks])
    assert model.score(x) == pytest.approx(whole.score(x), abs=1e-7)
    assert model.threshold == np.quantile(model._raw(x), (~good).mean())


def test_ranker_learns_from_every_labelled_row(spark):
    """More labelled rows than the sample of 8,000 that was once drawn, few of them bad."""
    rng = np.random.default_rng(4)
    words = np.array(["Alpha", "beta,", "12", "of", "$$", "the.", "b#", "!"])
    of = [rng.choice(words, rng.integers(2, 12), p=[0.1, 0.2, 0.1, 0.3, 0.05, 0.2, 0.03, 0.02] if i % 20 else [0.1, 0.1, 0.1, 0.2, 0.2, 0.1, 0.1, 0.1]) for i in range(11_500)]
    texts = [" ".join(x) for x in of]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    told = [(i, int(i % 20 > 0)) for i in range(11_500)]
    model = quality_ranker.fit(docs, spark.createDataFrame(told, "doc_id bigint, quality int"))
    learnt = [i for i, _ in told if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learnt) > 8000
    x, good = quality_ranker.features([texts[i] for i in learnt]), np.array([told[i][1] == 1 for i in learnt])
    assert model.mean == pytest.approx(x.mean(0), rel=1e-12) and model.scale == pytest.approx(x.std(0) + 1e-6, rel=1e-9)
    assert steepest(model, x, good) < 1e-9
    assert model.threshold == np.quantile(model._raw(x), (~good).mean())


def test_ranker_does_not_read_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    one, two = (quality_ranker.fit(docs, x) for x in (labels, turned))
    assert one.weights == pytest.approx(two.weights, abs=1e-7) and one.threshold == pytest.approx(two.threshold, abs=1e-7)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_regression_is_calibrated():
    batch, label = made()
    flipped = np.where(np.random.default_rng(2).random(len(label)) < 0.2, 1 - label, label)
    x = quality_rules.features(batch)
    model = quality_rules.Regression(x[::2], flipped[::2])
    of = Texts(batch[1::2])
    chance = model.probability(of, of.n_repeat_words())
    assert abs(chance[label[1::2] == 1].mean() - 0.8) < 0.12 and abs(chance[label[1::2] == 0].mean() - 0.2) < 0.12


def test_one_label_only():
    x = quality_ranker.features(["a b", ""])
    assert quality_ranker.Ranker(x, np.array([1, 1])).score(x).tolist() == [1, 1]
    assert quality_ranker.Ranker(x[:0], np.array([])).score(x).tolist() == [0.5, 0.5]
    of = Texts(["a b", ""])
    assert quality_rules.Regression(x[:0], np.array([])).probability(of, of.n_repeat_words()).tolist() == [1, 1]


def test_batches_do_not_matter():
    batch, label = made(40)
    batch += ["", "é", "a b c a b c"]
    model = quality_rules.Regression(quality_rules.features(batch[:80]), label)
    of = Texts(batch)
    whole = model.probability(of, of.n_repeat_words())
    for i, text in enumerate(batch):
        one = Texts([text])
        assert model.probability(one, one.n_repeat_words())[0] == whole[i]
        assert np.array_equal(quality_ranker.features([text])[0], quality_ranker.features(batch)[i])


def test_held_out_accuracy(spark):
    scored = op2_quality(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    assert scored.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]
    told = scored[scored.held_out]
    assert len(told) > 50 and (told.predicted == told.quality).mean() > 0.97
    ruled = op6_quality_rules(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").toPandas()
    passed = ruled[~ruled.base_failed]
    assert (passed.kept == (passed.quality == 1)).mean() > 0.97
    docs = dict(map(tuple, spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()))
    for r in ruled.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_held_out_labels_are_not_read(spark):
    """Turning every held-out label around changes nothing."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    one, two = (labelled.sample(docs, x, quality_ranker.features, 500) for x in (labels, turned))
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])


def test_tables(spark):
    batch, label = made(30)
    rows = [(i, t, "x", 0.5) for i, t in enumerate(batch)] + [(0, batch[0], None, None), (None, "a", "y", 1.0), (900, None, "z", 2.0), (901, "", "z", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(q), None) for i, q in enumerate(label)] + [(None, 1, 1), (3, None, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    ranked = quality_ranker.rank(docs, labels)
    assert ranked.count() == len(rows) and ranked.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality_rules.apply_rules(docs, quality_rules.fit(docs, labels))
    assert kept.count() == len(rows) and kept.where("doc_id >= 900 and (kept or not base_failed)").count() == 0
    with pytest.raises(ValueError):
        quality_rules.apply_rules(docs.withColumnRenamed("source", "Kept"), quality_rules.fit(docs, labels), keep=("doc_id", "Kept"))
    none = docs.where("false")
    assert quality_ranker.rank(none, labels).count() == 0
    assert quality_rules.apply_rules(none, quality_rules.fit(none, labels.where("false"))).count() == 0
