import random
import re
from collections import Counter, defaultdict

import pytest

from sealframe.llm import line_templates, queries
from tests.oracles import check, connect

DIR = "/root/testdata/sf0.001"
OWN = ["The quick fox jumps over every fence today, one and all.", "Rivers run down to a sea that no one has ever seen.", "Bakers bake their bread before the sun is up at all.", "Clouds drift by and nobody looks up to see them go.", "Old maps show roads that were never built by anyone.", "Winter came late and stayed longer than we had hoped."]


def dropped(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in line_templates.drop_recurring(docs, **more).collect()}


def test_oracle(spark):
    check(queries.op3_line_templates(spark, DIR), connect(DIR), queries.oracle_sql()["op3_line_templates"])


@pytest.mark.parametrize(
    "line",
    [
        "Subscribe now",
        "Page {} of 20",
        "Posted on 2024-01-0{} by admin at 1{}:30 in the news section here",
        "Terms of use apply to everything on this site, says{} somebody we do not know",
    ],
)
def test_recurring_lines_go_but_the_first(spark, line):
    texts = [f"{o} {o}\n{line.format(i, i)}\nEnd number {o}" for i, o in enumerate(OWN)]
    got = dropped(spark, texts)
    assert got[0].text == texts[0]
    for i in range(1, 6):
        assert got[i].text == f"{OWN[i]} {OWN[i]}\nEnd number {OWN[i]}" and got[i].n_dropped == 1


NAMES = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fritz"]
TOWNS = ["berlin", "paris", "rome", "oslo", "bonn", "turin"]


@pytest.mark.parametrize(
    "line",
    [
        "Written by {0} for the daily paper of our small town",
        "The daily paper of our small town was founded by {0}",
        "User {0} logged in from {1}",
        "Sent by {0} from here",
        "This long notice tells all of the many readers that {0} has, since the last of our meetings, moved with the whole of the house to {1} for good",
    ],
)
def test_fields_vary(spark, line):
    got = dropped(spark, [f"{o} {o} {o}\n{line.format(n, t)}" for o, n, t in zip(OWN, NAMES, TOWNS, strict=True)])
    assert [r.n_dropped for r in got.values()] == [0, 1, 1, 1, 1, 1]


def test_unlike_lines_that_share_half_stay(spark):
    ends = ["rain fell on dry fields", "men built a stone bridge", "nobody spoke of it again", "two ships left for good", "all their books were burnt", "her name was soon forgotten"]
    got = dropped(spark, [f"{o}\nIn the years that followed {e}\n{e} in the years that followed" for o, e in zip(OWN, ends, strict=True)])
    assert all(r.n_dropped == 0 for r in got.values())


def test_templates_within_one_leaf(spark):
    """Two templates of one length and lead, one of them rare, and lines of neither."""
    texts = [f"{o}\nUser {n} logged in from {t}\nUser {n} has paid for {t}" for o, n, t in zip(OWN, NAMES, TOWNS, strict=True)] * 1
    texts += [f"{o[::-1]}\nUser {n[::-1]} logged in from {t[::-1]}" for o, n, t in zip(OWN, NAMES, TOWNS, strict=True)]
    got = dropped(spark, [*texts, "User guides are seldom ever read"])
    assert [got[i].n_dropped for i in range(13)] == [0, *[2] * 5, *[1] * 6, 0]


def brute(rows, min_docs=4):
    """Per document the lines that stay, by the rules of the docstring one line at a time."""
    parsed = {}
    for i, text in rows:
        for j, line in enumerate(text.split("\n")):
            tokens = [re.sub("[0-9].*", "<*>", t) for t in line.split()]
            if tokens:
                n, p = len(tokens), min(len(tokens), 12)
                at = [tuple(t for k, t in enumerate(tokens) if k * p // n == x) for x in range(p)]
                parsed[i, j] = (n, at, max(1, p // 4), line.strip())
    values = Counter((n, tuple(at[:lead]), x, at[x]) for n, at, lead, _ in parsed.values() for x in range(lead, len(at)))
    stands = defaultdict(set)
    keys = {}
    for (i, j), (n, at, lead, line) in parsed.items():
        made = list(at)
        if n >= 5:
            count = [values[n, tuple(at[:lead]), x, at[x]] for x in range(lead, len(at))]
            usual = sorted(count, reverse=True)[len(at) - min(2, len(at) // 3) - lead - 1]
            made[lead:] = [None if 2 * c < usual else v for c, v in zip(count, at[lead:], strict=True)]
        keys[i, j] = [(min_docs, n, tuple(made))] + [(2, line)] * (n >= 20)
        for key in keys[i, j]:
            stands[key].add(i)
    gone = {x for x, own in keys.items() if any(len(stands[k]) >= k[0] and x[0] != min(stands[k]) for k in own)}
    return {i: "\n".join(line for j, line in enumerate(text.split("\n")) if (i, j) not in gone) for i, text in rows}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shapes = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)] for n in (3, 5, 6, 8, 12, 14, 22, 30)]

    def line():
        words = list(rng.choice(shapes))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice("pqrstuv") * rng.randrange(1, 4) + rng.choice(["", "", str(rng.randrange(9))])
        return "  " * rng.randrange(2) + " ".join(words) + rng.choice(["", "\f"])

    rows = [(i, "\n".join(rng.choice([line(), line(), ""]) for _ in range(rng.randrange(9)))) for i in range(80)]
    got = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.text for r in got} == want and 50 < sum(r.n_dropped for r in got)


def test_few_documents_are_left_alone(spark):
    got = dropped(spark, [f"{o} {o}\nSubscribe now" for o in OWN[:3]])
    assert all(r.n_dropped == 0 for r in got.values())


def test_other_lines_stay(spark):
    assert all(r.n_dropped == 0 for r in dropped(spark, [f"{o}\n\n{o[::-1]}" for o in OWN]).values())


def test_copies_lose_all_but_their_own(spark):
    copy = "\n".join(OWN)
    got = dropped(spark, [copy] * 5 + [f"{copy}\nAnd a last word"])
    assert [r.text for r in got.values()] == [copy, "", "", "", "", "And a last word"]


def test_common_line(spark):
    """A line in every document, joined by broadcast, and positions first, last and side by side."""
    texts = [f"Top line\nTop line\n{' '.join([f'w{chr(97 + i % 26)}{chr(97 + i // 26)}'] * 9)}\nTop line" for i in range(200)]
    got = dropped(spark, texts)
    assert all(r.text == texts[i].split("\n")[2] and r.n_dropped == 3 for i, r in got.items() if i)


@pytest.mark.parametrize("more", [{}, {"keep_copies": True}])
def test_tables(spark, more):
    rows = [(None, "Top line here\n" + OWN[0], "a", 1), (1, None, "a", 1), (2, "", None, None), (3, "\n \n", "b", 2)]
    rows += [(i, f"Top line here\n{OWN[i - 4]}", "c", 3) for i in (4, 5, 6, 6)] + [(9, "Top line here\nsomething else that is not short at all " * 1, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, hash string, words int")
    out = line_templates.drop_recurring(docs, made=("x1", "x2"), **more)
    assert out.columns == ["doc_id", "text", "hash", "words", "x1", "x2"] and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].text is None and got[2][0].text == "" and got[3][0].text == "\n \n"
    assert got[4][0].text.startswith("Top line here") and [r.text for r in got[6]] == [OWN[2]] * 2 and got[None][0].text == (got[4][0].text if more else OWN[0])
    assert line_templates.drop_recurring(docs.where("false"), **more).count() == 0
    with pytest.raises(ValueError):
        line_templates.drop_recurring(docs.withColumnRenamed("words", "N_Lines"))


def test_long_text(spark):
    lines = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} own words in a line" for i in range(5000)]
    text = "\n".join(lines[:2500] + ["Top line here"] + lines[2500:])
    got = dropped(spark, ["Top line here\n" + o * 3 for o in OWN] + [text])
    assert got[6].text == "\n".join(lines)


def all_dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r for r in line_templates.drop_recurring(docs, keep_copies=True).collect()}


def test_boilerplate_heavy_documents_lose_it(spark):
    line = "Subscribe now to the weekly letter of this small paper"
    got = all_dropped(spark, [f"{o}\n{line}" for o in OWN] + [f"{line}\nmine {w}" for w in ("one", "two")])
    assert [got[i].text for i in (1, 5, 6, 7)] == [OWN[1], OWN[5], "mine one", "mine two"]


def test_near_copies_stay_whole(spark):
    """And equal texts stay equal."""
    copy = "\n".join(f"{o} {o[::-1]} {o}" for o in OWN)
    near = copy.replace("Winter", "Summer", 1)
    got = all_dropped(spark, [copy] * 3 + [near])
    assert [got[i].text for i in range(4)] == [copy] * 3 + [near]


def test_long_lines_in_two_documents(spark):
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(52))
    other = ["\n".join(OWN[:3]) + "\n" + " ".join(w[::-1] for w in " ".join(OWN).split()), "\n".join(OWN[3:]) + "\n" + " ".join(w[1:] + "x" for w in " ".join(OWN).split())]
    got = all_dropped(spark, [f"{other[0]}\n{passage}", f"{other[1]}\n{passage}", f"{OWN[0][::-1]}\nSubscribe now", f"{OWN[1][::-1]}\nSubscribe now"])
    assert got[0].n_dropped == got[2].n_dropped == got[3].n_dropped == 0 and got[1].text == other[1]
