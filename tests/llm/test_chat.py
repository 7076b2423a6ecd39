import datetime
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sealframe.llm import chat, queries
from tests.oracles import check, connect

words = st.text(alphabet=st.sampled_from("\\#</turn>: \nab"), max_size=30) | st.sampled_from(["###", "</turn>", "\\### assistant: </turn>\n", "</turn>\n### user: "])
SCHEMA = "conv_id bigint, seq bigint, event string, message string, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words | st.just("assistant"), words), max_size=6))
def test_reads_back(messages):
    formatted, starts, lengths = chat.render(messages)
    assert chat.read_back(formatted) == messages
    assert [chat.unescape(formatted[a : a + n]) for a, n in zip(starts, lengths, strict=True)] == [t for r, t in messages if r == "assistant"]


def test_fold():
    events = [
        ("message", "1", "user", "hel"),
        ("delta", "1", "user", "lo"),
        ("delta", "2", "assistant", "a"),
        ("delta", "2", "assistant", "b"),
        ("message", "3", "user", "late"),
        ("regenerate", "2", "assistant", ""),
        ("delta", "2", "assistant", "new"),
        ("edit", "1", "", "HELLO"),
        ("message", None, "user", "x"),
        ("message", None, "user", "x"),
        ("message", "3", "user", "again"),
    ]
    assert chat.fold(iter(events)) == [("user", "HELLO"), ("assistant", "new"), ("user", "x"), ("user", "x"), ("user", "again")]


def test_oracle(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        check(queries.op8_chat(spark, folder), connect(folder), queries.oracle_sql()["op8_chat"])


def test_tables(spark):
    rows = [(1, 2, "delta", "m", "assistant", "b"), (1, 1, "delta", "m", "assistant", "a"), (2, 1, None, None, None, None), (None, 1, "message", None, "user", "n"), (1, 2, "delta", "m", "assistant", "b")]
    rows += [(3, i, "message", None, "user", "é" * 1000) for i in range(3000)]
    events = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(events.selectExpr("*", "1 as formatted", "2 as conv"))
    got = {r.conv_id: r.formatted for r in made.collect()}
    assert set(got) == {1, 2, 3, None}
    assert chat.read_back(got[1]) == [("assistant", "abb")] and chat.read_back(got[2]) == [("", "")] and len(chat.read_back(got[3])) == 3000
    told = {r.conv_id: r for r in chat.digests(made).collect()}
    assert told[3].n_turns == 3000 and told[3].loss_chars == 0 and told[1].loss_chars == 3 and told[1].formatted_chars == len(got[1])
    assert chat.digests(chat.format_conversations(events.where("false"))).count() == 0


def test_many_conversations_of_one_task(spark):
    rows = [(i % 5000, i, "message", None, "assistant", f"t{i}") for i in range(15_000)]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert len(got) == 5000
    assert all(chat.read_back(r.formatted) == [("assistant", f"t{r.conv_id + 5000 * k}") for k in range(3)] for r in got)


@pytest.mark.parametrize("kind,ids", [("smallint", [3, 4]), ("int", [3, 4]), ("string", ["a", "b"]), ("binary", [b"a", b"b"]), ("date", [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)]), ("decimal(20,3)", [decimal.Decimal("1.500"), decimal.Decimal(2)])])
def test_ids_of_any_type(spark, kind, ids):
    rows = [(i, k, "message", None, "assistant", f"{n}{k}") for n, i in enumerate([*ids, None]) for k in range(2)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA.replace("conv_id bigint", f"conv_id {kind}")))
    got = {bytes(r.conv_id) if kind == "binary" and r.conv_id is not None else r.conv_id: chat.read_back(r.formatted) for r in made.collect()}
    assert got == {i: [("assistant", f"{n}0"), ("assistant", f"{n}1")] for n, i in enumerate([*ids, None])}
    assert chat.digests(made).count() == 3
