import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sealframe.llm import bpe, pretokenize, token_counts
from sealframe.llm.merging import PairTable, merge_all, ragged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)
HARD = "aZ é1 2٣½'stmdrevl \n\t\r 　!?#.,-漢字ñ😀​\x1c\x85\x00"
texts = st.lists(st.text(alphabet=st.one_of(st.sampled_from(HARD), st.characters(exclude_categories=["Cs", "Cn"])), max_size=80), max_size=6)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts)
def test_pieces_are_the_matches(batch):
    found, first = pretokenize.pieces(batch)
    assert first.tolist() == np.cumsum([0, *(len(PATTERN.findall(t)) for t in batch)]).tolist()
    if not any(c in t for t in batch for c in map(chr, range(0x1C, 0x20))):  # regex counts these as white space
        assert found == [m.encode() for t in batch for m in PATTERN.findall(t)]


def test_long_scan():
    rng = random.Random(3)
    batch = ["".join(rng.choice(HARD.replace("\x1c", "")) for _ in range(n)) for n in (0, 700, 1, 5000, 511, 512, 513, 0)]
    assert pretokenize.pieces(batch)[0] == [m.encode() for t in batch for m in PATTERN.findall(t)]


def test_composition_table_is_closed():
    follow, _, extend, product, image = pretokenize.tables()
    assert extend.max() < len(image) and product.max() < len(image)
    assert follow.max() < pretokenize.STATES


@settings(max_examples=100, deadline=None)
@given(texts)
def test_ids(encoding, batch):
    ids, bounds = bpe.codec(RANKS).encode(batch)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoding.encode_ordinary(t) for t in batch]
    assert bpe.codec(RANKS).decode(ids, bounds) == [t.encode() for t in batch]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "漢" * 2000, "x" + "!" * 4000 + " " * 3000, "".join(random.Random(1).choice("abcdeinrst") for _ in range(3000))])
def test_long_pieces(encoding, text):
    ids, _ = bpe.codec(RANKS).encode(["", text, ""])
    assert ids.tolist() == encoding.encode_ordinary(text)
    lone = bpe.merge_long(text.encode(), bpe.codec(RANKS).ranks)
    assert b"".join(bpe.codec(RANKS).decode(np.array(lone), np.array([0, len(lone)]))) == text.encode()


def test_cache_starts_anew(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    coder = bpe.Codec(RANKS)
    for text in ("one two three four", "five six seven eight", "one nine"):
        assert coder.encode([text])[0].tolist() == encoding.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(texts)
def test_counts(batch):
    batch = [*batch, "a<|endoftext|>b  <|endoftext|><|endoftext|>", "<|endoftext", "it's"]
    library = Tokenizer.from_file(VOCABULARY)
    want = [len(x.ids) for x in library.encode_batch(batch, add_special_tokens=False)]
    assert token_counts.counter(VOCABULARY).count(batch) == want


@pytest.mark.parametrize("together", [False, True])
def test_merging_is_one_pair_at_a_time(together):
    """Against the plainest loop: find the lowest pair, merge its leftmost occurrence."""
    rng = random.Random(5)
    merges = [(0, 0), (0, 1), (3, 1), (4, 0), (3, 3)]
    rank = {m: i for i, m in enumerate(merges)}
    left, right = (np.array(x) for x in zip(*merges, strict=True))
    pairs = PairTable(left, right, np.arange(5, dtype=np.int32), np.arange(3, 8, dtype=np.int32))
    rows = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    want = []
    for row in map(list, rows):
        while best := min(((rank[p], i) for i, p in enumerate(zip(row, row[1:], strict=False)) if p in rank), default=None):
            row[best[1] : best[1] + 2] = [3 + best[0]]
        want.append(row)
    flat, sizes = merge_all(np.array([x for r in rows for x in r]), np.array([len(r) for r in rows]), pairs, together)
    ends = np.cumsum(sizes)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want
    assert ragged(np.arange(5), np.array([3, 0, 2]), np.array([2, 0, 1])).tolist() == [3, 4, 2]


ROWS = [(1, "Hello world's end", 5), (1, "Hello world's end", 5), (2, None, 6), (3, "", 7), (None, "x <|endoftext|>", 8), (4, "lang " * 3000, 9)]


def test_tables(spark, encoding):
    """Nulls, empty texts, repeated rows, and a column named like one that is made."""
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens int")
    made = bpe.encode(docs, RANKS, decoded=True, offsets=True).orderBy("doc_id", "n_tokens").collect()
    assert [r.n_tokens for r in made] == [len(encoding.encode_ordinary(t or "")) for _, t, _ in [ROWS[4], ROWS[0], ROWS[1], ROWS[2], ROWS[3], ROWS[5]]]
    one = next(r for r in made if r.doc_id == 1)
    ids = np.frombuffer(one.ids, "<u4").tolist()
    assert bytes(one.decoded) == ROWS[0][1].encode()
    starts = [*np.frombuffer(one.offsets, "<u4").tolist(), len(one.decoded)]
    assert [bytes(one.decoded[a:b]) for a, b in zip(starts, starts[1:], strict=False)] == [encoding.decode_single_token_bytes(i) for i in ids]
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).where("doc_id = 4").first()
    assert bytes(back.decoded).decode() == ROWS[5][1]
    digests = bpe.digests(docs, RANKS).where("doc_id = 3").first()
    assert digests.ids_sha256 == digests.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    assert counts[2] == counts[3] == (0, 0) and counts[None] == (15, 3) and counts[4][0] == 15_000
    for none in (bpe.encode(docs.where("false"), RANKS), token_counts.count_tokens(docs.where("false"), VOCABULARY)):
        assert none.count() == 0
