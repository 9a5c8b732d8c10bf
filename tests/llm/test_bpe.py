"""Tokens equal to those of the public tokenizers library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import bpe
from tagloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())


def tokens(text):
    counts, ids = CODEC.encode([text])
    assert counts.tolist() == [len(ids)]
    return ids.tolist()


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert tokens(text) == want
    assert CODEC.decode(want) == text == LIBRARY.decode(want, skip_special_tokens=False)


PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "​", "a", "the", "ing", "É", "ß", "漢字", "é", "🙂", "1", "23", "²",
         "_", "...", "'s", "'LL", "<|endoftext|>", "<|endof", "\x00", "qxj", "tionnd", "thisat"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_mixed_parts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check(text)


def test_many_words_that_proposals_get_wrong():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    text = " ".join(words)
    check(text)
    wrong = [w for w in words if CODEC.proposed(w.encode()) != CODEC.merged(w.encode())]
    assert wrong


def test_long_words_and_bounded_memory(monkeypatch):
    check("a" * 5000 + "b" * 3000 + "ab" * 2000)
    monkeypatch.setattr(CODEC, "room", 2500)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 5)
    for i in range(30):
        check(f"word{i} the other{i}thing <|endoftext|>{i}")
        assert CODEC.held < 2500 + 10 * 250


def test_short_and_long_merging_agree():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("thandeiou") for _ in range(rng.randrange(2, 40))).encode()
        assert CODEC.merged(word) == CODEC._merged_long(word)


def test_invalid_bytes_decode_to_replacement():
    ids = tokens("é")
    half = [CODEC.letters[0xC3]]
    assert CODEC.decode(half) == "�" == LIBRARY.decode(half) and CODEC.decode(ids) == "é" and CODEC.decode([]) == ""


def test_edge_rows(spark):
    long = "thorre inatan " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (3, long, "x"), (3, long, "x"), (4, "<|endoftext|> \n", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((tuple(r) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()), key=str)
    want = sorted(((k, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for k, t, _ in rows), key=str)
    assert got == want
    assert sorted((tuple(r) for r in bpe.round_trip(df, PATH).collect()), key=str) == got
    assert bpe.encode(df.limit(0), PATH).collect() == [] == bpe.round_trip(df.limit(0), PATH).collect()
    nothing = spark.createDataFrame([(1, None)], "key bigint, ids array<int>")
    assert bpe.decode(nothing, PATH).first().text is None


def test_a_missing_vocabulary_fails(spark):
    with pytest.raises(OSError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), "/nowhere.json")


def test_query_against_the_library(spark, sf_dir):
    want = []
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((d.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded))))
    assert sorted(map(tuple, QUERIES["op8_bpe_round_trip"](spark, sf_dir).collect())) == sorted(want)
