"""Packing against the tokenizers library and against all ways to cut."""

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import packing
from tagloom.llm.packing import Costs
from tagloom.llm.queries import op12_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, texts, library, capacity, end=2):
    """Every token of every document once and in order, sequences gapless and bounded; the share of padding."""
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["start"], r["doc_id"]))
    assert set(documents) == set(texts)
    for key, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, end], 0
        for r in sorted(documents[key], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes())) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        size = 0
        for offset, length, _, _ in sorted(pieces):
            assert offset == size
            size += length
        assert size <= capacity
        padding += Costs(capacity).padding(size)
        keys = [(p[3] is not None, p[3]) for p in sorted(pieces)]
        assert keys == sorted(keys)
    return padding / (len(sequences) * capacity)


ODD = [
    None, "", " ", "\n\n", "\t", "Hi. There!", "a" * 5000, "x. " * 9000, "no end " * 6000, "naïve café, N̈o̸ Áb İ", "<|endoftext|>a <|startoftext|> b<|endoftext|>",
    "日本語。テスト！", "it's they're I'LL 'Tis 12345   x\u0085y\u001cz​w", "İSTANBUL ΣΑΣ ΟΔΟΣ", "🙂🙂 á̧", "\x00\x01 \x7f", "é\ńe", "a" * 99 + " " + "b" * 101 + ".\n" + "c" * 101,
]


def encoded(words, texts):
    return words.encode(*packing._bytes(pa.array(["skipped", *texts], pa.string())[1:]))


def test_pieces_give_the_library_s_tokens(library):
    words = packing.Words(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    marks = [*" \n\t\r.,!?'\"<|>aAbzé̸́ 　中0٣İΣß🙂", "<|endoftext|>", "'s", "word", "x" * 120]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(3000)]
    for at in range(0, len(texts), 70):
        for text, (ids, stops) in zip(texts[at : at + 70], encoded(words, texts[at : at + 70])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
            assert (np.diff(stops) >= 0).all() and (not len(stops) or 0 <= stops[0] and stops[-1] <= len(ids))


def test_pieces_and_hashes():
    text = "It's one,two.\n\n  é.b c"
    data, bounds = packing._bytes(pa.array([text, "", "d" * 40, "x<|a|>b,c"]))
    begins, ends = packing.pieces(data, bounds)
    cut = [data[a:b].tobytes().decode() for a, b in zip(begins, ends)]
    assert cut == ["It", "'s", "one", ",two", ".", "\n", "\n", "é.b", "c", "d" * 40, "x<|a|>b,c"]
    words = [b"%d" % i * (1 + i % 9) for i in range(5000)] + [b"a" * n for n in range(1, 300)]
    ends = np.cumsum([len(w) for w in words])
    key, check = packing.hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(key.tolist())) == len(set(check.tolist())) == len(set(words))


def test_ends_of_sentences():
    words = packing.Words(open(PATH, encoding="utf-8").read())
    (ids, stops), (_, none) = encoded(words, ['One two. "Three!"\nfour', "no end"])
    assert len(ids) == 7 and stops.tolist() == [3, 6, 6] and none.tolist() == []


@pytest.mark.parametrize("bits", [1, 21])
def test_store_is_bounded(library, monkeypatch, bits):
    monkeypatch.setattr(packing, "MOST_STORE_BYTES", 2000)
    monkeypatch.setattr(packing, "SLOT_BITS", bits)
    words = packing.Words(open(PATH, encoding="utf-8").read())
    for i in range(40):
        texts = [f"some words{i}, more{i * i}.", "some " + "long" * 200 * (i % 2)]
        assert [e[0].tolist() for e in encoded(words, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert words.held < 2000 + 2000
    assert words._find(*packing.hashes(np.frombuffer(b"some", np.uint8), np.array([0]), np.array([4]))) >= 0


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest_of_all(seed):
    rng = random.Random(seed)
    costs = Costs(16, rng.choice([0, 2, 5]), 9, rng.choice([0, 3]))
    sizes = np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 6))])
    stops = [np.array(sorted(rng.sample(range(n + 1), min(n, rng.randint(0, 4)))), np.int64) for n in sizes]
    place, penalty = packing.places(stops, sizes, costs)
    assert place[0] == 0 and place[-1] == sizes.sum() and np.diff(place).max() <= 16 and (np.diff(place) > 0).all()
    due = dict(zip(place.tolist(), penalty.tolist()))
    assert all(due[e] == 0 for e in np.cumsum(sizes).tolist())

    def price(a, b):
        return costs.padding(b - a) + due[b] + costs.sequence

    @functools.cache
    def least(b):
        return 0 if b == 0 else min(least(a) + price(a, b) for a in place.tolist() if a < b <= a + 16)

    found = packing.cuts(place, penalty, costs)
    assert found[0] == 0 and found[-1] == sizes.sum()
    assert sum(price(a, b) for a, b in zip(found, found[1:])) == least(int(sizes.sum()))


def test_odd_texts_small_windows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tie": F.lit(1), "ids": F.lit("x"), "start": F.lit(2)}).withColumnRenamed("key", "k")
    found = packing.packed(df, PATH, end=2, costs=Costs(64, 2, 9, 4), run_tokens=500)
    got = found.withColumnRenamed("key", "doc_id").collect()
    check(got, dict(rows), library, 64)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_repeated_rows_missing_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b")] * 3 + [(1, "c")] * 2 + [(1, "d e f")], "doc_id long, text string")
    got = packing.packed(df, PATH, end=2, with_ids=False).collect()
    assert sorted((r["key"] or 0, r["doc_tokens"]) for r in got if r["start"] == 0) == [(0, 3)] * 3 + [(1, 2)] * 2 + [(1, 4)]
    assert sum(r["length"] for r in got) == 17
    assert packing.packed(df.limit(0), PATH, end=2).count() == 0


def test_query_has_little_padding(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert check(op12_packing(spark, sf_dir).collect(), texts, library, 4096) < 0.01
