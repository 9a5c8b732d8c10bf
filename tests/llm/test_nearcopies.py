"""Near copies against the similarities of all pairs."""

import random

from tagloom.llm import nearcopies as n
from tagloom.llm import store
from tests.llm.test_pipeline import COLUMNS, p

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow(docs):
    """Texts' smallest keys, by components of all pairs at 0.8 or more."""
    sets = [shingles(d[1]) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for d, r in zip(docs, root):
        groups.setdefault(r, []).append(d)
    return sorted(str(min((d[0] is None, d[0] or 0) for d in g)) for g in groups.values())


def corpus(rng):
    docs = []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 300]))]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(len(base) // 25 + 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return [(i, t, "en", "s", 1) for i, t in enumerate(docs)]


def run(spark, docs):
    got = p.without_near_copies(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert got.columns == COLUMNS
    return got.collect()


def test_all_pairs(spark):
    docs = corpus(random.Random(4))
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, " \n", "en", "s", 0), (903, "two words", "en", "s", 0), (904, "Two  words", "en", "s", 0)]
    got = run(spark, docs)
    want = slow(docs)
    assert 40 < len(want) < 190 and sorted(str((r[0] is None, r[0] or 0)) for r in got) == want


def test_shuffled_and_in_all_rounds(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_BROADCAST_ROWS", 0)
    monkeypatch.setattr(n, "ROUNDS", (1, None))
    docs = corpus(random.Random(8))[:100]
    assert sorted(str((False, r[0])) for r in run(spark, docs)) == slow(docs)


def test_a_passage_in_common_makes_few_pairs(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    own = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    texts = [" ".join(passage + own(40)) for _ in range(150)] + [" ".join(passage + own(3)) for _ in range(20)]
    texts += [t + " more" for t in texts[:5]]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(str((False, r[0])) for r in run(spark, docs)) == slow(docs)
    sets = n._sets(df.selectExpr("doc_id AS node", "text"), 5)
    nodes = sets.selectExpr("node", "size(s) AS n", "node AS c")
    pairs = {(r["a"], r["b"]) for r in n._rare_pairs(nodes, sets).collect()}
    found = [shingles(t) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j])}
    assert near <= pairs and len(pairs) < 1000 < len(texts) ** 2 / 2


def test_rows_are_told_apart_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    docs = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, b + " more", "en", "s", 1), (None, "own", "en", "s", 1)]
    assert sorted(r.text for r in run(spark, docs)) == sorted([a, b, c, "own"])
