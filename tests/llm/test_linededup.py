"""Near lines against word edit distances of all pairs, and against the check SQL."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tagloom.llm import linededup as d
from tagloom.llm import store
from tagloom.llm.queries import LINES_SQL, QUERIES


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(docs, least=5):
    place = lambda k, i: (k is not None, k or 0, i)
    lines = [(k, i, t.strip(" ").split(" ")) for k, text in docs for i, t in enumerate((text or "").split("\n")) if text is not None]
    lines = [x for x in lines if x[2] != [""]]
    firsts = {}
    for k, i, w in lines:
        p = (place(k, i), k, i)
        firsts[tuple(w)] = min(p, firsts.get(tuple(w), p))
    out = set()
    for k, i, w in lines:
        own = firsts[tuple(w)]
        near = min([own] + [p for v, p in firsts.items() if p < own and min(len(v), len(w)) >= least and within_one(list(v), w)])
        if near[0] < place(k, i):
            out.add((k, i, near[1], near[2]))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"line": F.lit("clash"), "x": F.lit(0), "first": F.lit(1)})
    return df, sorted((tuple(r) for r in d.duplicate_lines(df).collect()), key=str)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(12)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33]))] for _ in range(40)]
    for _ in range(200):
        w = list(rng.choice(lines))
        at = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[at] = rng.choice(vocabulary)
        elif kind == 1:
            w.insert(at, rng.choice(vocabulary))
        elif kind == 2:
            del w[at]
        lines.append(w)
    lines += [["t", "e", "m", "p", "l", f"v{i}"] for i in range(30)] + [["a", "a", "a", "a", "a"], ["a"] * 6, ["a"] * 7]
    rng.shuffle(lines)
    return lines


def test_all_pairs(spark):
    rng = random.Random(11)
    lines = corpus(rng)
    docs = [(i, "\n".join(" " * rng.randrange(2) + " ".join(w) for w in lines[i * 9 : i * 9 + 9])) for i in range(len(lines) // 9 + 1)]
    docs += [(510, "Of.\n  \nall rights\nOf."), (511, " Of. \nall right\nall rights"), (512, "a a a\na a a a\na a a")]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, " ".join(lines[0])), (None, " ".join(lines[5])), (3, docs[3][1]), (-4, "t e m p l first")]
    rng.shuffle(docs)
    _, got = run(spark, docs)
    want = slow(docs)
    assert len(want) > 80 and got == want


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_BROADCAST_ROWS", 0)
    docs = [(i, "\n".join(" ".join(w) for w in corpus(random.Random(2))[i * 7 : i * 7 + 7])) for i in range(20)]
    assert run(spark, docs)[1] == slow(docs)


def test_long_lines(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    other = long[:17_000] + ["new"] + long[17_000:]
    docs = [(1, " ".join(long)), (2, "x\n" + " ".join(other)), (3, " ".join(other[1:])), (4, " ".join(long[2:]))]
    assert run(spark, docs)[1] == [(2, 1, 1, 0), (3, 0, 2, 1)]


def test_texts_are_rebuilt(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    docs = [(1, f"{a}\n short\n{b} \n"), (2, f"{a} more\nkeep me"), (3, b), (4, None), (5, ""), (6, f"{b}\n{b} x\n"), (6, f"{b}\n{b} x\n"), (None, "tiny")]
    df, _ = run(spark, docs)
    got = d.deduplicated(df)
    assert got.columns == df.columns
    want = [(1, docs[0][1]), (2, "keep me"), (4, None), (5, ""), (6, ""), (6, ""), (None, "tiny")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    clash = df.withColumns({n: F.lit(7) for n in ("_kept", "_gone", "_doc", "_dx", "_DY")})
    assert {(r["_kept"], r["_gone"], r["_doc"], r["_dx"], r["_DY"]) for r in d.deduplicated(clash).collect()} == {(7,) * 5}
    assert d.deduplicated(clash).count() == len(want)
    assert d.deduplicated(df.limit(0)).collect() == [] and d.duplicate_lines(df.limit(0)).collect() == []


def test_rows_of_one_key_are_told_apart_by_text(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(8)) for x in "abce")
    docs = [(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (5, f"{e}\n{a}"), (5, f"{c} more\nan own line of 5")]
    df, got = run(spark, docs)
    assert (None, 1, None, 1) in got
    texts = [r.text for r in d.deduplicated(df).collect()]
    left = [t for text in texts for t in text.split("\n")]
    assert sorted(left) == sorted([a, b, c, e, "an own line of 5"])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op5_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, QUERIES["op5_line_dedup"](spark, sf_dir).collect())) == sorted(con.execute(LINES_SQL).fetchall())
