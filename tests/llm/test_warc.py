"""Damage found against a record-by-record comparison, and archives written and read back."""

import gzip
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.llm import warc
from tagloom.llm.queries import FIXITY_SQL, QUERIES


def slow(left, right):
    a, b = ({(f or "", -1 if o is None else o): r or b"" for f, o, r in rows} for rows in (left, right))
    out = []
    for f, o in set(a) | set(b):
        if a.get((f, o)) != b.get((f, o)):
            kind = "missing" if (f, o) not in b else "extra" if (f, o) not in a else "changed"
            out.append((f, o, len(a.get((f, o), b.get((f, o)))), kind))
    return sorted(out)


SCHEMA = "file string, offset bigint, record binary"


def found(spark, left, right, **more):
    frames = [spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("clash"), "hash": F.lit(0), "length": F.lit(1)}) for rows in (left, right)]
    return sorted((r.file, r.offset, r.length, r.kind) for r in warc.audit(*frames, **more).collect())


@pytest.mark.parametrize("range_bytes, fanout", [(256, 8), (1000, 3), (1 << 20, 16)])
def test_random_damage(spark, range_bytes, fanout):
    rng = random.Random(range_bytes)
    left = []
    for f in range(6):
        at = 0
        for _ in range(rng.randrange(0, 60)):
            record = rng.randbytes(rng.randrange(1, 90))
            left.append((f"f{f}", at, record))
            at += len(record)
    right = list(left)
    for _ in range(12):
        i = rng.randrange(len(right))
        f, o, r = right[i]
        right[i : i + 1] = rng.choice([[(f, o, b"!" + r)], [], [(f, o, r), (f, o + 10**6, b"new")]])
    right.append(("only here", 5, b"x"))
    assert len(slow(left, right)) >= 8
    assert found(spark, left, right, range_bytes=range_bytes, fanout=fanout) == slow(left, right)
    assert found(spark, left, left[::-1], range_bytes=range_bytes, fanout=fanout) == []


def test_only_mismatching_branches_differ(spark):
    left = [("f", i * 100, b"r%d" % i) for i in range(100)]
    right = [(f, o, b"bad" if o == 4200 else r) for f, o, r in left]
    a, b = (warc.merkle_levels(warc.record_hashes(spark.createDataFrame(x, SCHEMA)), 2, 500, 5) for x in (left, right))
    wrong = [sorted(r.node for r in warc._differing(x, y, ["file", "node"]).collect()) for x, y in zip(a, b)]
    assert wrong == [[8], [1], [0]] and [x.count() for x in a] == [20, 4, 1]


def test_edge_rows(spark):
    left = [(None, None, None), (None, 5, b"a"), ("f", 0, b""), ("f", 0, b""), ("g", 1, b"long" * 50_000)]
    right = [(None, None, b"x"), (None, 5, b"a"), ("f", 0, None), ("g", 1, b"long" * 49_999 + b"lonk")]
    assert found(spark, left, right) == [("", -1, 0, "changed"), ("g", 1, 200_000, "changed")]
    assert found(spark, [], []) == [] and found(spark, left, []) == slow(left, []) and found(spark, [], right) == slow([], right)


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.0\r\n</p>"), (1, "http://a/", "<p>é\r\n\r\nWARC/1.0\r\n</p>"), (None, None, None), (2, "u", "x" * 100_000)]
    rows += [(i, f"http://h/{i}", f"<b>{i}</b>") for i in range(10, 40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archive = warc.archived(pages, per_file=8)
    assert archive.count() == 33 and archive.select("file").distinct().count() > 2
    warc.write_archive(archive, f"{tmp_path}/archive")
    read = warc.read_archive(spark, f"{tmp_path}/archive")
    assert warc.audit(archive, read).count() == 0 and read.count() == 33
    assert warc.archived(pages.limit(0)).collect() == []


def test_parsing_of_broken_and_compressed_files():
    record = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.parsed(record * 2)) == [(0, record), (len(record), record)]
    assert list(warc.parsed(gzip.compress(record) + gzip.compress(record))) == list(warc.parsed(record * 2))
    both = gzip.compress(record) + gzip.compress(record)
    assert list(warc.parsed(both[:-12])) == [(0, record), (len(record), record[: len(list(warc.parsed(both[:-12]))[1][1])])]
    assert list(warc.parsed(gzip.compress(record) + b"\x1f\x8bnot gzip")) == [(0, record)] and list(warc.parsed(both[:5])) == []
    big = gzip.compress(record * 20_000, 0)
    assert list(warc.parsed(big + both)) == list(warc.parsed(record * 20_002))
    assert list(warc.parsed(record + b"junk")) == [(0, record), (len(record), b"junk")] and list(warc.parsed(b"")) == []


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(FIXITY_SQL).fetchall()
    got = [tuple(r) for r in QUERIES["op2_warc_fixity_audit"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and got
