"""The manifest against trees built plainly in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import manifest
from tagloom.llm.queries import op11_merkle_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def plain_tree(nodes, fanout):
    """Root, and for each leaf its (left, right) siblings."""
    places, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for proof, p in zip(proofs, places):
            run = p - p % fanout
            proof.append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        places = [p // fanout for p in places]
    return nodes[0], proofs


def plain(rows, fanout):
    """Sorted (doc_id, leaf, subroot, root, proof) of all rows."""
    trees = []
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)) for r in rows if r["lang"] == lang)
        trees.append((own, *plain_tree([x[2] for x in own], fanout)))
    root, tops = plain_tree([t[1] for t in trees], fanout)
    return [(x[1] if x[0] else None, x[2], sub, root, p + top) for (own, sub, proofs), top in zip(trees, tops) for x, p in zip(own, proofs)]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fanout,step", [(2, 4), (3, 2), (2, 1)])
def test_proofs_against_plain_trees(spark, fanout, step):
    rows = [{"doc_id": i * 7 % 131, "text": f"t{i}" * (i % 5), "lang": ["en", "de", None, "zz", "é"][min(i % 40, 4)], "source": None if i % 3 else "s", "n_chars": i} for i in range(200)]
    rows += [dict(rows[5], doc_id=None), dict(rows[6], text=None, n_chars=None), rows[7], rows[7], dict(rows[8], lang="", text="x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit(1), "size": F.lit("x"), "proof": F.lit(0), "level0": F.lit(0), "members": F.lit(0), "key": F.lit(9)})
    found = manifest.built(df, COLUMNS, "lang", "doc_id", fanout=fanout, step=step).proofs().collect()
    got = [(r["key"], r["hash"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in found]
    assert ordered(got) == ordered(plain(rows, fanout))


def test_one_group_of_one_row_and_no_rows(spark):
    row = {"doc_id": 3, "text": "", "lang": None, "source": "s", "n_chars": 0}
    one = manifest.built(spark.createDataFrame([row], SCHEMA), COLUMNS, "lang", "doc_id").proofs().collect()
    assert [(r["hash"], r["subroot"], r["root"], r["proof"]) for r in one] == [(plain_leaf(row),) * 3 + ([],)]
    none = manifest.built(spark.createDataFrame([], SCHEMA), COLUMNS, "lang", "doc_id")
    assert none.proofs().count() == 0 and none.root().count() == 0


def test_only_every_few_levels_are_written(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "'a' AS lang")
    levels = manifest.built(df, ["doc_id"], "lang", "doc_id", step=4).groups
    assert [level.count() for level in levels] == [300, 19, 2, 1]


def test_query_finds_the_tampered_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in op11_merkle_manifest(spark, sf_dir).collect()}
    for doc_id, leaf, subroot, root, proof in plain([r.asDict() for r in rows], 2):
        r = found[doc_id]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, subroot, root, h("".join(a + b for a, b in proof)))
        assert r["verified"] == (zlib.crc32(str(doc_id).encode()) % 7 != 0) == (r["folded_root"] == root)
