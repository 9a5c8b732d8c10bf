"""Links and components against all pairs; recall and bounds of the index by themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import quantiser as q
from tagloom.llm.queries import QUERIES


def slow(rows, cosine):
    """rows: (key, vector or None) to sorted (key, n_links, component)."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    points = {i: np.array(v, np.float64) / np.abs(v).max() for i, ((_, v), ok) in enumerate(zip(rows, fine)) if ok}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in points.items():
        for j, b in points.items():
            if i < j and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    keys = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            keys[find(i)] = min(k, keys.get(find(i), k))
    return sorted(((k, links[i], keys.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def clustered(rng, clusters, each, size, spread):
    centres = rng.normal(size=(clusters, size))
    return np.repeat(centres, each, 0) + spread * rng.normal(size=(clusters * each, size))


@pytest.mark.parametrize("deviations", [3.0, 8.0])
def test_all_pairs(spark, monkeypatch, deviations):
    """Clusters across list borders, with lists longer than a chunk."""
    monkeypatch.setattr(q, "CHUNK", 16)
    rng = np.random.default_rng(3)
    points = np.concatenate([clustered(rng, 20, 12, 64, 0.2), clustered(rng, 1, 60, 64, 0.1), rng.normal(size=(40, 64))])
    rows = [(int(k), points[i].astype(np.float32).tolist()) for i, k in enumerate(rng.permutation(len(points)))]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, q.near_duplicates(df, deviations=deviations).collect()))
    want = slow(rows, 0.95)
    if deviations == 8.0:
        assert got == sorted(want)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) > 0 and all(g[1] <= w[1] for g, w in zip(got, sorted(want)))


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(4)
    points = q.unit(clustered(rng, 10, 30, 16, 0.5))
    index = q.Index(points[:150], 6)
    own = q.nearest(points, index.coarse)
    codes, left = index.codes(points, own)
    for cell in range(len(index.coarse)):
        held = np.flatnonzero(own == cell)
        true = np.sqrt(np.square(points[:, None] - points[held][None]).sum(2))
        assert (index.bounds(points, cell, codes[held], left[held]) <= true + 1e-9).all()


def test_full_probes_cover_every_partner():
    rng = np.random.default_rng(5)
    points = q.unit(clustered(rng, 10, 30, 16, 0.3))
    index = q.Index(points[:150], 12)
    own = q.nearest(points, index.coarse)
    probed = set(zip(*(x.tolist() for x in index.probes(points, own, 0.4, 8.0))))
    near = np.argwhere(np.square(points[:, None] - points[None]).sum(2) <= 0.16)
    assert all((a, own[b]) in probed for a, b in near) and len(probed) < len(points) * len(index.coarse)


@pytest.mark.parametrize("rank", [2, 4, 8, 16, 64])
def test_partners_are_probed_whatever_the_rank(rank):
    """Vectors in ``rank`` of 64 dimensions, partners at a cosine of 0.955, looked for from both ends."""
    rng = np.random.default_rng(rank)
    basis = np.linalg.qr(rng.normal(size=(64, rank)))[0]
    points = q.unit(rng.normal(size=(12_000, rank)) @ basis.T)
    step = rng.normal(size=(12_000, rank)) @ basis.T
    step -= (step * points).sum(1, keepdims=True) * points
    partners = 0.955 * points + np.sqrt(1 - 0.955**2) * q.unit(step)
    index = q.Index(points[:8192], 219)
    own, theirs = q.nearest(points, index.coarse), q.nearest(partners, index.coarse)
    reach = float(np.sqrt(2 - 2 * 0.95))
    probed = [np.zeros((12_000, len(index.coarse)), bool) for _ in range(2)]
    for hit, at in zip(probed, (index.probes(points, own, reach, 3.0), index.probes(partners, theirs, reach, 3.0))):
        hit[at] = True
    there, back = probed[0][np.arange(12_000), theirs], probed[1][np.arange(12_000), own]
    assert there.mean() >= 0.99 and back.mean() >= 0.99 and (there != back).mean() <= 0.01


def test_vectors_of_every_length_are_indexed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size in (1, 2, 3, 64):
        for c in range(8):
            centre = rng.normal(size=size)
            rows += [(len(rows) + k, (centre * (1 + k) + 0.01 * rng.normal(size=size)).tolist()) for k in range(4)]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, q.near_duplicates(df).collect())) == sorted(slow(rows, 0.95))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]),
            (9, [-1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1e-300]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e299]), (13, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("id", F.lit(0))
    assert sorted(map(tuple, q.near_duplicates(df).collect()), key=str) == slow(rows, 0.95)
    assert q.near_duplicates(df.limit(0)).collect() == []
    assert [tuple(r) for r in q.near_duplicates(df.where("vec_id = 5")).collect()] == [(5, 0, 5)]


def test_query_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {k: (n, c) for k, n, c in slow(rows, 0.95)}
    got = QUERIES["op10_embedding_near_dedup"](spark, sf_dir).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
