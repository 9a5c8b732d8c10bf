"""Near-duplicate vectors by product quantisation.

Vectors are scaled to length one, so a cosine of at least ``c`` is a distance of at most r = sqrt(2 - 2c). Coarse centroids divide them
into inverted lists; in its list a vector is stored as residual codes, one centroid number per subspace, with the norm of
what the codes leave over. Both codebooks are fitted on at most ``SAMPLE`` distinct vectors; every vector is indexed.

Probes are sufficient, not a fixed number: a partner of ``a`` lies in list k only if the step to it crosses the bisector between
the centroid of ``a`` and that of k. How far a step of length r goes along that direction depends on how the vectors spread: of the
covariance left within lists, the direction's share is 1 / d in d dimensions that are alike, but 1 / q if all vectors lie in q of
them. So ``a`` probes every list whose bisector is within ``deviations`` times r times the root of that share (1 / d at least), or
within r itself if that is less, beyond which no partner can lie.
In a list the table-lookup distance less the left-over norm bounds the true distance from below, which loses nothing; what passes
is compared by exact cosine in double precision. Each vector finds its own partners, so counts need no pairs brought together.

Equal vectors are one class with a count. A long list and its probes are cut into chunks that meet in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.simhash import forest
from tagloom.llm.store import written

SAMPLE = 8192
SUBSPACES, CODES = 8, 64
CHUNK = 1024
SLACK = 1e-6


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre; of equally near ones the first."""
    return (np.square(centres).sum(1) - 2.0 * points @ centres.T).argmin(1)


def k_means(points: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most ``count`` centres by Lloyd's rounds from sampled points; empty ones go."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:count]]
    for _ in range(rounds):
        own = nearest(points, centres)
        sizes = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = (sums / np.maximum(sizes, 1)[:, None])[sizes > 0]
    return centres


class Index:
    """Coarse centroids and the residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = k_means(sample, lists)
        residuals = sample - self.coarse[nearest(sample, self.coarse)]
        self.shares = self._shares(residuals)
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.spans = list(zip(edges, edges[1:]))
        self.books = [k_means(residuals[:, a:b], CODES) for a, b in self.spans]

    def _between(self) -> np.ndarray:
        squares = np.square(self.coarse).sum(1)
        return np.maximum(squares[:, None] + squares - 2.0 * self.coarse @ self.coarse.T, 0.0)

    def _shares(self, residuals: np.ndarray) -> np.ndarray:
        """For each two lists the share of the spread within lists that lies along the line between their centroids."""
        covariance = residuals.T @ residuals
        along = self.coarse @ covariance @ self.coarse.T
        own = np.diag(along)
        total = max(float(np.trace(covariance)), 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = (own[:, None] + own - 2.0 * along) / (self._between() * total)
        return np.clip(np.nan_to_num(shares, nan=1.0, posinf=1.0), 1.0 / residuals.shape[1], 1.0)

    def codes(self, points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes of each point in its list, and the norm that they leave over."""
        residual = points - self.coarse[own]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.spans, self.books)], 1)
        left = residual - np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(np.square(left).sum(1))

    def probes(self, points: np.ndarray, own: np.ndarray, reach: float, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) for every list whose vectors a step of length ``reach`` may lead to."""
        squares = np.square(points).sum(1)[:, None] + np.square(self.coarse).sum(1) - 2.0 * points @ self.coarse.T
        steps = reach * np.minimum(1.0, deviations * np.sqrt(self.shares)) + SLACK
        beyond = squares - squares[np.arange(len(points)), own][:, None]
        return np.nonzero(beyond <= 2.0 * (steps * np.sqrt(self._between()))[own] + SLACK)

    def bounds(self, queries: np.ndarray, cell: int, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each query and stored vector of a list a lower bound of their distance, from per-query tables."""
        residual = queries - self.coarse[cell]
        total = np.zeros((len(queries), len(codes)))
        for i, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            part = residual[:, a:b]
            table = np.square(part).sum(1)[:, None] + np.square(book).sum(1) - 2.0 * part @ book.T
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0.0)) - left


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(points: np.ndarray) -> np.ndarray:
    scale = np.abs(points).max(1, keepdims=True)  # so that no square over- or underflows
    scaled = points / scale
    return scaled / np.sqrt(np.square(scaled).sum(1, keepdims=True))


def classes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, v), v null if the vector links with nothing; and classes (node, n, v) of equal vectors."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = fine & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0).cast(kind))))  # one zero
    groups = rows.where("v is not null").groupBy("v").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n"))
    return rows, written(groups.select(F.monotonically_increasing_id().alias("id"), "node", "n", "v"), "classes")


def _listed(index, reach: float, deviations: float):
    """(id, n, role, cell, v, codes, left): each vector once as stored, and once as a query per probed list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = index.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                points = unit(matrix(part.column(2)))
                own = nearest(points, tool.coarse)
                codes, left = tool.codes(points, own)
                at, cells = tool.probes(points, own, reach, deviations)
                for role, rows, cell in ((0, np.arange(len(points)), own), (1, at, cells)):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(take), part.column(1).take(take), pa.array(np.full(len(rows), role, np.int32)),
                            pa.array(cell.astype(np.int32)), part.column(2).take(take),
                            pa.array([c.tobytes() for c in codes[rows]] if role == 0 else [b""] * len(rows), pa.binary()),
                            pa.array(left[rows] if role == 0 else np.zeros(len(rows))),
                        ],
                        ["id", "n", "role", "cell", "v", "codes", "left"],
                    )

    return run


def _compared(index, cosine: float):
    """One list chunk against one chunk of its probes: partners counted per query, and links that connect them."""
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * cosine))

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tool, cell = index.value, int(keys[0])
        stored, queries = rows[rows["role"] == 0], rows[rows["role"] == 1]
        if not len(stored) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        raw = [np.stack(x["v"].to_numpy()).astype(np.float64) for x in (stored, queries)]
        base, ask = (x / np.abs(x).max(1, keepdims=True) for x in raw)
        base_norm, ask_norm = (np.sqrt(np.square(x).sum(1)) for x in (base, ask))
        codes = np.frombuffer(b"".join(stored["codes"]), np.uint8).reshape(len(stored), -1)
        ids, weights, own = stored["id"].to_numpy(), stored["n"].to_numpy(), queries["id"].to_numpy()
        counts = np.zeros(len(queries), np.int64)
        names, places = np.unique(np.concatenate([ids, own]), return_inverse=True)
        pairs = []
        for start in range(0, len(queries), 256):
            cut = slice(start, start + 256)
            low = tool.bounds(unit(raw[1][cut]), cell, codes, stored["left"].to_numpy())
            q, s = np.nonzero(low <= reach + SLACK)
            q += start
            exact = np.einsum("ij,ij->i", ask[q], base[s]) / (ask_norm[q] * base_norm[s])
            linked = (exact >= cosine) & (own[q] != ids[s])
            q, s = q[linked], s[linked]
            np.add.at(counts, q, weights[s])
            pairs.append((places[len(ids) + q], places[s]))
        root = forest(len(names), iter(pairs))
        joined = np.flatnonzero(root != np.arange(len(root)))
        asked = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([names[joined], own[asked]]),
            "b": np.concatenate([names[root[joined]], own[asked]]),
            "n": np.concatenate([np.zeros(len(joined), np.int64), counts[asked]]),
        })

    return run


def _found(vectors: DataFrame, count: int, cosine: float, deviations: float, lists: int | None) -> DataFrame:
    """(a, b, n) of distinct vectors (id, n, v) of one length: links that connect partners, and with a = b numbers of partners."""
    sample = vectors.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    index = vectors.sparkSession.sparkContext.broadcast(Index(unit(matrix(sample)), lists or max(1, min(SAMPLE // 8, round(2 * count**0.5)))))
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    kind = vectors.schema["v"].dataType.simpleString()
    schema = f"id bigint, n bigint, role int, cell int, v {kind}, codes binary, left double"
    listed = written(vectors.select("id", "n", "v").mapInArrow(_listed(index, reach, deviations), schema), "lists")
    sizes = listed.groupBy("cell").agg(*(F.ceil(F.count_if(F.col("role") == r) / CHUNK).cast("int").alias(name) for r, name in ((0, "held"), (1, "asked"))))
    sizes = written(sizes, "sizes")
    stored = F.col("role") == 0
    mine = F.pmod(F.xxhash64("id"), F.when(stored, F.col("held")).otherwise(F.col("asked"))).cast("int")
    other = F.sequence(F.lit(0), F.when(stored, F.col("asked")).otherwise(F.col("held")) - 1)
    met = listed.join(sizes, "cell").where("held > 0 and asked > 0").select("*", mine.alias("mine"), F.explode(other).alias("other"))
    met = met.withColumns({"i": F.when(stored, F.col("mine")).otherwise(F.col("other")), "j": F.when(stored, F.col("other")).otherwise(F.col("mine"))})
    return written(met.groupBy("cell", "i", "j").applyInPandas(_compared(index, cosine), "a bigint, b bigint, n bigint"), "found")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, deviations: float = 3.0, lists: int | None = None
) -> DataFrame:
    """(key, n_links, component) per row: direct partners at ``cosine`` or above, and the smallest key they lead to.

    Every row counts as a vector of its own, repeated ones too. A vector that is null, empty, zero or has a component that is
    null, NaN or infinite links with nothing and is its own component. Vectors of each length are indexed apart, as only those of one
    length have a cosine. Rows without a key count as partners; such a row's component is that of its partners, null if none has a key.
    An empty table gives an empty one.
    """
    rows, groups = classes(vectors, key, vector)
    spark = vectors.sparkSession
    found = None
    for size in groups.groupBy(F.size("v").alias("size")).count().where("count > 1").orderBy("size").collect():
        own = _found(groups.where(F.size("v") == size["size"]), size["count"], cosine, deviations, lists)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    links = found.where("a <> b").select("a", "b")
    joined = components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("head"))
    named = groups.join(joined, "id", "left").withColumn("head", F.coalesce("head", "id")).join(counts, "id", "left")
    smallest = named.groupBy("head").agg(F.min("node").alias("component"))
    classed = named.join(written(smallest, "heads"), "head").select("v", "n", F.coalesce("links", F.lit(0)).alias("links"), "component")
    out = rows.join(written(classed, "classed"), "v", "left")
    total = F.when(F.col("n").isNull(), 0).otherwise(F.col("n") - 1 + F.col("links")).cast("long")
    return out.select("key", total.alias("n_links"), F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))
