"""Benchmark passages in documents, by SimHash over windows of each item's own length.

Words are runs of letters and digits in lower case; shingles are five words (an item of fewer words is one shingle). A window
of a document has as many words as the item, or the whole document where that is shorter. It leaks the item if the multisets
of their shingles have a weighted Jaccard similarity (each shingle weighs as often as it occurs) of at least ``similarity``.

Such a window shares shingles with the item, so windows are laid only where enough shingles of one item stand close
together; this loses none. Each window's fingerprint is then held against the item's: both are cut into ``radius + 1``
blocks, of which two fingerprints within ``radius`` bits have one in common, so a join on blocks meets every such pair. Pairs
within the radius are verified exactly. Equal texts are judged once. All of it is joins, grouping and built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import written

SHINGLE = 5
RADIUS = 20
BITS = 64


def word_hashes(text: Column) -> Column:
    """A hash for each word of the text in order; null: none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: Column) -> Column:
    """A hash for every run of ``size`` (at most five) words; the array is empty if there are fewer words."""

    def one(i: Column) -> Column:
        return F.xxhash64(*(F.when(size > j, F.get(words, i + j)) for j in range(SHINGLE)))

    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: Column) -> Column:
    """SimHash: a bit is set if it is set in over half the hashes."""

    def ones(j: Column) -> Column:
        return F.aggregate(shingles, F.lit(0), lambda a, x: a + _bit(x, j))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        F.lit(0).cast("long"),
        lambda acc, j: acc.bitwiseOR(F.when(ones(j) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))),
    )


def _bit(x: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, j).bitwiseAND(F.lit(1)).cast("int")


def _blocks(fp: Column, count: int) -> Column:
    """The fingerprint's bits in ``count`` blocks. A loop over the blocks, as one expression for each makes giant methods."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    cuts = F.array(*(F.struct(F.lit(lo).alias("shift"), F.lit((1 << hi - lo) - 1 if hi - lo < BITS else -1).cast("long").alias("mask")) for lo, hi in zip(edges, edges[1:])))
    return F.transform(cuts, lambda c: F.call_function("shiftrightunsigned", fp, c["shift"]).bitwiseAND(c["mask"]))


def common_weight(one: Column, other: Column) -> Column:
    """Sum over the distinct values of two arrays of the lesser number of occurrences."""
    counts = F.aggregate(
        F.array_sort(one),
        F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("total")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            (acc["total"] + F.when(F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1)) <= F.coalesce(F.try_element_at(other, x), F.lit(0)), 1).otherwise(0)).alias("total"),
        ),
    )
    return counts["total"]


def _counted(values: Column) -> Column:
    """An array's distinct values with their numbers of occurrences."""
    return F.map_from_entries(F.transform(F.array_distinct(values), lambda x: F.struct(x, F.size(F.filter(values, lambda y: y == x)))))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(7), text).alias("y"))


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """One row per distinct word sequence: its words, sizes, shingles, fingerprint and a key; items without words are none."""
    rows = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(text)).alias("w")).where("size(w) > 0")
    rows = rows.groupBy("w").agg(F.collect_list(F.struct("item")).alias("items"))
    rows = rows.select(F.xxhash64("w").alias("iid"), "items", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    rows = rows.withColumn("shingles", shingle_hashes(F.col("w"), F.col("k"))).drop("w")
    return rows.withColumns({"m": F.size("shingles"), "fp": fingerprint(F.col("shingles")), "weights": _counted(F.col("shingles"))})


def leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, radius: int = RADIUS
) -> DataFrame:
    """(key, item, similarity, start, words) for each distinct document text, by ``text_key``, and each item it leaks.

    ``start`` is the number of the first word of the most similar window, the first of equals, ``words`` the window's length. A null or
    empty text or item leaks nothing, equal items are found together, an item without an id has a null ``item``. Either table
    may be empty. Repeated rows and other columns change nothing.
    """
    items = written(items_of(benchmark, item, item_text), "items")
    listed = items.select("iid", "k", "n", "m", F.explode(F.array_distinct("shingles")).alias("s"))
    listed = written(listed, "item_shingles")
    sizes = [r.k for r in items.select("k").distinct().orderBy("k").collect()]  # at most five numbers
    needed = F.ceil(F.col("m") * similarity - 1e-9).cast("int")

    texts = documents.select(F.col(text).alias("text")).where("text is not null")
    words = texts.select(text_key(F.col("text")).alias("key"), word_hashes(F.col("text")).alias("w"))
    placed = words.select("key", "w", F.posexplode("w").alias("p", "first"))
    size = F.size("w")
    found = None
    for k in sizes:
        s = F.xxhash64("first", *(F.get("w", F.col("p") + j) if j < k else F.lit(None).cast("long") for j in range(1, SHINGLE)))
        part = placed.where(F.col("p") + k <= size).select("key", size.alias("total"), "p", s.alias("s"), F.lit(k).alias("k"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = placed.where("false").select("key", size.alias("total"), "p", F.lit(0).cast("long").alias("s"), F.lit(0).alias("k"))
    near = found.join(listed, ["s", "k"]).groupBy("key", "total", "iid", "k", "n", "m").agg(F.array_sort(F.collect_set("p")).alias("at"))
    near = written(near.withColumn("needed", needed).where(F.size("at") >= F.col("needed")), "candidates")

    # starts of windows with at least ``needed`` shared places
    last = F.greatest(F.col("total") - F.col("n"), F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("needed")),
        lambda i: F.struct((F.get("at", i + F.col("needed") - 1) - F.col("m") + 1).alias("lo"), F.get("at", i).alias("hi")),
    )
    starts = F.flatten(F.transform(F.filter(runs, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"])))
    starts = F.array_distinct(F.transform(starts, lambda x: F.least(F.greatest(x, F.lit(0)), last)))
    whole = documents.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).join(near.select("key").distinct(), "key", "left_semi")
    whole = whole.groupBy("key").agg(F.first("text").alias("text")).select("key", word_hashes(F.col("text")).alias("w"))
    windows = whole.join(near, "key").select("key", "iid", "k", "n", "m", "w", F.explode(starts).alias("start"))
    windows = windows.select("key", "iid", "k", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("w"))
    windows = windows.select("key", "iid", "start", F.size("w").alias("words"), shingle_hashes(F.col("w"), F.col("k")).alias("shingles"))
    windows = windows.where("size(shingles) > 0").withColumn("fp", fingerprint(F.col("shingles")))
    windows = written(windows, "windows")

    blocks = F.posexplode(_blocks(F.col("fp"), radius + 1)).alias("block", "part")
    left = windows.select("key", "iid", "start", "fp", blocks).alias("l")
    right = items.select("iid", F.col("fp").alias("ifp"), blocks).alias("r")
    agree = F.zip_with(_blocks(F.col("fp"), radius + 1), _blocks(F.col("ifp"), radius + 1), lambda a, b: a == b)
    same = (F.col("l.iid") == F.col("r.iid")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.part") == F.col("r.part"))
    once = (F.array_position(agree, True) == F.col("l.block") + 1) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    close = left.join(right, same & once).select(F.col("l.key").alias("key"), F.col("l.iid").alias("iid"), F.col("l.start").alias("start"))

    checked = close.join(windows, ["key", "iid", "start"]).join(items.select("iid", "m", "weights", "items"), "iid")
    common = common_weight(F.col("shingles"), F.col("weights"))
    alike = (common / (F.size("shingles") + F.col("m") - common).cast("double")).alias("similarity")
    kept = checked.select("key", "iid", "items", "start", "words", alike).where(F.col("similarity") >= similarity)
    best = kept.groupBy("key", "iid").agg(
        F.max_by(F.struct("similarity", "start", "words", "items"), F.struct("similarity", F.col("start") * -1)).alias("best")
    )
    return written(best.select("key", F.inline("best.items"), "best.similarity", "best.start", "best.words"), "leaks")


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``documents`` rows that leak an item, one row per item, with ``item``, ``similarity``, ``start`` and ``words`` added."""
    new = ["item", "similarity", "start", "words"]
    found = leaks(documents, benchmark, text, item, item_text, similarity).withColumnRenamed("key", "_key")
    rows = documents.drop(*new).withColumn("_key", text_key(F.col(text)))
    return rows.join(found, "_key").drop("_key")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``documents`` rows that leak no item, as they are."""
    found = leaks(documents, benchmark, text, item, item_text, similarity).select(F.col("key").alias("_key")).distinct()
    return documents.withColumn("_key", text_key(F.col(text))).join(found, "_key", "left_anti").drop("_key")
