"""Duplicate and near-duplicate lines by a deletion-neighbourhood join.

A line is the sequence of its words between single spaces. The edit bound is one word: two lines are near if one becomes the
other by inserting, deleting or replacing a word. Such lines share a variant with one word deleted (or one of them is a variant of
the other). Lines that equal no other in either of two runs of words, one at each end, of which an edit can touch only one,
have no near line; the others emit all their variants as hashed keys, equal variants are joined, and the edit distance of what meets
is verified on the words themselves.

Groups of lines with one variant are reduced to their earliest line before anything is joined, so a template with many fillings
makes no pairs. A line goes if an equal or near line stands earlier; the earliest stays. Lines of very few words are near
to too much: they are compared for equality only. All of it is joins, grouping, windows over
the words of one line, and built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.store import small_or_shuffled, written

LEAST_WORDS = 5
ID = ["x", "y"]
#: A line's place: document key, line number, and 128 bits of the document's text, which tell rows of one key (or without one) apart.
PLACE = ["doc", "line", "dx", "dy"]


def _bits(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, dx, dy, line, l, n) for every line: its number from 0, its text without spaces around, its number of words."""
    whole = [c.alias(a) for c, a in zip(_bits(F.col(text)), ("dx", "dy"))]
    rows = documents.select(F.col(key).alias("doc"), *whole, F.posexplode(F.split(F.col(text), "\n")).alias("line", "l"))
    rows = rows.withColumn("l", F.trim("l"))
    return rows.withColumn("n", F.octet_length("l") - F.octet_length(F.replace("l", F.lit(" "), F.lit(""))) + 1)


def _identified(lines: DataFrame) -> DataFrame:
    """Lines with 128 bits (x, y) that stand for their text."""
    return lines.withColumns(dict(zip(ID, _bits(F.col("l")))))


def _ends(line: Column, n: Column) -> Column:
    """Keys of the first and last s words, s the largest power of two with 2 s <= n.

    A line whose word count is a power of two meets lines one word shorter, so it has their keys as well.
    """
    s = F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.floor(n / 2))) - 1)

    def keys(s: Column) -> Column:
        return F.array(
            F.xxhash64(s, F.lit(0), F.call_function("substring_index", line, F.lit(" "), s)),
            F.xxhash64(s, F.lit(1), F.call_function("substring_index", line, F.lit(" "), -s)),
        )

    half = F.floor(s / 2).cast("int")
    return F.when((s * 2 == n) & (half > 0), F.concat(keys(s), keys(half))).otherwise(keys(s))


def _candidates(lines: DataFrame) -> DataFrame:
    """(x, y, first, l) for each distinct line that may have a near one; ``first``: its earliest place."""
    keyed = lines.select(*ID, F.explode(_ends(F.col("l"), F.col("n"))).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("k")
    shared = small_or_shuffled(written(shared, "shared_ends"))
    ids = small_or_shuffled(written(keyed.join(shared, "k", "left_semi").select(*ID).distinct(), "candidates"))
    rows = lines.select(*ID, *PLACE, "l").join(ids, ID, "left_semi")
    found = rows.groupBy(*ID).agg(F.min(F.struct(*PLACE)).alias("first"), F.first("l").alias("l"))
    return written(found, "candidate_lines")


def _variants(candidates: DataFrame) -> DataFrame:
    """(v, at, x, y, first): a key for the line itself (at -1) and for it without each of its words.

    The key of a sequence is the XOR of its words' hashes with their places: dropping a word moves the later ones by one place, so
    running XORs over the line give all variants in one pass, however long it is.
    """
    words = candidates.select(*ID, "first", F.posexplode(F.split("l", " ")).alias("at", "w"))
    words = words.select(*ID, "first", "at", F.xxhash64("w", "at").alias("a"), F.xxhash64("w", F.col("at") - 1).alias("b"))
    line = Window.partitionBy(*ID)
    so_far = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.select(
        *ID, "first", "at",
        F.bit_xor("a").over(so_far).bitwiseXOR(F.col("a")).alias("before"),
        F.bit_xor("b").over(line).bitwiseXOR(F.bit_xor("b").over(so_far)).alias("after"),
        F.bit_xor("a").over(line).alias("whole"),
        F.count(F.lit(1)).over(line).alias("n"),
    )
    without = F.struct(F.xxhash64(F.col("before").bitwiseXOR(F.col("after")), F.col("n") - 1).alias("v"), F.col("at").alias("at"))
    itself = F.struct(F.xxhash64("whole", "n").alias("v"), F.lit(-1).alias("at"))
    both = F.when(F.col("at") == 0, F.array(without, itself)).otherwise(F.array(without))
    return words.select(F.inline(both), *ID, "first")


def _without(line: Column, at: Column) -> Column:
    words = F.split(line, " ")
    return F.when(at < 0, words).otherwise(F.concat(F.slice(words, 1, F.greatest(at, F.lit(0))), F.slice(words, F.greatest(at, F.lit(0)) + 2, F.size(words))))


def _near(candidates: DataFrame) -> DataFrame:
    """(x, y, own, first) for each line with an earlier near one: its own earliest place and that line's."""
    variants = written(_variants(candidates), "variants")
    met = written(variants.groupBy("v").count().where("count > 1").select("v"), "met_variants")
    rows = written(variants.join(small_or_shuffled(met), "v").select("v", "at", F.struct("first", *ID).alias("own")), "met")
    replaced = rows.where("at >= 0").groupBy("v", "at").agg(F.min("own").alias("other")).select("v", "at", F.col("at").alias("other_at"), "other")
    shorter = rows.where("at < 0").groupBy("v").agg(F.min("own").alias("other")).select("v", F.lit(-1).alias("other_at"), "other")
    longer = rows.where("at >= 0").groupBy("v").agg(F.min(F.struct("own", "at")).alias("m")).select("v", F.col("m.at").alias("other_at"), "m.own")
    longer = longer.withColumnRenamed("own", "other")
    columns = ["own", "at", "other", "other_at"]
    pairs = (
        rows.where("at >= 0").join(written(replaced, "replaced"), ["v", "at"]).select(*columns)
        .unionByName(rows.where("at >= 0").join(written(shorter, "shorter"), "v").select(*columns))
        .unionByName(rows.where("at < 0").join(written(longer, "longer"), "v").select(*columns))
        .where(F.col("other.first") < F.col("own.first"))
    )
    text = candidates.select(*ID, "l")
    left = text.select(F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("l").alias("ll"))
    right = text.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("l").alias("rl"))
    checked = (
        written(pairs, "pairs")
        .join(left, (F.col("own.x") == F.col("lx")) & (F.col("own.y") == F.col("ly")))
        .join(right, (F.col("other.x") == F.col("rx")) & (F.col("other.y") == F.col("ry")))
        .where(_without(F.col("ll"), F.col("at")) == _without(F.col("rl"), F.col("other_at")))
    )
    near = checked.groupBy("own").agg(F.min("other.first").alias("first"))
    return near.select("own.x", "own.y", F.col("own.first").alias("own"), "first")


def _gone(documents: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    """(doc, line, dx, dy, first) for every line that goes; ``first``: the place of the earliest equal or near line."""
    lines = _identified(lines_of(documents, key, text).where(F.col("l") != ""))
    near = written(_near(_candidates(lines.where(F.col("n") >= least_words))), "near")
    places = lines.groupBy(*ID).agg(F.min(F.struct(*PLACE)).alias("own"), F.max(F.struct(*PLACE)).alias("last"))
    equal = places.where(F.col("own") < F.col("last")).select(*ID, "own", F.col("own").alias("first"))
    changed = equal.unionByName(near).groupBy(*ID).agg(F.min("own").alias("own"), F.min("first").alias("first"))
    changed = small_or_shuffled(written(changed, "changed"))
    gone = lines.select(*ID, *PLACE).join(changed, ID).where(F.struct(*PLACE) > F.col("first"))
    return gone.select(*PLACE, "first").distinct()


def duplicate_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, line, first_doc, first_line) for every line that goes, with the place of the earliest equal or near line.

    Places are ordered by document key (a missing key is the least), line number and text. Lines of fewer than ``least_words`` words
    go only if an equal one stands earlier, empty ones always stay. Rows with one key and one text are one document, and the lines at one place of it one line: repeated rows lose
    nothing to each other. Rows with one key, or without one, and different texts are different documents. A null or empty text
    has no line to lose; an empty table gives an empty one; other columns play no part.
    """
    gone = _gone(documents, key, text, least_words)
    return gone.select("doc", "line", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line")).distinct()


def deduplicated(documents: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``documents`` without the lines that go; a document of which no line is left goes as well, all others stay.

    A row loses only lines of its own text. Columns and rows are otherwise as they were; a text that loses no line is the same to
    the last byte.
    """
    gone = _gone(documents, key, text, least_words)
    taken = {c.lower() for c in documents.columns}
    names = {c: next(n for n in (f"_{c}" + "_" * k for k in range(len(taken) + 1)) if n not in taken) for c in ("doc", "dx", "dy", "gone", "kept")}
    places, kept = names["gone"], names["kept"]
    gone = gone.groupBy(*(F.col(c).alias(names[c]) for c in ("doc", "dx", "dy"))).agg(F.collect_set("line").alias(places))
    x, y = _bits(F.col(text))
    own = (x == F.col(names["dx"])) & (y == F.col(names["dy"])) & F.col(key).eqNullSafe(F.col(names["doc"]))
    rows = documents.join(written(gone, "gone_lines"), own, "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    rows = rows.withColumn(kept, F.when(F.col(places).isNotNull(), F.transform(left, lambda i: F.get(lines, i))))
    rows = rows.where(F.col(kept).isNull() | (F.size(kept) > 0))
    return rows.withColumn(text, F.when(F.col(kept).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*documents.columns)
