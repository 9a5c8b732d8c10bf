"""Fixity audit of WARC archives by Merkle trees over offset ranges.

Every record is hashed; the hashes of the records that begin in one range of a file's offsets, in order, make the hash of that
range; ``fanout`` neighbouring ranges make a node above, up to one root per file. Two replicas are compared by their roots.
Only where these differ are the nodes below read, level by level, down to the records that were changed, lost or added. A range has
a bounded number of bytes, so no file, however long, is ever gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.store import written

RANGE_BYTES, FANOUT = 65_536, 16
RECORDS_PER_FILE = 1000
END_OF_RECORD = "\r\n\r\n"


def response_record(name: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 response record, with the blank lines that end it."""
    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"
    fields = (
        F.lit(head), name, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END_OF_RECORD), body, F.lit(END_OF_RECORD),
    )
    return F.concat(*fields)


def _records(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(record, hash) of pages, not yet without repeats."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    records = pages.select(text(key).alias("k"), text(url).alias("u"), text(page).alias("p"))
    return records.select(response_record(F.col("k"), F.col("u"), F.col("p")).alias("record")).withColumn("hash", F.sha2("record", 256))


def catalogued(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", per_file: int = RECORDS_PER_FILE, kept: dict[str, Column] | None = None) -> DataFrame:
    """(file, offset, length, hash) of pages as WARC records in files of about ``per_file`` records: the archive without bodies.

    Records are dealt out and ordered by their hash, so files are of like size whatever the keys. Repeated rows are one record; a
    null key, url or page is empty text. An empty table gives an empty archive. ``kept`` adds columns computed from ``record`` and
    ``hash`` where a record is read; no body is ever shuffled or written here.
    """
    lean = _records(pages, key, url, page).select("hash", F.octet_length("record").cast("long").alias("length"), *[c.alias(n) for n, c in (kept or {}).items()])
    rows = written(lean.distinct(), "records")
    files = max(1, -(-rows.count() // per_file))
    number = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % files
    rows = rows.withColumn("file", F.concat(F.lit("crawl-"), F.lpad(number.cast("string"), 8, "0"), F.lit(".warc")))
    before = Window.partitionBy("file").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return written(rows.select("file", offset.alias("offset"), "length", "hash", *(kept or {})), "catalogue")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(file, offset, record) of the records that ``catalogued`` places; bodies are joined to their places by hash."""
    places = catalogued(pages, key, url, page, per_file).select("file", "offset", "hash")
    bodies = _records(pages, key, url, page).dropDuplicates(["hash"])
    return bodies.join(places, "hash").select("file", "offset", "record")


def write_archive(archive: DataFrame, path: str) -> None:
    """Write (file, offset, record) rows as WARC files, each in a folder ``file=<name>`` of ``path``."""
    rows = archive.repartition("file").sortWithinPartitions("file", "offset")
    block = F.expr("substring(record, 1, length(record) - 4)").alias("value")
    rows.select(block, "file").write.partitionBy("file").option("lineSep", END_OF_RECORD).text(path)


def unpacked(content: bytes) -> bytes:
    """What can be read of the members of a gzip file: a damaged or cut member gives what stands before the damage, and ends the file."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            for at in range(0, len(content), 16_384):
                out.append(member.decompress(content[at : at + 16_384]))
                if member.eof:
                    break
        except zlib.error:
            break
        if not member.eof:
            break
        content = member.unused_data + content[at + 16_384 :]
    return b"".join(out)


def parsed(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of a WARC file, gzipped or not; what follows a broken head is one last record."""
    if content[:2] == b"\x1f\x8b":
        content = unpacked(content)
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)", content[at : head + 2], re.I) if head >= 0 else None
        end = min(head + 8 + int(size[1]), len(content)) if size else len(content)
        yield at, content[at:end]
        at = end


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record) of all files below ``path``, ``file`` being the name of a file's folder and record its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                for offset, record in parsed(content.as_py()):
                    yield pa.RecordBatch.from_pydict({"file": [name.as_py()], "offset": [offset], "record": [record]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = files.select(F.regexp_extract("path", r"file=([^/]*)/", 1).alias("file"), "content")
    return names.mapInArrow(run, "file string, offset bigint, record binary")


def record_hashes(archive: DataFrame) -> DataFrame:
    """(file, offset, length, hash): the leaves. Several records at one place are hashed together."""
    rows = archive.select(
        F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"),
        F.sha2(F.coalesce(F.col("record").cast("binary"), F.lit(b"")), 256).alias("hash"),
    )
    found = rows.groupBy("file", "offset").agg(F.max("length").alias("length"), F.sort_array(F.collect_set("hash")).alias("all"))
    return found.select("file", "offset", "length", F.when(F.size("all") == 1, F.get("all", 0)).otherwise(F.sha2(F.array_join("all", ""), 256)).alias("hash"))


def _above(nodes: DataFrame, place: Column) -> DataFrame:
    """(file, node, hash) from rows (file, at, hash): ``place`` is the parent's number."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda c: F.concat_ws(":", c["at"].cast("string"), c["hash"]))
    return nodes.groupBy("file", place.alias("node")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("hash"))


def merkle_levels(leaves: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, node, hash) tables from the offset ranges up; the last, ``height`` levels above, has one root per file."""
    ranges = leaves.select("file", F.col("offset").alias("at"), "hash")
    levels = [written(_above(ranges, F.floor(F.greatest(F.col("at"), F.lit(0)) / range_bytes)), "ranges")]
    for _ in range(height):
        below = levels[-1].select("file", F.col("node").alias("at"), "hash")
        levels.append(written(_above(below, F.floor(F.col("at") / fanout)), "nodes"))
    return levels


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    joined = left.withColumnRenamed("hash", "expected").join(right.withColumnRenamed("hash", "found"), keys, "full")
    return joined.where(~F.col("expected").eqNullSafe(F.col("found")))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, length, kind, expected, found) for each record on which two archives of (file, offset, record) differ.

    ``kind`` is ``missing`` from the replica, ``extra`` in it, or ``changed``; ``length`` is the primary's, else the replica's. A null file
    is one without a name, a null offset is -1, a null record is empty, repeated rows count once. Other columns play no part.
    Equal or empty archives give no rows.
    """
    return compared(*[written(record_hashes(side), "records") for side in (primary, replica)], range_bytes, fanout)


def compared(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """``audit`` of two archives of which the written leaves (file, offset, length, hash) are known, one for each place."""
    sides = primary, replica
    most = max(side.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for side in sides)
    height, top = 0, most // range_bytes
    while top > 0:
        height, top = height + 1, top // fanout
    left, right = (merkle_levels(side, height, range_bytes, fanout) for side in sides)
    wrong = written(_differing(left[-1], right[-1], ["file", "node"]).select("file", "node"), "mismatches")
    for level in range(height - 1, -1, -1):
        parent = wrong.withColumnRenamed("node", "parent")
        pair = [n[level].withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["file", "parent"], "left_semi").drop("parent") for n in (left, right)]
        wrong = written(_differing(*pair, ["file", "node"]).select("file", "node"), "mismatches")
    place = F.floor(F.greatest(F.col("offset"), F.lit(0)) / range_bytes)
    pair = [side.withColumn("node", place).join(wrong, ["file", "node"], "left_semi").drop("node") for side in sides]
    pair = [side.withColumnRenamed("length", name) for side, name in zip(pair, ("length", "other"))]
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return _differing(*pair, ["file", "offset"]).select("file", "offset", F.coalesce("length", "other").alias("length"), kind.alias("kind"), "expected", "found")
