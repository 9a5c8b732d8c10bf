"""The cleaning pipeline over ``documents``: each stage is one text operator at work on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's ``docs``. All but
the last return the columns of ``documents``. Null texts count as empty ones, repeated rows as copies, and an empty table passes
through. SQL expresses neither the trained classifier nor byte-pair encoding, so there is no check SQL; the tests hold the
result against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, linededup, nearcopies, toxicity
from tagloom.llm.queries import byte_vocabulary
from tagloom.llm.registry import ORACLES as TEXT_ORACLES
from tagloom.llm.registry import QUERIES, query, table
from tagloom.llm.store import written

#: Near copies: five-word shingles, a Jaccard similarity of 0.8 or more; SimHash proposes pairs within seven bits.
WORDS, RADIUS, BLOCKS = 5, 7, 9


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; the model learns from labels outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("score < 0.5").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an equal or near line precedes; one that has no line left goes."""
    kept = linededup.deduplicated(docs)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows are copies by their texts, with or without an id."""
    return nearcopies.without_near_copies(docs, words=WORDS, radius=RADIUS, blocks=BLOCKS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with digests of them and of the text decoded from them."""
    coded = bpe.round_trip(docs, byte_vocabulary())
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select(
        F.col("key").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


__all__ = ["ORACLE_SQL", "QUERIES", "STAGES", "TEXT_ORACLES", "run"]
