"""The corpus pipeline: low-quality documents go, then repeated lines, near-duplicate documents and repeated passages, and the rest is packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the columns of
``documents``; where a stage shortens a text, ``n_chars`` follows. No stage can be put in SQL as a whole, so there is no SQL twin;
the stages' operators are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import line_dedup, near_dups, packing, quality, queries, runtime, substrings


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach grade 1 with a probability of a half at least."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality.select(docs, quality.train(docs, labels), least_grade=1, least_probability=0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of like lines stays; documents without a line left go."""
    return _measured(line_dedup.without_lines(docs, threshold=0.8))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    runtime.prepare(spark)
    return near_dups.representatives(docs, threshold=0.8, width=5)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words that a document of smaller id has go; documents that lose every word go."""
    runtime.prepare(spark)
    found = substrings.without_repeats(docs, window=50)
    left = found.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    return _measured(left.select(*[text.alias("text") if c == "text" else F.col(f"doc.{c}") for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    runtime.prepare(spark)
    return packing.pack(docs, queries.byte_bpe_json(), public_tokenizers.PATTERN, most=1024)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("passages", drop_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = runtime.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
