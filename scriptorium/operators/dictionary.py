"""Looking words up in a dictionary: a table ``word`` of any size.

What a document needs to know is asked at once: its candidate words, each once, are joined to the dictionary, and those that it
holds come back as an array beside the document. Row-local functions (``text.restore_drop_caps``, ``text.fix_short_latin``, the
suspicion scores) then look into that array, so no dictionary is carried into a task or a plan. A document is told by its key,
which must be unique; a null key knows no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_known(docs: DataFrame, words: DataFrame, key: str, candidates: Column, name: str = "known") -> DataFrame:
    """``docs`` and ``name``: those of each document's ``candidates`` (lower-case words) that the dictionary ``words(word)`` holds."""
    asked = docs.select(F.col(key).alias("__key"), F.explode(F.array_distinct(candidates)).alias("word"))
    held = words.select(F.lower("word").alias("word")).distinct()
    found = asked.join(held, "word", "left_semi").groupBy("__key").agg(F.collect_set("word").alias("__known"))
    joined = docs.join(found, F.col(key) == F.col("__key"), "left")
    return joined.select(*docs.columns, F.coalesce("__known", F.array().cast("array<string>")).alias(name))
