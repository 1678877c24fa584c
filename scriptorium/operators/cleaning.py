"""The deep clean-up of converted pages as a whole: row-local steps, and two that ask a dictionary in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import dictionary
from scriptorium.sources import shared


def deep(docs: DataFrame, key: str, text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """``docs`` with cleaned texts. With a dictionary ``words(word)`` lost first letters are restored and short Latin words are
    turned Cyrillic where it knows them; without one, no first letter is, and a short list of words stands in."""
    shared.small_batches(docs.sparkSession)
    for name, step in T.deep_steps():
        if words is not None and name in T.ASKING:
            asked, fix = T.ASKING[name]
            docs = dictionary.with_known(docs, words, key, asked(F.col(text)), "__known")
            docs = docs.withColumn(text, fix(F.col(text), F.col("__known"))).drop("__known")
        else:
            docs = docs.withColumn(text, step(F.col(text)))
    return docs
