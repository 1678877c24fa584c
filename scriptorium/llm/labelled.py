"""Bounded samples of labelled documents for the classifiers, and the hashed words they share."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import runtime

#: Words, sentence ends and line ends; everything else parts words.
TOKENS = re.compile(r"[^\W_]+|[.!?\n]+")


def held_out(key: Column) -> Column:
    """A quarter of the documents, by their key, from which nothing is learnt."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2


def drawn(docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, y, t``: keys, labels and texts of at most ``limit`` labelled documents that aren't held out, by a hash of the key.

    The sample is bounded whatever the tables' size. Null keys, texts and labels give nothing; of several labels of a document the
    largest counts, of several texts the least.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(limit)
    texts = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).where("t is not null")
    return texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))  # the limit bounds what is broadcast


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Texts and labels of the documents drawn, by key; they are collected, with whole texts."""
    return [(r.t, int(r.y)) for r in drawn(docs, labels, label, limit, key, text).orderBy("k").collect()]


def fitted[M](fit: Callable[[list[tuple[str, int]]], M], docs: DataFrame, labels: DataFrame, label: str, limit: int, key: str = "doc_id", text: str = "text") -> M:
    """What ``fit`` makes of the sample. One task gathers the texts and fits, so the driver holds the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, int(y)) for batch in batches for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    rows = drawn(docs, labels, label, limit, key, text).repartition(1).sortWithinPartitions("k").select("t", "y")
    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit([])  # no task runs where the plan is known to be empty


def hashed(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass"))


class Vocabulary:
    """Texts as arrays of token numbers, and the features of each token as numbers too: what a fit keeps of its sample."""

    def __init__(self, texts: list[str], split: Callable[[str], list[str]], features: Callable[[str], Sequence[int]], width: int):
        numbers: dict[str, int] = {}
        self.texts = [np.fromiter((numbers.setdefault(t, len(numbers)) for t in split(text)), np.int32) for text in texts]
        self.tokens = list(numbers)
        table = np.zeros((len(numbers), width), np.uint64)
        given = np.zeros((len(numbers), width), bool)
        for i, token in enumerate(self.tokens):
            own = features(token)
            table[i, : len(own)], given[i, : len(own)] = own, True
        self.hashes, at = np.unique(table[given], return_inverse=True)
        self.features = np.full(table.shape, -1, np.int32)
        self.features[given] = at

    def telling(self, classes: np.ndarray, n_classes: int, least: int, most: int) -> np.ndarray:
        """Numbers of the features whose share of documents differs most between the classes, by the largest z-score against independence."""
        counts = np.zeros((n_classes, len(self.hashes)))
        for text, c in zip(self.texts, classes, strict=True):
            own = runtime.distinct(self.features[runtime.distinct(text)].reshape(-1))
            counts[c, own[own >= 0]] += 1
        share = np.bincount(classes, minlength=n_classes)[:, None] / len(classes)
        mean = counts.sum(axis=0) * share
        z = (np.abs(counts - mean) / np.sqrt(np.maximum(mean * (1 - share), 1e-9))).max(axis=0)
        good = np.flatnonzero((counts.sum(axis=0) >= least) & (z >= 2.5))
        return good[np.lexsort((self.hashes[good], -z[good]))][:most]
