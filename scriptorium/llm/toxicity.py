"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its hashed words and word beginnings; a document's is the noisy-or of its
sentences', so a single bad sentence suffices and a label on the document teaches which sentences are bad. The model is fitted on
a bounded sample (``sample_docs``) and holds at most ``features`` weights; scoring is one pass over whole texts.

Defined results: null and empty texts have no sentence and score 0; without labels of both kinds the score is the share of
label 1 for every text with a sentence; repeated rows score alike; the key may be null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import labelled, runtime

BEGINNINGS = (4, 5, 6)


def word_features(word: str) -> list[int]:
    word = word.lower()
    return [labelled.hashed("w" + word), *(labelled.hashed(f"b{n}{word[:n]}") for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float


class Scorer(dict):
    """Weights of tokens; a token that ends a sentence has weight NaN."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= runtime.CACHE_ENTRIES:
            self.clear()
        if token[0] in ".!?\n":
            value = np.nan
        else:
            value = sum(self.model.weights.get(f, 0.0) for f in word_features(token))
        self[token] = value
        return value

    def sentences(self, tokens: list[str]) -> np.ndarray:
        """The logits of a text's sentences."""
        w = np.fromiter(map(self.__getitem__, tokens), float, len(tokens))
        ends = np.isnan(w)
        words = ~ends
        if not words.any():
            return np.empty(0)
        number = np.cumsum(ends)[words]
        sums = np.bincount(number - number[0], w[words])
        full = np.bincount(number - number[0]) > 0
        return sums[full] + self.model.bias

    def score(self, text: str | None) -> float:
        z = self.sentences(labelled.TOKENS.findall(text)) if text else np.empty(0)
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def located(self, text: str | None) -> list[tuple[int, int, float]]:
        """``start, end, probability`` of each sentence, in characters of the text."""
        out: list[tuple[int, int, float]] = []
        first, last, total = -1, 0, 0.0
        for m in labelled.TOKENS.finditer((text or "") + "\n"):
            w = self[m.group()]
            if w != w:
                if first >= 0:
                    out.append((first, min(m.end(), len(text or "")), float(1 / (1 + np.exp(-total - self.model.bias)))))
                first, total = -1, 0.0
            else:
                first, last, total = (m.start() if first < 0 else first), m.end(), total + w
        return out


def fit(rows: list[tuple[str, int]], features: int = 4000, least: int = 4, rounds: int = 150, rate: float = 0.5, shrink: float = 2e-5) -> Model:
    """Weights by AdaGrad on the noisy-or likelihood of document labels."""
    y = np.array([min(1, max(0, label)) for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(max(share, 1e-12)) - np.log(max(1 - share, 1e-12))))
    known = labelled.Vocabulary([text for text, _ in rows], labelled.TOKENS.findall, lambda t: [] if t[0] in ".!?\n" else word_features(t), 1 + len(BEGINNINGS))
    ends = np.array([t[0] in ".!?\n" for t in known.tokens], bool)
    chosen = known.telling(y.astype(int), 2, least, features)
    column_of = np.full(len(known.hashes) + 1, -1)  # the last place is that of a missing feature
    column_of[chosen] = np.arange(len(chosen))
    bags, places, columns, n = [], [], [], 0  # document of a sentence; sentence and feature of a hit
    for d, tokens in enumerate(known.texts):
        words = ~ends[tokens]
        if not words.any():
            continue
        _, sentence = np.unique(np.cumsum(~words)[words], return_inverse=True)
        hits = column_of[known.features[tokens[words]]]
        at, _ = np.nonzero(hits >= 0)
        bags.append(np.full(sentence.max() + 1, d))
        places.append(n + sentence[at])
        columns.append(hits[hits >= 0])
        n += sentence.max() + 1
    if not n:
        return Model({}, 0.0)
    bag, place, column = (np.concatenate(x).astype(np.int64) for x in (bags, places, columns))
    per = np.bincount(bag, minlength=len(y))
    share = y.mean()
    bias = float(np.log(share / max(1.0, per.mean())))
    w, seen, seen_bias = np.zeros(len(chosen)), np.full(len(chosen), 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(place, w[column], n) + bias
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(bag, np.logaddexp(0, z), len(y)))  # probability that no sentence is bad
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = pull[bag] * p / len(y)
        gw = np.bincount(column, g[place], len(chosen)) + shrink * w
        gb = g.sum()
        seen, seen_bias = seen + gw**2, seen_bias + gb**2
        w -= rate * gw / np.sqrt(seen)
        bias -= rate * gb / np.sqrt(seen_bias)
    return Model({int(f): float(x) for f, x in zip(known.hashes[chosen], w, strict=True) if abs(x) > 1e-4}, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = 8000, **options) -> Model:
    return fit(labelled.sample(docs, labels, label, sample_docs), **options)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``<key>, score, predicted, sentences``: the noisy-or score, whether it reaches ``least``, and the offending sentences of predicted documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as many weights as the model was fitted with

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = [scorer.score(t) for t in texts]
            where = [[{"start": a, "end": b, "probability": p} for a, b, p in scorer.located(t) if p >= least / 2] if s >= least else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= least) for s in scores], pa.int32()), pa.array(where, kind)], ["k", "score", "predicted", "sentences"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    schema = f"k {dict(docs.dtypes)[key]}, score double, predicted int, sentences array<struct<start:int,end:int,probability:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
