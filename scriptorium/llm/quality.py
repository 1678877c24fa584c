"""Document quality by ordinal cumulative-link regression on graded ratings.

One set of weights over hashed text features gives every document a position on a line; ordered thresholds cut the line into
grades: P(grade <= j) = logistic(threshold_j - position). From it come the expected grade and the probability of reaching a
grade, by which documents are selected. Features are hashed words and word shapes (``A!!``, ``a$$$``, ``|``), and words that
repeat the one before them. A document's value of a word is one over its number of distinct words, that of a shape or of repetition
its share of all words, so length alone doesn't count; ``PRIOR`` words are added to either number, so that few words say little.
The model is fitted on a bounded sample (``sample_docs``) of rated documents, in one task.

Defined results: null and empty texts get the position 0 of a text without features; with fewer than two grades in the sample
every document gets the only grade (or null without any); repeated rows are graded alike; the key may be null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import labelled, runtime

WORDS = re.compile(r"[^\s]+")
AGAIN = labelled.hashed("again")
PRIOR = 8


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 0; other characters as themselves, at most thrice."""
    plain = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c for c in word)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"([Aa0])\1+", r"\1", plain))


def word_features(word: str) -> tuple[int, int]:
    return labelled.hashed("w" + word.lower()), labelled.hashed("s" + shape(word))


def repeated(words: list[str]) -> int:
    return sum(a == b for a, b in zip(words, words[1:], strict=False))


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    thresholds: tuple[float, ...]
    grades: tuple[int, ...]

    def probabilities(self, position: np.ndarray) -> np.ndarray:
        """A column for each grade."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - position[:, None], -500, 500)))
        edges = np.hstack([np.zeros((len(position), 1)), below, np.ones((len(position), 1))])
        return np.diff(edges, axis=1)


class Scorer(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.again = model.weights.get(AGAIN, 0.0)

    def __missing__(self, word: str) -> tuple[float, float]:
        if len(self) >= runtime.CACHE_ENTRIES:
            self.clear()
        of_word, of_shape = word_features(word)
        value = self[word] = self.model.weights.get(of_word, 0.0), self.model.weights.get(of_shape, 0.0)
        return value

    def position(self, text: str | None) -> float:
        counts = Counter(words := WORDS.findall(text or ""))
        by_word = by_shape = 0.0
        for word, n in counts.items():
            of_word, of_shape = self[word]
            by_word += of_word
            by_shape += of_shape * n
        return by_word / (len(counts) + PRIOR) + (by_shape + self.again * repeated(words)) / (len(words) + PRIOR)


def fit(rows: list[tuple[str, int]], features: int = 4000, least: int = 4, rounds: int = 200, rate: float = 0.3, shrink: float = 1e-3) -> Model:
    """Weights and thresholds by AdaGrad on the cumulative-link likelihood."""
    grades = tuple(sorted({g for _, g in rows}))
    if len(grades) < 2:
        return Model({}, (), grades)
    y = np.array([grades.index(g) for _, g in rows])
    known = labelled.Vocabulary([text for text, _ in rows], WORDS.findall, word_features, 2)
    chosen = known.telling(y, len(grades), least, features)
    column_of = np.full(len(known.hashes) + 1, -1)  # the last place is that of a missing feature
    column_of[chosen] = np.arange(len(chosen))
    n = len(chosen) + 1  # the last column is that of repetition
    places, columns, values = [], [], []
    for d, words in enumerate(known.texts):
        own, counts = np.unique(words, return_counts=True)
        of_word, of_shape = column_of[known.features[own]].reshape(-1, 2).T
        total = np.bincount(of_word[of_word >= 0], minlength=n) / (len(own) + PRIOR)
        total += np.bincount(of_shape[of_shape >= 0], counts[of_shape >= 0], n) / (len(words) + PRIOR)
        total[-1] = (words[1:] == words[:-1]).sum() / (len(words) + PRIOR)
        at = np.flatnonzero(total)
        places.append(np.full(len(at), d))
        columns.append(at)
        values.append(total[at])
    place, column, value = (np.concatenate(x) for x in (places, columns, values))
    scale = np.sqrt(np.bincount(column, value**2, n) / np.maximum(np.bincount(column, minlength=n), 1)) + 1e-3
    x = value / scale[column]
    reached = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    first, steps = float(np.log(reached[0] / (1 - reached[0]))), np.log(np.maximum(np.diff(np.log(reached / (1 - reached))), 1e-2))
    w, seen = np.zeros(n), np.full(n, 1e-8)
    t, seen_t = np.concatenate([[first], steps]), np.full(len(grades) - 1, 1e-8)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    rows_at = np.arange(len(y))
    for _ in range(rounds):
        cuts = np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:]))])  # in order by construction
        z = np.bincount(place, w[column] * x, len(y))
        s = np.hstack([np.zeros((len(y), 1)), sigmoid(cuts[None, :] - z[:, None]), np.ones((len(y), 1))])
        upper, lower = s[rows_at, y + 1], s[rows_at, y]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gz = (du - dl) / len(y)
        gw = np.bincount(column, gz[place] * x, n) + shrink * w
        gc = np.array([(-du[y == j].sum() + dl[y == j + 1].sum()) / len(y) for j in range(len(cuts))])
        gt = np.array([gc.sum(), *(gc[j:].sum() * np.exp(t[j]) for j in range(1, len(t)))])
        seen, seen_t = seen + gw**2, seen_t + gt**2
        w -= rate * gw / np.sqrt(seen)
        t -= rate * gt / np.sqrt(seen_t)
    cuts = np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:]))])
    hashes = [*map(int, known.hashes[chosen]), AGAIN]
    return Model({f: float(v) for f, v in zip(hashes, w / scale, strict=True) if v}, tuple(map(float, cuts)), grades)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 8000, **options) -> Model:
    return labelled.fitted(partial(fit, **options), docs, labels, label, sample_docs)


def grade(docs: DataFrame, model: Model, least_grade: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``doc``, and ``expected_grade`` and ``tail_probability``, that of ``least_grade`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as many weights as the model was fitted with

    @F.pandas_udf("struct<expected_grade double, tail_probability double>")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m)
        for texts in batches:
            if not m.grades:
                yield pd.DataFrame({"expected_grade": [None] * len(texts), "tail_probability": [None] * len(texts)}, dtype=float)
                continue
            p = m.probabilities(np.array([scorer.position(t) for t in texts]))
            g = np.array(m.grades, float)
            yield pd.DataFrame({"expected_grade": p @ g, "tail_probability": p[:, g >= least_grade].sum(axis=1)})

    graded = graded.asNondeterministic()  # else a filter on a grade would have it computed twice
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("graded", graded(F.col(f"doc.{text}").cast("string")))
    return rows.select("doc", "graded.expected_grade", "graded.tail_probability")


def select(docs: DataFrame, model: Model, least_grade: int = 1, least_probability: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, that reach the grade with the probability; ungraded ones stay."""
    kept = grade(docs, model, least_grade, key, text).where(F.coalesce(F.col("tail_probability") >= least_probability, F.lit(True)))
    return kept.select("doc.*")
