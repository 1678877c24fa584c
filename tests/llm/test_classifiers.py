import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import labelled, quality, queries, toxicity


def bags(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "su"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        if bad := i % 3 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['vile', 'grubest', 'grubling'])} {word()}")
        rows.append((". ".join(sentences) + ".", int(bad)))
    return rows


def test_toxicity_learns_sentences_from_documents():
    model = toxicity.fit(bags(600, 1))
    scorer = toxicity.Scorer(model)
    found = [(scorer.score(t) >= 0.3, y) for t, y in bags(300, 2)]
    assert np.mean([a == bool(b) for a, b in found]) > 0.97
    assert scorer.score("tare nosu. you grubbery no. lire.") > 0.3  # a beginning that it knows
    text = "Tare nosu li. You vile ta! Lire su"
    (start, end, _), = [x for x in scorer.located(text) if x[2] > 0.3]
    assert text[start:end] == "You vile ta!"


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "vile", 5), (4, "x" * 200_000, 5), (4, "a", 5)], "doc_id long, text string, score int")
    model = toxicity.fit(bags(200, 3))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and [r.score for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert toxicity.score(docs.where("false"), model).count() == 0
    for few in ([], [("a b", 1)], [("a b", 0)]):
        assert 0 <= toxicity.Scorer(toxicity.fit(few)).score("a. b") <= 1


def graded(n, seed):
    """Ratings 0 to 3: the more shouting, the lower."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["of", "the", "in", "an"]) + rng.choice(["ta", "re", "no"]) for _ in range(rng.randint(30, 90))]
        share = (3 - i % 4) / 4 + rng.random() * 0.1
        rows.append((" ".join(w.upper() + "!!" if rng.random() < share else w for w in words), i % 4))
    return rows


def test_ordinal_grades():
    model = quality.fit(graded(600, 1))
    assert model.grades == (0, 1, 2, 3) and list(model.thresholds) == sorted(model.thresholds)
    scorer = quality.Scorer(model)
    rows = graded(200, 2)
    p = model.probabilities(np.array([scorer.position(t) for t, _ in rows]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    expected = p @ np.arange(4)
    assert np.mean(np.abs(expected - [g for _, g in rows])) < 0.45
    assert np.mean(np.abs(expected - [g for _, g in rows]) < 1) > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "OF!! THE!! TA!! OFTA!! INRE!! ANNO!! INTA!! THERE!!" * 9, "c"), (4, "ofta there inno anre ofno " * 9, "d")], "doc_id long, text string, expected_grade string")
    model = quality.fit(graded(400, 3))
    rows = {r.doc.expected_grade: r for r in quality.grade(docs, model, 2).collect()}
    assert rows["c"].tail_probability < 0.1 < 0.9 < rows["d"].tail_probability
    kept = quality.select(docs, model, 2)
    assert kept.columns == docs.columns and "d" in [r.expected_grade for r in kept.collect()]
    assert quality.select(docs.where("false"), model).count() == 0
    assert quality.select(docs, quality.fit([])).count() == 4
    only = quality.grade(docs, quality.fit([("a", 1), ("b", 1)])).collect()
    assert {r.tail_probability for r in only} == {1.0}


@pytest.mark.parametrize("name,label,column", [("op1_toxicity", "toxic", "predicted"), ("op9_quality", "quality", "kept")])
def test_held_out_accuracy(spark, name, label, column):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    right = got.where("held_out").join(labels, "doc_id").select(F.avg((F.col(column) == F.col(label)).cast("int"))).first()[0]
    assert right > 0.95


def test_sample_is_bounded_and_leaves_held_out(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int"))
    out = {r.text for r in docs.where(labelled.held_out(F.col("doc_id"))).collect()}
    rows = labelled.sample(docs, labels, "toxic", 1000)
    assert {t for t, _ in rows} == {f"t{i}" for i in range(100)} - out
    assert len(labelled.sample(docs, labels, "toxic", 10)) == 10


def test_shape_of_a_whole_word():
    assert quality.shape("a1" * 40 + "!") != quality.shape("a1" * 40 + "?") and quality.shape("x" * 70 + "!") == "a!"


def test_scores_equal_a_plain_noisy_or(spark):
    """The registered scorer against sums over single features, sentence by sentence."""
    sf = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = toxicity.train(docs, labels)

    def plain(text):
        kept = 1.0
        for sentence in re.split(r"[.!?\n]+", text or ""):
            words = re.findall(r"[^\W_]+", sentence.lower())
            if words:
                features = [f for w in words for f in ["w" + w, *(f"b{n}{w[:n]}" for n in (4, 5, 6) if len(w) > n)]]
                z = model.bias + sum(model.weights.get(labelled.hashed(f), 0.0) for f in features)
                kept *= 1 - 1 / (1 + math.exp(-z))
        return 1 - kept

    rows = toxicity.score(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert model.weights and len(rows) == len(texts)
    assert all(abs(r.score - plain(texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_grades_equal_a_plain_cumulative_link(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    model = quality.train(docs, labels)

    def plain(text):
        words = (text or "").split()
        own = set(words)
        by_word = sum(model.weights.get(labelled.hashed("w" + w.lower()), 0.0) for w in own) / (len(own) + quality.PRIOR)
        shapes = sum(model.weights.get(labelled.hashed("s" + quality.shape(w)), 0.0) for w in words)
        again = sum(a == b for a, b in zip(words, words[1:])) * model.weights.get(labelled.hashed("again"), 0.0)
        position = by_word + (shapes + again) / (len(words) + quality.PRIOR)
        return 1 - 1 / (1 + math.exp(-(model.thresholds[0] - position)))  # two grades: the tail of the upper one

    assert model.grades == (0, 1)
    for r in quality.grade(docs, model).collect():
        assert abs(r.tail_probability - plain(r.doc.text)) < 1e-9 and abs(r.expected_grade - r.tail_probability) < 1e-9


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"good words here {i % 2}", 1) for i in range(40)], "doc_id long, text string, k int")
    labels = spark.createDataFrame([(i % 5, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    assert len(labelled.sample(docs, labels, "toxic", 100)) <= 5  # one text and the largest label for each document
    for got in (toxicity.score(docs, toxicity.train(docs, labels)), quality.grade(docs, quality.train(docs, labels)).select("doc.doc_id", "expected_grade")):
        rows = got.collect()
        assert len(rows) == 40 and len(set(map(tuple, got.select(*got.columns[:2]).distinct().collect()))) <= 10


def test_very_long_text_is_graded(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "x" * 500_000)], "doc_id long, text string")
    assert quality.grade(docs, quality.fit(graded(200, 5))).count() == 2


def test_quality_is_fitted_off_the_driver(spark, monkeypatch):
    """The driver gets the model alone, the same that the collected sample gives; an empty sample gives a model without grades."""
    docs, labels = (queries.table(spark, "/root/testdata/sf0.001", x) for x in ("documents", "labels"))
    want = quality.fit(labelled.sample(docs, labels, "quality", 1000), rounds=20)
    collected, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.extend(rows := collect(self)) or rows)
    assert want.weights and quality.train(docs, labels, sample_docs=1000, rounds=20) == want
    assert len(collected) == 1 and not any(isinstance(x, str) for x in collected[0])
    assert quality.train(docs, labels.where("quality > 1")) == quality.fit([])
    assert quality.train(docs.where("false"), labels) == quality.fit([])
