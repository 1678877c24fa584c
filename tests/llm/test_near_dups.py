import random

import numpy as np
import pytest

from scriptorium.llm import near_dups


def plain_weights(text, width=5):
    words = near_dups.WORDS.findall(text or "")
    runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
    return {r: 1 + np.log(runs.count(r)) for r in set(runs)}


def plain_similarity(a, b):
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a.get(z, 0) / a[x], b.get(z, 0) / b[x]) for z in a.keys() | b.keys())
    return total


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("tare nosu limo veka dopi sula") + str(rng.randrange(400))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 80, 200]))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts.append(["again"] * 90 + ["a", "b", "c", "d", "e", "f"])
    return [" ".join(t) for t in texts] + ["", None, " \n", "one", "one"]


def plain_classes(rows, threshold):
    sets = [(i, plain_weights(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and (a == b if not a or not b else plain_similarity(a, b) >= threshold):
                x, y = sorted((root[i], root[j]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def test_similarity_equals_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ({int(k): float(rng.random() + 0.1) for k in rng.integers(0, 12, rng.integers(1, 10))} for _ in range(2))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dups.probability_jaccard(*arrays) == pytest.approx(plain_similarity(a, b))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 2**63, 150).astype(np.uint64)
        weights = rng.random(150) * 3 + 0.2
        cut = rng.integers(20, 60)
        a, b = near_dups.weighted(both[:-cut]), near_dups.weighted(both[cut // 2 :])
        order = np.argsort(both)
        weight_of = dict(zip(both[order], weights[order]))
        a, b = ((x[0], np.array([weight_of[k] for k in x[0]])) for x in (a, b))
        s = near_dups.sketches([a, b])
        errors.append((s[0] == s[1]).mean() - near_dups.probability_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_a_set_is_sketched_alike_in_any_company():
    rng = np.random.default_rng(2)
    sets = [near_dups.weighted(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 40, 700, 5)]
    together = near_dups.sketches(sets)
    assert all((near_dups.sketches([s])[0] == row).all() for s, row in zip(sets, together))


def test_classes(spark):
    texts = corpus(7)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(None, "one")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in near_dups.classes(docs).collect()}
    assert got == plain_classes(rows, 0.8)
    kept = near_dups.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(got.values()))


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 3])):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_classes(rows, 0.8)
    assert 1 < len(set(want.values())) < 60
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.classes(docs).count() == 0 and near_dups.representatives(docs).count() == 0


def test_buckets_of_many_blocks_and_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for i in range(30):
            copy = list(base)
            for at in rng.sample(range(100), rng.choice([0, 1, 2, 4, 7])):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(copy)))
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows, 0.8)


def test_recall_and_very_long_texts(spark):
    """Pairs just above the threshold, and a text of 300 000 words."""
    rng = random.Random(11)
    rows = []
    for i in range(150):
        base = [f"p{i}w{j}" for j in range(200)]
        copy = list(base)
        for at in rng.sample(range(0, 200, 5), 3):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    long = " ".join(f"l{j}" for j in range(300_000))
    rows += [(1000, long), (1001, long + " end"), (1002, "l" * 1_000_000)]
    got = {r.doc_id: r.class_id for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = [(a, b) for (a, s), (b, t) in zip(rows[:300:2], rows[1:300:2]) if plain_similarity(plain_weights(s), plain_weights(t)) >= 0.8]
    assert len(alike) > 100
    assert np.mean([got[a] == got[b] for a, b in alike]) >= 0.99
    assert got[1001] == 1000 and got[1002] == 1002
