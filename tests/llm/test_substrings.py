import hashlib
import random

import numpy as np
import pytest

from scriptorium.llm import substrings


def plain(rows, window):
    """(key, text) rows to (key, words, removed, digest)."""
    least = {}
    split = [(k, substrings.WORDS.findall(t or "")) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if k is not None:
                least[run] = min(k, least.get(run, k))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if k is not None and least[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    passages = [[word() for _ in range(rng.choice([18, 20, 21, 25, 60]))] for _ in range(6)] + [["same"] * 40]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(5)):
            t += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(t))
    texts += texts[:9] + [texts[3] + " ", None, "", "same " * 19, "same " * 20, "same " * 90]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = [(i * 7 % 101 if i != 5 else None, t) for i, t in enumerate(corpus(seed))]
    rows += [(3, rows[0][1]), (3, (rows[1][1] or "") + " more words"), (rows[2][0], rows[2][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    found = substrings.without_repeats(docs, window=20).collect()
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == plain(rows, 20)
    for r in found:
        assert hashlib.sha256(" ".join(substrings.WORDS.findall(r.kept)).encode()).hexdigest() == r.kept_sha256
        assert r.n_removed or r.kept == (r.doc.text or "")


def test_empty_table(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces():
    rng = np.random.default_rng(0)
    for _ in range(100):
        x, width = rng.integers(0, 99, 30).astype(np.uint64), int(rng.integers(1, 30))
        assert list(substrings.least_of(x, width)) == [min(x[i : i + width]) for i in range(31 - width)]
        starts = rng.integers(0, 30, 4)
        assert list(substrings.covered(starts, width, 30)) == [any(s <= i < s + width for s in starts) for i in range(30)]
