import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import merkle

TEXTS = ["", "One two.", "a b c d e f g h i j. k l\n\nsecond section here.\nits line  \n", "\n\n\n", "x" * 5000, "é ü. ñ!\tß? one.two three", "a b c d e f g h i j. k l\n\nsecond section here.\nits line changed", " lead", "trail ", "trail"]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(text):
    sections = []
    for s in text.split("\n\n"):
        sections.append([[h(m.group()) for m in re.finditer(merkle.LEAF, p)] for p in s.split("\n")])
    ph = lambda p: h(",".join(p))
    sh = lambda s: h(",".join(map(ph, s)))
    written = "|".join(sh(s)[:12] + "(" + ";".join(ph(p)[:12] + ":" + ",".join(x[:12] for x in p) for p in s) for s in sections)
    return h(",".join(map(sh, sections))) + "/" + written, {x[:12] for s in sections for p in s for x in p}


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("rows", [[], [(5, "only one. text")], [(i * 7 % 13, t) for i, t in enumerate(TEXTS)], [(None, "null key"), (3, None), (3, "same key"), (1, "x y z"), (1, "x y z")]])
def test_edited_by_next(spark, rows):
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, tree string")
    got = merkle.edited_by_next(docs).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        want.append((i, len(t), e, plain(t)[0], plain(e)[0], round(like(plain(t)[1], plain(e)[1]), 9), round(like(plain(t)[1], plain(n)[1]), 9)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=key) == sorted(want, key=key)


def test_leaves_cover_the_text():
    for t in TEXTS:
        for p in t.split("\n"):
            assert "".join(m.group() for m in re.finditer(merkle.LEAF, p)) == p


def test_differing_branches(spark):
    df = spark.createDataFrame([(TEXTS[2], TEXTS[6])], "a string, b string")
    row = df.select(merkle.differing(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d")).first()
    assert [(x.section, x.paragraph) for x in row.d] == [(1, 1), (1, 2)]


def test_buckets_keep_order(spark):
    bounds = [3, 5, 8, 8, 13, 40, 41, 90]
    df = spark.range(100).select("id", merkle._bucket(F.col("id"), sorted(set(bounds))).alias("b"))
    assert all(r.b == sum(x < r.id for x in set(bounds)) for r in df.collect())


def test_many_partitions_make_a_short_plan(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        merkle.with_next(docs.limit(10))  # starts up
        start = time.time()
        merkle.with_next(docs)
        assert time.time() - start < 8  # the counts by bucket run in it
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
