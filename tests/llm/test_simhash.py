import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import components, queries, simhash
from scriptorium.operators import ordinals


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def least(codes, keys, distance):
    """The least key of each row's component, by all pairs."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(np.array(codes[:i], np.uint64) ^ np.uint64(x)) <= distance):
            root[find(i)] = find(int(j))
    lowest = {}
    for i, k in enumerate(keys):
        if k is not None:
            lowest[find(i)] = min(lowest.get(find(i), k), k)
    return [lowest.get(find(i)) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É É É d e\x85f", "a b a b a b a b", "x " * 70_000, "w" * 200_000, "the\x1cquick brown\x0bfox"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_counts_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 7)
    text = " ".join(f"w{i % 13} v{i}" for i in range(50))
    assert simhash.fingerprint(text) == plain(text)


def test_gray_rank(spark):
    codes = [i ^ i >> 1 for i in (0, 1, 2, 5, 1 << 40, (1 << 63) + 7, (1 << 64) - 1)]
    rows = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "i int, c long")
    assert [r.i for r in rows.orderBy(simhash.gray_rank(F.col("c"))).collect()] == list(range(7))


@pytest.mark.parametrize("kind", ["random", "near", "dense", "one", "none"])
def test_links_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "FAN", 3)
    draw = random.Random(3)
    codes = {"random": [draw.getrandbits(64) for _ in range(300)], "dense": list(range(256)), "one": [9], "none": []}.get(kind)
    if kind == "near":  # chains of one, two and three changed bits
        codes = [draw.getrandbits(64) for _ in range(40)]
        for _ in range(260):
            x = draw.choice(codes)
            for b in draw.sample(range(64), draw.choice([1, 2, 2, 3, 3])):
                x ^= 1 << b
            codes.append(x)
        codes = sorted(set(codes))
    signed = [x - (1 << 64) if x >> 63 else x for x in codes]
    rows = spark.createDataFrame([(x,) for x in signed], "f long").withColumn("rank", simhash.gray_rank(F.col("f")))
    ranked = ordinals.numbered(rows, ["rank"])
    members = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "f"))), lambda x: x["f"])
    blocks = ranked.groupBy(F.expr("ordinal div 16L").alias("node")).agg(members.alias("members")).cache()
    found = simhash.links(blocks, simhash.near_blocks(simhash.levels(blocks), 2), 2)
    roots = {r.node: r.root for r in components.components(found).collect()}
    own = [roots.get(x, x) for x in signed]
    assert own == least(codes, signed, 2)


def test_upper_nodes_prune(spark):
    draw = random.Random(5)
    codes = sorted(draw.getrandbits(63) for _ in range(4000))
    rows = spark.createDataFrame([(x,) for x in codes], "f long").withColumn("rank", simhash.gray_rank(F.col("f")))
    blocks = ordinals.numbered(rows, ["rank"]).groupBy(F.expr("ordinal div 8L").alias("node")).agg(F.collect_list("f").alias("members")).cache()
    assert blocks.count() == 500
    assert simhash.near_blocks(simhash.levels(blocks), 2).count() < 500 * 501 / 2 / 4  # of all pairs of blocks


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (5, "A B\tC  D"), (None, "q r s"), (9, None), (8, ""), (3, " "), (2, "t u v w x y z")]])
def test_documents(spark, rows):
    docs = spark.createDataFrame([(*r, "kept", 1.5) for r in rows], "doc_id long, text string, f string, least double")
    got = simhash.classes(docs).collect()
    want = list(zip([str(k) for k, _ in rows], [f"{plain(t):016x}" for _, t in rows], least([plain(t) for _, t in rows], [k for k, _ in rows], 2)))
    assert sorted(map(str, ((str(r.doc_id), r.fingerprint, r.component_id) for r in got))) == sorted(map(str, want))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    codes = [plain(d.text) for d in docs]
    want = {d.doc_id: (f"{c:016x}", k) for d, c, k in zip(docs, codes, least(codes, [d.doc_id for d in docs], 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12_simhash(spark, sf).collect()} == want
