import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import manifest


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(leaves, arity):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][i : i + arity])) for i in range(0, len(found[-1]), arity)])
    return found


def siblings(of, place, arity):
    found = []
    for level in of[:-1]:
        first = place - place % arity
        found.append(("".join(level[first:place]), "".join(level[place + 1 : first + arity])))
        place //= arity
    return found


def written(*fields):
    return "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def plain(rows, arity):
    """Per row (doc_id, lang, text): leaf, subroot, root and proof, sorted."""
    leaf = lambda r: h(written(*r))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = {lang: levels([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])], arity) for lang in order}
    top = levels([found[lang][-1][0] for lang in order], arity)
    out = []
    for k, lang in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            out.append((str(r[0]), own, found[lang][-1][0], top[-1][0], str(siblings(found[lang], i, arity) + siblings(top, k, arity))))
    return sorted(out)


def run(spark, rows, arity=2):
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, lang string, text string, proof string, place int")
    leaf = manifest.digest(manifest.written(F.col("doc_id"), F.col("lang"), F.col("text")))
    return manifest.manifest(docs, leaf, "doc_id", "lang", arity=arity)


RANDOM = random.Random(1)
ROWS = {
    "none": [],
    "one": [(5, "en", "only")],
    "odd": [(None, None, None), (None, "en", "null key"), (3, None, ""), (3, None, ""), (3, None, "same key"), (-7, "en", "x" * 300_000), (4, "é", "é"), (4, "z", "z"), (5, "", "empty lang")],
    "hot": [(i * 37 % 701, RANDOM.choice(["a"] * 6 + ["b", "c", None]), f"text {i}") for i in range(600)],
    "repeated": [(1, "a", "same")] * 40 + [(2, "b", "other")],
}


@pytest.mark.parametrize(("name", "arity"), [("none", 2), ("one", 2), ("odd", 2), ("hot", 2), ("hot", 3), ("repeated", 2)])
def test_equals_plain_trees(spark, monkeypatch, name, arity):
    monkeypatch.setattr(manifest, "_step", lambda arity: 2)  # blocks of two levels: many rounds, many open nodes
    found = run(spark, ROWS[name], arity)
    got = found.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.folded == r.root for r in got)
    own = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(x.before, x.after) for x in r.proof])) for r in got)
    want = plain(ROWS[name], arity)
    assert own == want


def test_proof_digest_and_tampering(spark):
    row = run(spark, ROWS["hot"]).withColumn("d", manifest.proof_digest(F.col("proof"))).withColumn("f", manifest.folded(F.lit(h("changed")), F.col("proof"))).first()
    assert row.d == h("".join(x.before + x.after for x in row.proof)) and row.f != row.root


def test_parents_in_any_order():
    leaves = [h(str(i)) for i in range(23)]
    for arity in (2, 3, 5):
        for seed in range(5):
            order = list(range(23))
            random.Random(seed).shuffle(order)
            parts = [manifest.Parents(23, arity, 99) for _ in range(3)]
            for i, x in enumerate(order):
                parts[i % 3].enter(0, x, leaves[x])
            whole = parts[0].merge(parts[1]).merge(parts[2])
            assert list(whole.open.values()) == [levels(leaves, arity)[-1][0]] and not whole.partial
            assert all(links == siblings(levels(leaves, arity), place, arity) for _, place, _, _, links in whole.ways())


def test_fields_are_told_apart(spark):
    row = spark.range(1).select(manifest.written(F.lit("ab"), F.lit(None).cast("string"), F.lit("é"), F.lit(-12)).alias("w")).first()
    assert row.w == "2:ab-2:é3:-12"


def test_arity(spark):
    with pytest.raises(ValueError):
        run(spark, ROWS["one"], 1)
