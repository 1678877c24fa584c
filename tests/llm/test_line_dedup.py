import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import components, line_dedup, queries, runtime


def plain(rows, threshold):
    """Removed line numbers by document: every pair of lines compared."""
    size = line_dedup.SHINGLE
    runs = lambda s: {s[i : i + size] for i in range(max(1, len(s) - size + 1))}
    lines = [(k, n, x) for k, t in rows if k is not None for n, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = sorted({x for _, _, x in lines})
    sets, root = [runs(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    of, heads = {x: root[i] for i, x in enumerate(texts)}, {}
    for k, n, x in lines:
        heads[of[x]] = min(heads.get(of[x], (k, n)), (k, n))
    out = {}
    for k, n, x in lines:
        if heads[of[x]] != (k, n):
            out.setdefault(k, []).append(n)
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "ing", "tion", "er", "né", "ou", "😀a"]) for _ in range(rng.randint(1, 4)))
    bases = [" ".join(word() for _ in range(rng.choice([1, 4, 15, 22, 60]))) for _ in range(12)] + ["x", "a|b"]
    rows = []
    for k in range(50):
        lines = []
        for _ in range(rng.randrange(6)):
            words = rng.choice(bases).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = word()
            lines.append(" ".join(words) if rng.random() < 0.9 else rng.choice(["", "  "]))
        rows.append((k * 7 % 53, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 32), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = [*corpus(seed), (None, corpus(seed)[0][1]), (60, None), (61, ""), (62, "one\none\n\none"), (63, "y" * 30_000 + "\n" + "y" * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string")
    got = {r.k: r.removed for r in line_dedup.removed_lines(docs).collect()}
    want = plain(rows, 0.8)
    assert got == want
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()}
    for k, t in rows:
        lines = (t or "").split("\n")
        left = "\n".join(x for n, x in enumerate(lines) if k is None or n not in want.get(k, []))
        if k in want and not left.strip():
            assert k not in kept
        else:
            assert kept[k] == (left if k in want else t)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.removed_lines(docs).count() == 0 and line_dedup.without_lines(docs).count() == 0


def test_equal_sets_of_runs_meet_at_any_length(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        unit = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz=-") for _ in range(rng.randint(1, 12)))
        rows += [(2 * k, (unit * 120)[: rng.randint(40, 140)]), (2 * k + 1, (unit * 120)[: rng.randint(260, 900)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.k: r.removed for r in line_dedup.removed_lines(docs).collect()} == {2 * k + 1: [0] for k in range(30)}


def test_short_lines_meet_as_often_as_stated(spark):
    rng = random.Random(7)
    lines = ["".join(chr(rng.randrange(97, 123)) for _ in range(17)) for _ in range(2000)]  # ten runs; the two lines of a pair share eight
    pairs = spark.createDataFrame([(2 * i + j, s[j : j + 16]) for i, s in enumerate(lines) for j in (0, 1)], "id long, line string")
    bands = {r.id: set(r.bands) for r in line_dedup.banded(pairs).collect()}
    missed = sum(not bands[2 * i] & bands[2 * i + 1] for i in range(len(lines)))
    assert missed <= 18  # 6.4 expected


def test_registered_query(spark, tmp_path):
    rows = corpus(6)
    spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, k string, removed string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in queries.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    want = plain(rows, 0.8)
    assert got == {k: (len(t.split("\n")), len(want.get(k, [])), want.get(k, [])) for k, t in rows}


def test_many_variants_of_a_line_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng = random.Random(2)
    rows = []
    for g in range(2):
        base = "".join(rng.choice("abcdefghij ") for _ in range(200))
        for i in range(40):
            x = list(base)
            for at in rng.sample(range(200), rng.choice([0, 1, 2, 3])):
                x[at] = rng.choice("klmnopq")
            rows.append((100 * g + i, "".join(x)))
    got = {r.k: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, 0.8)


def test_components_lead_independently():
    """The leading bits of the components of any two bands are linearly independent functions of a run's two hashes."""

    def bits(i, leading):
        a, b = i * line_dedup.TURNS[0], i * line_dedup.TURNS[1]
        return [1 << (63 - n - a) % 64 | 1 << 64 + (63 - n - b) % 64 for n in range(leading)]

    def rank(rows):
        basis = {}
        for x in rows:
            while x and x.bit_length() in basis:
                x ^= basis[x.bit_length()]
            if x:
                basis[x.bit_length()] = x
        return len(basis)

    bands = [range(b * line_dedup.ROWS, (b + 1) * line_dedup.ROWS) for b in range(line_dedup.BANDS)]
    for i, x in enumerate(bands):
        for y in bands[:i]:
            assert rank([v for c in (*x, *y) for v in bits(c, 17)]) == 2 * line_dedup.ROWS * 17


def test_equal_hashes_of_unlike_lines(spark, monkeypatch):
    """Lines that agree in the first hash only are kept apart by the second."""
    whole = line_dedup.lines_of
    monkeypatch.setattr(line_dedup, "lines_of", lambda *a: whole(*a).withColumn("id", F.when(F.col("line").startswith("clash"), F.lit(7)).otherwise(F.col("id"))))
    rows = [(1, "clash one\nother line of words"), (2, "clash two\nclash one"), (3, "clash two\nother line of words"), (4, "third line of many words")]
    got = {r.k: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [1], 3: [0, 1]}


def test_search_between_blocks_joins_components_only(spark, monkeypatch):
    """Links found within blocks don't go through the second union-find; the result is that of brute force."""
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    given, whole = [], components.components
    monkeypatch.setattr(components, "components", lambda links, *a: given.append({(r.a, r.b) for r in links.collect()}) or whole(links, *a))
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij ") for _ in range(150))
    rows = [(i, "".join(x if j != 3 * i % 150 else rng.choice("klmnopq") for j, x in enumerate(base))) for i in range(40)]
    rows += [(50 + i, f"{base[:146]}{i:04d}") for i in range(8)]
    got = {r.k: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, 0.8) and len(got) == 47
    first, second = given
    assert second and not first & second and len(second) < len(first)


def test_buckets_of_equal_lines_are_searched_once(spark, monkeypatch):
    """Lines that meet in several bands are dealt for the first of them alone, also where runs repeat; the result is that of brute force."""
    dealt, whole = [], runtime.stored
    monkeypatch.setattr(runtime, "stored", lambda df, name: dealt.extend((r.band, r.id) for r in df.collect()) or whole(df, name) if name == "dealt" else whole(df, name))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(150))
    bases = [word(), word() * 3, word() + "=" * 200]
    rows = [(10 * b + i, f"{base}{i}") for b, base in enumerate(bases) for i in range(4)]
    got = {r.k: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, 0.8) and len(got) == 9
    buckets = {}
    for band, i in dealt:
        buckets.setdefault(band, set()).add(i)
    found = [frozenset(x) for x in buckets.values()]
    assert len(found) == len(set(found)) and {len(x) for x in found} <= {3, 4} and sum(len(x) == 4 for x in found) == 3


def test_large_buckets_are_counted_before_they_travel(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LARGE", 8)
    monkeypatch.setattr(line_dedup, "SEEN", 8)  # with this every line is drawn, and four of a bucket are many
    bands = spark.createDataFrame([(i, [1 if i % 2 else 100 + i // 6, 200 + i // 2, 300 + i]) for i in range(60)], "id long, bands array<long>")
    large = {r.band: r for r in line_dedup.heavy(bands).collect()}
    assert 1 in large and set(large) <= {1} and large[1].size == 30 and (large[1].a, large[1].b) == (1, 59)
    found = line_dedup.shared(bands)
    buckets = {}
    for i in range(60):
        for place, band in enumerate([1 if i % 2 else 100 + i // 6, 200 + i // 2, 300 + i]):
            buckets.setdefault((place, band), []).append(i)
    want = sorted((i, band, place, len(x), min(x), max(x)) for (place, band), x in buckets.items() if len(x) > 1 for i in x)
    assert sorted((r.id, r.band, r.place, r.size, r.a, r.b) for r in found.collect()) == want
    assert all(len({r.content for r in found.collect() if r.band == band}) == 1 for band in (1, 100, 200))


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "SEEN", 4)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij ") for _ in range(150))
    rows = [(i, base[:140] + f"{i:010d}" if i % 3 else "".join(rng.choice("xyz ") for _ in range(90))) for i in range(60)]
    got = {r.k: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows, 0.8) and len(got) > 30


def test_components_lead_by_different_bits():
    """The leading 21 bits of the components that take the least are different bits of a run's hashes, and so are those of the others; each end has half of the bands."""
    told = [line_dedup.places(i) for i in range(line_dedup.BANDS * line_dedup.ROWS)]
    assert [g for g, _, _ in told] == [False] * 12 + [True] * 12 and 12 % line_dedup.ROWS == 0
    for end in (False, True):
        assert len({(w, (t + n) % 64) for g, w, t in told if g is end for n in range(21)}) == 12 * 21


def test_longer_lines_meet_as_often_as_stated(spark):
    rng = random.Random(8)
    lines = ["".join(chr(rng.randrange(97, 123)) for _ in range(47)) for _ in range(2000)]  # forty runs; the two lines of a pair share 32
    pairs = spark.createDataFrame([(2 * i + j, s[4 * j : 4 * j + 43]) for i, s in enumerate(lines) for j in (0, 1)], "id long, line string")
    bands = {r.id: r.bands for r in line_dedup.banded(pairs).collect()}
    missed = sum(not set(bands[2 * i]) & set(bands[2 * i + 1]) for i in range(len(lines)))
    met = [sum(bands[2 * i][b] == bands[2 * i + 1][b] for i in range(len(lines))) for b in range(line_dedup.BANDS)]
    assert missed <= 18 and all(900 <= m <= 1150 for m in met)  # 6.4 and 1024 expected


def test_lines_of_one_component_are_hashed_once_more_by_its_first_only(spark, monkeypatch):
    """A block's first line joins all that are like it; after that none of them is hashed as the left line of a pair."""
    base, whole, calls = "".join(chr(97 + 7 * i * i % 26) for i in range(90)), line_dedup._hashes, []
    texts = spark.createDataFrame([(i, f"{base}{i}") for i in range(6)], "id long, line string")
    drawn = runtime.stored(line_dedup.drawn(texts), "drawn")

    def once(line):
        calls.append(line)  # the left line of a pair is hashed before the right one is named
        told = F.when(line != f"{base}0", F.raise_error(F.lit("hashed again"))) if len(calls) % 2 else F.lit(None)
        return F.when(told.isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(whole(line))

    monkeypatch.setattr(line_dedup, "_hashes", once)
    rows = drawn.withColumn("root", F.col("id")).withColumn("common", F.lit(False)).withColumn("earlier", F.array().cast("array<long>"))
    blocks = rows.agg(F.sort_array(F.collect_list(line_dedup._item())).alias("left")).select("left", F.col("left").alias("right"))
    found = line_dedup._links(blocks, 0.8)
    assert len(calls) == 2 and sorted((r.a, r.b) for r in found.collect()) == [(i, 0) for i in range(1, 6)]
