import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import batching, ordinals, scans, structure
from scriptorium.sources import readers


def test_numbered(spark):
    rows = spark.createDataFrame([(None if i % 7 == 0 else "abc"[i % 3], i * 37 % 101, i) for i in range(300)], "g string, o int, id int").repartition(5)
    got = sorted((str(r.g), r.o, r.id, r.ordinal, r.total) for r in ordinals.numbered(rows, ["o", "id"], ["g"]).collect())
    want, groups = [], {}
    for g, o, i in sorted(((str(r.g), r.o, r.id) for r in rows.collect())):
        groups.setdefault(g, []).append((o, i))
    for g, x in groups.items():
        want += [(g, o, i, n, len(x)) for n, (o, i) in enumerate(sorted(x))]
    assert got == sorted(want)
    whole = ordinals.numbered(rows, ["id"]).collect()
    assert all(r.ordinal == r.id and r.total == 300 for r in whole)
    assert ordinals.numbered(rows.where("false"), ["id"]).count() == 0


@pytest.mark.parametrize("length", [1, 3, 1000])
def test_running_equals_windows(spark, length):
    draw = random.Random(1)
    data = [(k, i, draw.choice([0, 1, 5]), draw.choice([None, None, f"v{i}"])) for k in ("a", "b", None) for i in sorted(draw.sample(range(60), 40))]
    rows = spark.createDataFrame(data, "k string, i long, x int, y string").repartition(3)
    got = {(r.k, r.i): (r.total, r.seen) for r in scans.running(rows, "k", "i", {"total": F.col("x")}, {"seen": F.col("y")}, length).collect()}
    assert len(got) == len(data)
    for k in ("a", "b", None):
        total, seen = 0, None
        for _, i, x, y in sorted((d for d in data if d[0] == k), key=lambda d: d[1]):
            total, seen = total + x, y if y is not None else seen
            assert got[k, i] == (total, seen)


@pytest.mark.parametrize("run", [2, 7, 65536])
def test_sections_of_lines_equal_sections(spark, run):
    draw = random.Random(2)
    pieces = ["# One", "## Two", "### Three", "text", "", "Page 7", "Страница 9", "#### Four", "more text", "Pages", "#no"]
    docs = spark.createDataFrame([(i, "\n".join(draw.choice(pieces) for _ in range(draw.randrange(0, 60)))) for i in range(12)] + [(99, None)], "id int, text string")
    key = lambda r: (r.id, r.section_seq)
    want = sorted(structure.sections(docs, "id").collect(), key=key)
    got = sorted(structure.sections_of_lines(structure.lines(docs, "id").withColumn("line_no", F.col("line_no").cast("long")), "id", run).collect(), key=key)
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) > 50


def test_a_long_document_is_spread(spark):
    heads = F.when(F.col("line_no") % 100 == 0, F.concat(F.lit("## Part "), "line_no")).otherwise(F.lit("text"))
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("book").alias("k"), F.col("id").alias("line_no"), heads.alias("line"))
    found = structure.sections_of_lines(rows, "k", 5000)
    assert found.count() == 2000
    marked = structure.marked(rows).cache()
    placed = scans.running(marked, "k", "line_no", {"n": (F.col("level") > 0).cast("int")}, {}, 5000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in placed.where("n >= 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 100_000  # one key, all of the session's tasks


def greedy(tokens, most_texts, most_tokens):
    out, texts, total, batch = [], 0, 0, 0
    for n in tokens:
        if texts == 0 or texts >= most_texts or total + n > most_tokens:
            batch, texts, total = batch + 1, 0, 0
        texts, total = texts + 1, total + n
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_greedy_cut(seed):
    draw = np.random.default_rng(seed)
    tokens = draw.choice([0, 1, 5, 30, 99, 100, 140], 500)
    most_texts, most_tokens = int(draw.integers(1, 40)), 100
    for length in (1, 7, 64, 500):
        texts = total = before = 0
        got = []
        for i in range(0, 500, length):
            run = batching._Run(tokens[i : i + length], most_texts, most_tokens)
            got += run.numbers(texts, total, before).tolist()
            first = run.first(texts, total)
            if first >= run.n:
                texts, total = texts + run.n, total + int(run.sums[-1])
            else:
                began, texts, total = run.exits()[first].tolist()
                before += began
        assert got == greedy(tokens.tolist(), most_texts, most_tokens)


def test_batches_of_long_and_short_queues(spark, monkeypatch):
    monkeypatch.setattr(batching, "RUN", 50)  # the queue's runs; tasks get it with the plan
    draw = random.Random(3)
    queues = {None: 3, "long": 700, "one": 1, "b": 50, "c": 101}
    data = [(q, i * 3, draw.choice([0, 1, 4, 20, 61])) for q, n in queues.items() for i in range(n)]
    rows = spark.createDataFrame(data, "q string, ord int, n int").repartition(4)
    got = {(r.q, r.ord): r.batch_no for r in batching.batches(rows, "q", "n", 7, 60).collect()}
    for q in queues:
        own = [d for d in data if d[0] == q]
        assert [got[q, o] for _, o, _ in own] == greedy([n for *_, n in own], 7, 60)
    assert batching.batches(rows.where("false"), "q", "n").count() == 0


def test_a_queue_of_many_texts(spark):
    rows = spark.range(0, 300_000, 1, 4).select(F.lit(1).alias("q"), F.col("id").alias("ord"), (F.col("id") * 7919 % 900).alias("n"))
    tokens = (np.arange(300_000) * 7919 % 900).tolist()
    want = greedy(tokens, 512, 250_000)
    got = batching.batches(rows, "q", "n").orderBy("ord").toPandas().batch_no.tolist()
    assert got == want


def test_lines_keep_their_place_whatever_the_blocks(spark, tmp_path):
    for name, n in (("b.jsonl", 3000), ("a.jsonl", 500)):
        (tmp_path / name).write_text("".join(f'{{"id": "{name[0]}{i}", "question": "{"q" * (i % 40)}", "references": []}}\n' + ("\n" if i % 5 == 0 else "") for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1
        got = [(r.ordinal, r.line[8:].split('"')[0]) for r in lines.orderBy("ordinal").collect()]
        assert got == list(enumerate([f"a{i}" for i in range(500)] + [f"b{i}" for i in range(3000)]))
        first = readers.samples(spark, [f"{tmp_path}/b.jsonl", f"{tmp_path}/a.jsonl"], 3002).collect()
        assert sorted(r.id for r in first) == sorted([f"b{i}" for i in range(3000)] + ["a0", "a1"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_shelves_move_texts_once(spark, monkeypatch):
    """Before the lines are numbered, nothing is joined: a book has its source."""
    from scriptorium.operators import ordinals
    from scriptorium.plans import fixtures

    seen = []
    numbered = ordinals.numbered
    monkeypatch.setattr(ordinals, "numbered", lambda rows, *a: seen.append(rows) or numbered(rows, *a))
    fixtures.shelves(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
