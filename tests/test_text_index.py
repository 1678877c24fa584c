import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import text_index, vectors
from scriptorium.operators.text_index import TextIndex

WORDS = ["aa", "aaa", "Ab", "fox", "foxes", "Straße", "日本", "x", "the", "then", "other", "ı", "é", "zz top"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    draw = random.Random(1)
    data = [(1000 - i, " ".join(draw.choice(WORDS[: 3 + i % 12]) for _ in range(draw.randrange(0, 30)))) for i in range(300)] + [(5000, None), (5001, ""), (5002, "aaaaaaa" * 50), (5003, "needle in the texts")]
    rows = spark.createDataFrame(data, "id long, text string").repartition(3).cache()
    before, text_index.BLOCK = text_index.BLOCK, 16
    try:
        yield rows, TextIndex.build(rows, f"file://{tmp_path_factory.mktemp('text')}/i", "id")
    finally:
        text_index.BLOCK = before


@pytest.mark.parametrize("k", [1, 7, 400])
def test_equals_the_scan(spark, texts, k):
    rows, index = texts
    asked = ["the", "aa aa", "AAA x", "needle", "nowhere", "", "  ", "日 fox FOX", "zz\ttop", "aaaa", "straße ß", "e th", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = {}
    for r in sorted(index.search(queries, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for i, q in enumerate(asked):
        want = [(r.id, r.score) for r in vectors.lexical_top_k(rows, q or "", k, order="id").collect()]
        assert got[i] == want[: len(got[i])], q
        assert len(got[i]) == min(k, 304) or (len(got[i]) >= 2 * k or want[len(got[i])][1] == 0), q


def test_few_texts_are_read(spark, texts):
    rows, index = texts
    queries = spark.createDataFrame([(1, "needle"), (2, "日本")], "query_id int, query string")
    assert [r.id for r in index.search(queries, 1).where("query_id = 1").collect()] == [5003]
    read = index.verified.groupBy("query_id").count().collect()
    assert max(r["count"] for r in read) < 304 / 4
    plan = index.postings().where("gram = 'nee'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,nee)]" in plan
    assert "PartitionFilters: [isnotnull(shelf" in index.texts([1])._jdf.queryExecution().toString() or "PartitionFilters: [(shelf" in index.texts([1])._jdf.queryExecution().toString()


def test_opened_again_and_empty(spark, texts, tmp_path):
    rows, index = texts
    queries = spark.createDataFrame([(1, "the fox")], "query_id int, query string")
    again = TextIndex(spark, index.path).search(queries, 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.search(queries, 3).collect()))
    empty = TextIndex.build(rows.where("false"), f"file://{tmp_path}/none", "id")
    assert empty.search(queries, 3).count() == 0
    assert index.search(queries.where("false"), 3).count() == 0


def test_order_of_input_decides(spark, tmp_path):
    rows = spark.createDataFrame([(i, 100 - i, "same text") for i in range(20)], "id int, ordinal int, text string")
    index = TextIndex.build(rows, f"file://{tmp_path}/o", "id", order="ordinal")
    got = index.search(spark.createDataFrame([(1, "text")], "query_id int, query string"), 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(19, 1), (18, 1), (17, 1)]
    assert rows.select(vectors.term_count(F.col("text"), F.lit("T"))).first()[0] == 2


def test_what_the_index_was_made_from_is_deleted(spark, tmp_path, monkeypatch):
    from scriptorium.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, text string")
    TextIndex.build(rows, f"file://{tmp_path}/i", "id")
    assert [p.name for p in (tmp_path / "shared").iterdir()] == []


def test_scores_come_from_the_index_alone(spark, tmp_path):
    """No text is read again, whatever the queries ask; words are told apart as queries tell them, however long they are."""
    data = [(i, "a e " * (i % 7) + "tea\x1cpot x") for i in range(60)] + [(100, "ab" * 60), (101, "é\x85b ab")]
    rows = spark.createDataFrame(data, "id int, text string")
    index = TextIndex.build(rows, f"file://{tmp_path}/s", "id")
    asked = ["a e", "tea\x1cpot", "ab", "ab" * 50, "t\x1cp", "é b", "pot x"]
    found = index.search(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 3)
    assert "t:string" not in found._jdf.queryExecution().toString() and "t" not in index.texts().columns
    assert index.verified.count() == 3 * len(asked)
    got = {i: [(r.id, r.score) for r in sorted(found.where(f"query_id = {i}").collect(), key=lambda r: r["rank"])] for i in range(len(asked))}
    for i, q in enumerate(asked):
        assert got[i] == [(r.id, r.score) for r in vectors.lexical_top_k(rows, q, 3, order="id").collect()], q
