import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium import cli
from scriptorium.operators import answer, evaluate
from scriptorium.operators.ledger import Ledger


def model(folder, fail_at=None):
    """A model that leaves a file for every call, and may break at one text."""

    @F.pandas_udf("string")
    def reply(texts: pd.Series) -> pd.Series:
        for t in texts:
            if t == fail_at:
                raise RuntimeError("model is down")
            open(f"{folder}/{uuid.uuid4().hex}", "w").write(str(t))
        return texts + "!"

    return reply


def counted(texts):
    """A model of many texts at a time, for the command line."""

    @F.pandas_udf("array<array<float>>")
    def vectors(batches: pd.Series) -> pd.Series:
        return batches.map(lambda b: [[float(len(t)), 1.0] for t in b])

    return vectors(texts)


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return folder


def test_nothing_is_asked_twice(spark, tmp_path, calls):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([(i, None if i == 9 else f"text {i % 4}") for i in range(12)], "id int, text string")
    ask = lambda df, **settings: sorted(map(tuple, ledger.replies(df, "chat", F.col("text"), model(calls), settings).collect()))
    first = ask(rows)
    assert first == [(i, None if i == 9 else f"text {i % 4}", None if i == 9 else f"text {i % 4}!") for i in range(12)]
    assert len(list(calls.iterdir())) == 4  # each different request once
    assert ask(rows) == first and len(list(calls.iterdir())) == 4
    more = rows.unionByName(spark.createDataFrame([(20, "new")], rows.schema))
    assert ask(more)[-1] == (20, "new", "new!") and len(list(calls.iterdir())) == 5
    ask(rows, temperature=1)
    assert len(list(calls.iterdir())) == 9  # other settings are other calls
    assert ledger.calls("chat").count() == 9
    assert ledger.replies(rows.where("false"), "chat", F.col("text"), model(calls)).count() == 0
    with pytest.raises(LookupError):
        ledger.calls("other")


def test_a_broken_run_goes_on(spark, tmp_path, calls):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", waves=10)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id int, text string")
    with pytest.raises(Exception, match="model is down"):
        ledger.replies(rows, "chat", F.col("text"), model(calls, "t31")).collect()
    kept = ledger.calls("chat").count()
    before = len(list(calls.iterdir()))
    found = ledger.replies(rows, "chat", F.col("text"), model(calls)).collect()
    assert sorted((r.id, r.reply) for r in found) == [(i, f"t{i}!") for i in range(60)]
    assert len(list(calls.iterdir())) - before == 60 - kept < 60


def test_answers_and_judgements(spark, tmp_path, calls):
    def generate(said, chat):
        return answer.reply(model(calls)(F.element_at(said, -1)["content"]), chat, F.lit(5), F.lit(2))

    def judge(said, chat):
        return answer.reply(F.concat(F.lit('{"score": 0.5, "reasoning": "'), F.substring(model(calls)(F.element_at(said, -1)["content"]), 1, 0), F.lit('"}')), chat)

    points = spark.createDataFrame([(i, f"c{i}", "b", "c", ["p"], i, f"red fox {i}") for i in range(4)], "point_id int, chunk_id string, book_title string, chapter_title string, section_path array<string>, chunk_index int, text string")
    points = points.withColumn("vector", answer.Models().embed(F.col("text"))).cache()
    samples = spark.createDataFrame([(str(i), f"red fox {i}", "a", []) for i in range(3)], "id string, question string, answer string, references array<struct<chunk_id:string,section_path:array<string>>>")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", waves=2)
    run = lambda **more: sorted(map(tuple, evaluate.run(samples, points, answer.Models(generate=generate), judge, k=2, **more).collect()), key=str)
    plain = run()
    used = len(list(calls.iterdir()))
    assert run(ledger=ledger) == plain and len(list(calls.iterdir())) == 2 * used == 12
    assert run(ledger=ledger) == plain and len(list(calls.iterdir())) == 12
    asked = samples.select(F.col("id").alias("query_id"), "question")
    usage = [answer.answer(asked, points, answer.Models(generate=generate), 2, ledger=x).agg(F.sum("total_tokens")).first()[0] for x in (None, ledger)]
    assert usage == [21, 21]


def test_index_with_a_model_of_many_texts(spark, tmp_path):
    p = lambda name: f"file://{tmp_path}/{name}"
    spark.createDataFrame([(f"c{i}", "x" * i) for i in range(1, 9)], "chunk_id string, text string").write.json(p("chunks"))
    for more in ([], ["--ledger", p("ledger")], ["--ledger", p("ledger")]):
        store = p(f"store{len(more)}")
        cli.main(["index", store, p("chunks"), "--dim", "2", "--embedder", "tests.test_ledger:counted", *more], spark)
        from scriptorium.operators import vectors

        assert sorted(r.vector[0] for r in vectors.Collection(spark, store, 2).points().collect()) == list(range(1, 9))
    assert Ledger(spark, p("ledger")).calls("embedding").count() == 8
