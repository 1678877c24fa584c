import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import answer, batching, changes, chunking, evaluate, structure, suspicion, vectors
from scriptorium.sources import readers, settings, writers
from scriptorium.streaming import ingest

BOOK = "intro\n# Book\nlost\n## Chapter one\nPage 3\nbody\n\nmore\n#### Deep\n### Side\nPage 4\nx\nPage 5\n## \n####### seven\n# Two\n## Chapter one\nend"


def test_sections(spark):
    docs = spark.createDataFrame([("b", BOOK), ("none", "no heading"), ("empty", None)], "k string, text string")
    rows = {r.section_seq: r for r in structure.sections(docs, "k").collect()}
    assert [rows[i].title for i in range(1, 8)] == ["Book", "Chapter one", "Deep", "Side", "", "Two", "Chapter one"]
    assert (rows[2].text, rows[2].page_start, rows[2].page_end) == ("body\n\nmore", None, 3)
    assert (rows[4].page_start, rows[4].page_end, rows[4].text) == (3, 5, "x")
    assert [p.title for p in rows[3].path] == ["Book", "Chapter one", "Deep"]
    assert [p.title for p in rows[4].path] == ["Book", "Chapter one", "Side"]
    assert rows[5].text == "####### seven"
    found = structure.structural(structure.sections(docs, "k"), "k").orderBy("section_seq").collect()
    assert [(r.book_title, r.chapter_title) for r in found] == [("Book", "Chapter one")] * 3 + [("Book", ""), ("Two", "Chapter one")]


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([("My Book.md", f"# B\n## One\n{words}\n## Two\nshort\n## One\nagain")], "k string, text string")
    rows = chunking.chunks(structure.structural(structure.sections(docs, "k"), "k"), "k", 50, 10).orderBy("chunk_id").collect()
    assert rows[0].chunk_id == "my_book_ch01_0001" and rows[-1].chunk_id == "my_book_ch02_0001"
    assert [r.text for r in rows if r.chapter_title == "One"][-1] == "again"
    assert all(chunking.default_count(r.text) <= 50 for r in rows)
    seen = [w for r in rows if r.chapter_title == "One" for w in r.text.split()]
    assert list(dict.fromkeys(seen))[:-1] == words.split()


def test_splitter():
    assert chunking.split_text("") == []
    assert chunking.split_text("a b c", 100, 0) == ["a b c"]
    assert chunking.split_text("a\n\nb c d e", 3, 0) == ["a", "b c", "d e"] or all(chunking.default_count(c) <= 3 for c in chunking.split_text("a\n\nb c d e", 3, 0))
    with pytest.raises(ValueError):
        chunking.split_text("a", 5, 5)


def test_suspicion(spark):
    text = "Cлово и ещё слова тут\n\nобычный русский текст без всяких странностей\n\n<!-- comment here -->\n\nab\n\n# Heading Cлово\n\nэто words в русском тексте где слова\n\n!!!"
    docs = spark.createDataFrame([(1, text)], "k int, text string")
    rows = suspicion.suspicious(docs, "k").collect()
    by = {r.start_line: r for r in rows}
    assert by[1].reasons == ["mixed-script"] and by[1].score == pytest.approx(0.2)
    assert 3 not in by and 9 not in by and 13 not in by
    assert by[5].reasons == ["html-comment"] and by[7].reasons == ["latin-only", "short-fragment"] and by[7].score == 0.6
    assert by[11].reasons == ["latin-in-cyr", "latin-only"] and by[11].score == pytest.approx(min(1, 1 / 7 + 0.5))
    assert [r.start_line for r in rows][0] in (11, 7)
    assert len(suspicion.suspicious(docs, "k", most=2).collect()) == 2
    strange = suspicion.suspicious(spark.createDataFrame([(1, "неслово здесь неслово")], "k int, text string"), "k", words=spark.createDataFrame([("здесь",)], "word string")).collect()
    assert [(r.reasons, round(r.score, 3)) for r in strange] == [(["unknown-cyr"], 0.667)]


def points(spark):
    rows = [(str(i), [float(i % 3), float(i % 5), 1.0], i % 4, ["a", "b"][: i % 3]) for i in range(20)]
    return spark.createDataFrame(rows, "point_id string, vector array<float>, label int, tags array<string>")


def test_filters(spark):
    df = points(spark)
    count = lambda spec: df.where(vectors.compile_filter(spec, df)).count()
    assert count(None) == count({"must": []}) == 20
    assert count({"must": [{"key": "label", "match": {"value": 1}}]}) == 5
    assert count({"should": [{"key": "label", "match": {"value": 1}}, {"key": "label", "range": {"gte": 3}}]}) == 10
    assert count({"must_not": [{"key": "tags", "match": {"any": ["b"]}}]}) == 14
    assert count({"must": [{"is_empty": {"key": "tags"}}]}) == 7
    assert count({"must": [{"has_id": [1, "2"]}, {"must_not": {"key": "label", "match": {"except": [1]}}}]}) == 1
    with pytest.raises(TypeError):
        vectors.compile_filter([], df)
    for bad in ({"may": []}, {"must": [{"key": "label", "match": {"like": 1}}]}, {"must": [{"key": "label", "range": {"over": 1}}]}, {"must": [{"x": 1}]}):
        with pytest.raises(ValueError):
            vectors.compile_filter(bad, df)


def test_search_and_threshold(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.2, 1.0]), ("c", [1.0, 0.0]), ("z", [0.0, 0.0])], "point_id string, vector array<float>")
    found = vectors.top_k(df, [1.0, 0.0], 5, threshold=0.5).collect()
    assert [r.point_id for r in found] == ["a", "c"]
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, query_vector array<float>")
    rows = vectors.batch_top_k(df, asked, 2).collect()
    assert {(r.query_id, r.rank, r.point_id) for r in rows} == {(1, 1, "a"), (1, 2, "c"), (2, 1, "b"), (2, 2, "a")}
    plan = vectors.top_k(points(spark), [1.0, 0.0, 0.0], 3, {"must": [{"key": "label", "match": {"value": 1}}]})._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_collection(spark, tmp_path):
    store = vectors.Collection(spark, f"file://{tmp_path}/c", 3)
    store.ensure()
    with pytest.raises(LookupError):
        store.points()
    store.upsert(points(spark))
    store.upsert(points(spark).where("label = 1").withColumn("label", F.lit(9)))
    assert store.points().count() == 20 and store.points().where("label = 9").count() == 5
    before = set(store._current()[1].items())
    store.upsert(points(spark).where("point_id = '3'").withColumn("more", F.lit("x")))
    assert len(set(store._current()[1].items()) - before) == 1  # one part was rewritten
    assert {r.point_id: r.more for r in store.points().collect()}["3"] == "x" and store.points().count() == 20
    with pytest.raises(RuntimeError):
        store._point_at(store._current()[0], {})
    store.upsert(points(spark))
    assert store.vacuum() >= 2 and store.points().count() == 20 and store.vacuum() == 0
    store.upsert(points(spark).where("false"))
    with pytest.raises(ValueError):
        store.upsert(points(spark).withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ValueError):
        store.upsert(points(spark).withColumn("point_id", F.lit(" ")))


def test_metrics(spark):
    df = spark.createDataFrame([("a a b", "a b b c", ["x", ""], ["x", "y"]), ("", "", [], []), ("a", "", ["x"], []), ("a", "b", ["x", "x"], ["y"])], "p string, r string, e array<string>, g array<string>")
    rows = df.select(evaluate.token_f1(F.col("p"), F.col("r")).alias("f1"), evaluate.chunk_recall(F.col("e"), F.col("g")).alias("recall")).collect()
    assert [r.f1 for r in rows] == pytest.approx([4 / 7, 1, 0, 0]) and [r.recall for r in rows] == [1, 1, 0, 0]


def test_answers(spark):
    chunks = spark.createDataFrame([("c1", "B", "C", ["B", "C"], 1, "red foxes run far"), ("c2", "B", "C", ["B"], 2, "blue whales swim"), ("c3", "B", "D", [], 1, "red wine is old")], readers.CHUNK)
    rows = chunks.withColumn("point_id", F.col("chunk_id")).withColumn("vector", vectors.hashed_embedding(F.col("text")))
    asked = spark.createDataFrame([(1, "red foxes"), (2, "blue whales")], "query_id int, question string")
    got = {r.query_id: r for r in answer.answer(asked, rows, k=2).collect()}
    assert got[1].answer == "red foxes run far [1]" and got[1].answer_found and got[1].initial_k == 8
    assert [c.chunk_id for c in got[2].chunks][0] == "c2" and got[2].chunks[0].rerank_score == 1.0
    calls = answer.Models(generate=lambda said, chat: answer.reply(F.raise_error(F.lit("called")).cast("string"), chat))
    none = answer.answer(asked, rows, calls, spec={"must": [{"key": "chunk_id", "match": {"value": "none"}}]}).collect()
    assert {r.answer for r in none} == {T.NOTHING_FOUND_ANSWER} and not any(r.answer_found for r in none)
    assert json.loads(none[0].extra) == {"reason": "no_chunks"}
    with pytest.raises(ValueError):
        answer.answer(spark.createDataFrame([(1, " ")], "query_id int, question string"), rows)
    assert writers.printed(answer.answer(asked, rows, k=1))[0].startswith(("red", "blue"))
    (one,) = answer.answer(asked.where("query_id = 1"), rows, k=1, chat=answer.Chat("m", 0.5), system_prompt="").collect()
    assert (one.model, one.total_tokens) == ("m", one.prompt_tokens + one.completion_tokens) and json.loads(one.extra) == {"max_chars_per_chunk": 1500, "temperature": 0.5}
    said = answer.Models(generate=lambda said, chat: answer.reply(F.concat_ws("|", F.transform(said, lambda m: m["role"])), chat))
    assert [answer.answer(asked, rows, said, k=1, system_prompt=x).first().answer for x in (None, "", "be brief")] == ["system|user", "user", "system|user"]
    shown = writers.printed(answer.answer(asked.where("query_id = 1"), rows, k=1), debug=True)[0].split("\n")
    assert shown[1] == "[1] B / C / B › C / id=c1 — red foxes run far" and shown[2].startswith("[1] c1 vec=0.") and shown[3].startswith("Tokens: prompt=")
    with pytest.raises(ValueError):
        writers.printed(answer.answer(asked, rows, k=1), at_most=1)
    sent = {r.query_id: r.message for r in writers.chat_message(answer.answer(asked, rows, k=1), debug=True).collect()}
    assert sent[1].startswith("red foxes run far [1]\n\nИсточники:\n[1] B / C / B › C\n\nДиагностика\ninitial_k=4 rerank=on\nКонтекст:\n[1] c1 vec=0.")
    empty = writers.chat_message(answer.answer(asked, rows, k=1, spec={"must": [{"key": "chunk_id", "match": {"value": "none"}}]})).first().message
    assert empty == T.NOTHING_FOUND_ANSWER + "\n\nИсточники: нет данных."
    logged = answer.log_rows(answer.answer(asked, rows, k=1), answer.Models(), {"must": []}).first()
    assert logged.log_date == logged.timestamp_utc[:10] and logged.filters == '{"must": []}'


def test_batches(spark):
    rows = spark.createDataFrame([("q", i, n) for i, n in enumerate([50, 40, 30, 100, 1, 1, 1, 1, 1])], "k string, ord long, n int")
    got = {r.ord: r.batch_no for r in batching.batches(rows, "k", "n", 4, 100).collect()}
    assert [got[i] for i in range(9)] == [1, 1, 2, 3, 4, 4, 4, 4, 5]
    with pytest.raises(Exception, match="longer"):
        batching.batches(rows, "k", "n", 4, 60, 90).collect()


def test_evaluation(spark):
    chunks = spark.createDataFrame([("c1", "B", "C", ["B", "C"], 1, "red foxes run far"), ("c2", "B", "C", ["B"], 2, "blue whales swim")], readers.CHUNK)
    points = chunks.withColumn("point_id", F.col("chunk_id")).withColumn("vector", vectors.hashed_embedding(F.col("text")))
    samples = spark.createDataFrame([("s1", "b", "red foxes", "red foxes run far", [("c1", [])]), ("s2", "b", "blue whales", "they {swim}", [("c1", []), ("c2", [])]), ("s3", "b", "red", "x", [])], readers.SAMPLE)
    rows = {r.sample_id: r for r in evaluate.run(samples, points, k=1).collect()}
    assert [rows[i].recall for i in ("s1", "s2", "s3")] == [1, 0.5, 1] and rows["s1"].score == pytest.approx(8 / 9)
    judge = lambda said, chat: answer.reply(F.concat(F.lit('{"score": 0.25, "reasoning": "'), F.element_at(said, 1)["role"], F.lit(f" {chat.temperature}" + '"}')), chat)
    assert {(r.score, r.reasoning) for r in evaluate.run(samples, points, judge=judge, k=1).collect()} == {(0.25, "user 0.0")}
    prompt = evaluate.judge_prompt("Q {question} E {expected_answer} P {predicted_answer} {{x}}", F.lit("{predicted_answer}"), F.lit("e"), F.lit(None))
    assert spark.range(1).select(prompt).first()[0] == "Q {predicted_answer} E e P  {x}"
    means = evaluate.report(evaluate.run(samples, points, k=1)).first()
    assert means.n_samples == 3 and means.mean_recall == pytest.approx(2.5 / 3)


def test_requests_for_embeddings(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("text "), "id").alias("text"))
    lengths = lambda texts: F.transform(texts, lambda t: F.array(F.length(t).cast("float"), F.size(texts).cast("float")))
    got = {r.id: r.vector for r in answer.embedded(rows, "id", "text", lengths, 8, 9).collect()}
    assert len(got) == 50 and all(v[0] == len(f"text {i}") and 1 <= v[1] <= 4 for i, v in got.items())
    with pytest.raises(Exception, match="fewer vectors"):
        answer.embedded(rows, "id", "text", lambda texts: F.slice(lengths(texts), 1, 1), 8).collect()
    assert answer.embedded(rows.where("false"), "id", "text", lengths).count() == 0


def test_change_logs(spark, tmp_path):
    old = spark.createDataFrame([("A", "a b\nc"), ("C", "x")], "book string, text string")
    new = spark.createDataFrame([("A", "a d\nc"), ("B", "y"), ("C", "x")], "book string, text string")
    writers.change_logs(changes.between(new, old), f"{tmp_path}/log")
    logs = {p.stem[-1]: json.loads(p.read_text(encoding="utf-8")) for p in tmp_path.glob("log/*_pdf-processing_*.json")}
    assert set(logs) == {"A", "C"} and logs["C"]["total_changes"] == 0
    assert logs["A"]["file"] == "A.md" and logs["A"]["changes"] == [{"line": 1, "before": "b", "after": "d"}]


def test_changes():
    assert changes.differences("a b c\nsame\nx", "a d c\nsame\ny\nz") == [{"line": 1, "before": "b", "after": "d"}, {"line": 3, "before": "x", "after": "y\nz"}]
    assert changes.differences("", "") == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/One Book.md").write_text("# A\nb", encoding="utf-8")
    (tmp_path / "in/Players Handbook.pdf").write_bytes(b"pdf")
    assert [tuple(r) for r in readers.markdown_files(spark, f"{tmp_path}/in").collect()] == [(0, "One Book", "# A\nb")]
    files = readers.pdf_files(spark, f"{tmp_path}/in")
    assert files.first().book == "PHB"
    with pytest.raises(RuntimeError):
        readers.converted(files)
    assert readers.converted(files, lambda content, ocr: f"{content.decode()} {ocr}\r\n").first().text == "pdf False\n"
    assert readers.converted(files, lambda content, ocr, languages: ",".join(languages), ocr=True, languages=["en", "fr"]).first().text == "eng,fr"
    (tmp_path / "a.jsonl").write_text('{"id": "1", "question": "q"}\n\n{"id": "2"}\n', encoding="utf-8")
    assert readers.samples(spark, f"{tmp_path}/a.jsonl").count() == 2
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/b.jsonl", readers.SAMPLE).collect()
    (tmp_path / "c.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.samples(spark, f"{tmp_path}/c.jsonl")
    assert readers.coerced(spark.createDataFrame([(None, None, None)], "a string, b array<string>, c int")).first() == ("", [], 0)
    writers.json_lines(spark.createDataFrame([("ж", None)], "a string, b string"), f"{tmp_path}/out")
    assert [json.loads(x) for p in Path(tmp_path, "out").glob("part*") for x in p.read_text(encoding="utf-8").splitlines()] == [{"a": "ж", "b": None}]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("ingest:\n  chunk_size_tokens: 300\nllm:\n  model_name: m\n")
    got = settings.load(path, {"INGEST_CHUNK_OVERLAP_TOKENS": "7", "INGEST_KEEP_TABLES_AS_BLOCKS": "no"})
    assert (got.chunk_size_tokens, got.chunk_overlap_tokens, got.keep_tables_as_blocks, got.llm_model_name) == (300, 7, False, "m")
    with pytest.warns(UserWarning):
        assert settings.load(tmp_path / "none.yaml", {}) == settings.Settings()
    assert settings.store({"VECTOR_STORE_PATH": "/v/", "VECTOR_STORE_DIM": "8", "VECTOR_STORE_COLLECTION": "", "DEBUG_LOG": "no"}) == settings.Store("/v/", dim=8) and settings.store({"VECTOR_STORE_PATH": "/v/"}).location == "/v/rules"
    assert settings.filled('{"a": {x}}', x="1") == '{"a": 1}'
    (tmp_path / "p.yaml").write_text("prompts:\n  system: hi\n")
    assert settings.system_prompt(str(tmp_path / "p.yaml"), "f") == "hi" and settings.system_prompt(None, "f") == "f"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = vectors.Collection(spark, f"file://{tmp_path}/c", 8)
    for n, body in enumerate(("first\r\n", "second-\ntext")):
        (tmp_path / f"in/b{n}.md").write_text(body)
        stream = ingest.cleaned(ingest.arriving(spark, f"{tmp_path}/in")).withColumn("point_id", F.col("book")).withColumn("vector", vectors.hashed_embedding(F.col("text"), 8))
        ingest.into(stream, store, f"{tmp_path}/state").awaitTermination()
    assert {r.book: r.text for r in store.points().collect()} == {"b0": "first\n", "b1": "secondtext"}
