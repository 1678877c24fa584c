import random

import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import labelled, queries
from tests.llm import test_line_dedup, test_near_dups, test_substrings

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert set(texts) <= ids and docs.where(F.col("n_chars") != F.length("text")).isEmpty()
        if name == "quality":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(labelled.held_out(F.col("doc_id")))
            good = {r.doc_id for r in labels.where("quality = 1").collect()}
            assert len(good & set(texts)) >= 0.95 * len(good)
        if name == "lines":
            gone = test_line_dedup.plain(before, 0.8)
            want = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(k, [])) for k, t in before}
            assert texts == {k: t for k, t in want.items() if t.strip() or k not in gone}
        if name == "near_duplicates":
            assert set(texts) == set(test_near_dups.plain_classes(before, 0.8).values())
        if name == "passages":
            removed = {k: (n, m) for k, n, m, _ in test_substrings.plain(before, 50)}
            assert set(texts) == {k for k, (n, m) in removed.items() if m == 0 or m < n}
            assert all(len(texts[k].split()) == removed[k][0] - removed[k][1] for k in texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == set(texts)


def test_empty_documents(spark):
    docs = queries.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if "text" in docs.columns else docs
    assert docs.count() == 0


def test_odd_rows_and_planted_cases(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, columns named as the stages' own; and a case for each stage to remove."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, base = prose(70), prose(12), prose(300)
    near = base.split()
    near[150] = "zzz"
    rows = [(1, f"{prose(30)}\n{line}"), (2, f"{prose(30)}\n{line}"), (3, base), (4, " ".join(near)), (5, f"{prose(40)} {passage} {prose(40)}"), (6, f"{prose(90)} {passage} {prose(20)}"), (7, None), (None, prose(20)), (8, ""), (9, prose(30_000)), (10, prose(25)), (10, prose(25)), (11, " \n ")]
    rows += [(12, rows[2][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, removed string, kept string, class_id string, line string, k string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcde") for i, t in rows], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    graded, lines, classes, passages = (dict(x) for x in seen)
    assert len(seen[0]) == len(rows)  # one grade: nothing is rejected
    assert line in lines[1] and line not in lines[2] and 12 not in lines  # the whole of 12 is a line that 3 has
    assert 3 in classes and 4 not in classes
    assert passage in passages[5] and passage not in passages[6]
    assert None in passages and passages[9] == rows[9][1] and passages[7] is None
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {k for k, _ in seen[3]}
