import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import named, readers, writers


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def test_round_trip_in_order_of_name(spark, tmp_path):
    texts = {f"{n}.md": f"text {n}".encode() for n in ("b", "a", "Ю", "10", "9", "a b+c%20", "")} | {"long.md": b"x" * 5000}
    del texts[".md"]
    rows = spark.createDataFrame(list(texts.items()), "name string, content binary").repartition(3)
    named.write(rows, f"file://{tmp_path}/out", ".md")
    assert files(tmp_path / "out") == texts
    (tmp_path / "out/other.txt").write_text("not Markdown")
    (tmp_path / "out/_hidden.md").write_text("hidden")
    for split in (1, 20, 1 << 20):
        got = named.read(spark, f"{tmp_path}/out", ".md", split).orderBy("ordinal").collect()
        assert [(r.ordinal, r.name, bytes(r.content), r.size) for r in got] == [(i, n, texts[n], len(texts[n])) for i, n in enumerate(sorted(texts))]
    assert named.read(spark, f"{tmp_path}/out", ".md", 1).rdd.getNumPartitions() == len(texts)


def test_replacing_and_adding(spark, tmp_path):
    row = lambda name, text: spark.createDataFrame([(name, text.encode())], "name string, content binary")
    named.write(row("a.md", "1"), str(tmp_path), ".md")
    (tmp_path / "kept.json").write_text("{}")
    named.write(row("b.md", "2"), str(tmp_path), ".md")
    assert files(tmp_path) == {"b.md": b"2", "kept.json": b"{}"}
    named.write(row("c.md", "3"), str(tmp_path), ".md", replace=False)
    named.write(row("b.md", "4"), str(tmp_path), ".md", replace=False)
    assert files(tmp_path) == {"b.md": b"4", "c.md": b"3", "kept.json": b"{}"}
    named.write(row("c.md", "3").where("false"), str(tmp_path), ".md")
    assert files(tmp_path) == {"kept.json": b"{}"}
    assert named.read(spark, f"{tmp_path}/nowhere", ".md").count() == 0


@pytest.mark.parametrize("names", [["a.md", "a.md"], ["../a.md"], ["a.txt"], [None], ["x.md", ".md"], ["_x.md"]])
def test_nothing_is_written_under_bad_names(spark, tmp_path, names):
    (tmp_path / "old.md").write_text("old")
    rows = spark.createDataFrame([(n, b"x") for n in names], "name string, content binary")
    with pytest.raises(Exception):
        named.write(rows, str(tmp_path), ".md")
    assert files(tmp_path) == {"old.md": b"old"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "old.md").write_text("old")
    late = F.when(F.col("id") < 90, F.encode(F.lit("x"), "UTF-8")).otherwise(F.raise_error(F.lit("broken")).cast("binary"))
    with pytest.raises(Exception, match="broken"):
        named.write(spark.range(0, 100, 1, 4).select(F.concat("id", F.lit(".md")).alias("name"), late.alias("content")), str(tmp_path), ".md")
    assert files(tmp_path) == {"old.md": b"old"}


def test_an_attempt_that_is_run_again_leaves_one_file(tmp_path):
    writer = named._Writer(str(tmp_path), ".md", True)

    def broken():
        yield {"name": "a.md", "content": b"half"}
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    again = writer.write(iter([{"name": "a.md", "content": b"whole"}, {"name": "b.md", "content": None}]))
    assert [p.name for p in tmp_path.iterdir()] == [writer.staging]  # nothing is seen before the commit
    assert not named.listing(str(tmp_path), ".md")
    writer.commit([again, None])
    assert files(tmp_path) == {"a.md": b"whole", "b.md": b""}


def test_long_files_are_converted_by_ranges_of_pages(spark, tmp_path):
    (tmp_path / "DMG.pdf").write_text("\f".join(f"p{i}" for i in range(1, 8)))
    (tmp_path / "Players Handbook.pdf").write_text("only")
    (tmp_path / "empty.pdf").write_text("")

    def converter(content, ocr, first=1, last=99):
        return " ".join(content.decode().split("\f")[first - 1 : last]) + f" ({first}-{last})"

    pages = lambda content: content.decode().count("\f") + 1 if content else 0
    got = readers.converted(readers.pdf_files(spark, str(tmp_path)), converter, pages=pages, at_once=3).orderBy("ordinal").collect()
    assert [(r.ordinal, r.book, r.text.rstrip("\n")) for r in got] == [(0, "DMG", "p1 p2 p3 (1-3)\np4 p5 p6 (4-6)\np7 (7-7)"), (1, "PHB", "only (1-1)"), (2, "EMPTY", " (1-1)")]


def test_the_last_file_of_a_book_stays(spark, tmp_path):
    for name, text in (("DMG 1.pdf", "old"), ("DMG 2.pdf", "new")):
        (tmp_path / name).write_text(text)
    books = readers.converted(readers.pdf_files(spark, str(tmp_path)), lambda content, ocr: content.decode())
    assert [(r.book, r.text.strip()) for r in readers.last_of_book(books).collect()] == [("DMG", "new")]


def test_change_logs_are_named_files(spark, tmp_path):
    logs = spark.createDataFrame([("A", "2024-01-02_03-04-05", 0, [])], "book string, created_at string, total_changes int, changes array<struct<line:int,before:string,after:string>>")
    writers.change_logs(logs, str(tmp_path))
    told = json.loads((tmp_path / "2024-01-02_03-04-05_pdf-processing_A.json").read_text())
    assert told == {"file": "A.md", "created_at": "2024-01-02_03-04-05", "total_changes": 0, "changes": []}
