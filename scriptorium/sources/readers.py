"""Sources: directories of PDF and Markdown files, JSON lines, page conversion by an injected converter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import named, shared

SECTION = "book_title string, chapter_title string, section_path array<string>, text string"
CHUNK = "chunk_id string, book_title string, chapter_title string, section_path array<string>, chunk_index int, text string"
SAMPLE = "id string, book string, question string, answer string, references array<struct<chunk_id:string,section_path:array<string>>>"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, path, name, book, content`` of a directory's PDF files, numbered in order of name."""
    return named.read(spark, path, ".pdf").select("ordinal", "path", "name", T.book_code(F.col("name")).alias("book"), "content")


def converted(
    files: DataFrame, converter: Callable[..., str] | None = None, ocr: bool = False, languages: list[str] | None = None,
    pages: Callable[[bytes], int] | None = None, at_once: int = 50,
) -> DataFrame:
    """``ordinal, book, text``: files as lightly cleaned Markdown, by a converter that every worker calls file by file.

    The converter gets a file's bytes and ``ocr``; for recognition also ``languages``, as ``text.ocr_languages`` writes them. Where
    ``pages`` counts a file's pages, long files are cut into ranges of ``at_once`` pages that tasks convert side by side: the converter
    then also gets ``first`` and ``last`` (from 1), and a book is its ranges in order, a line end between them.
    """
    if converter is None:
        raise RuntimeError("no page converter is installed: pass one that takes a file's bytes and returns Markdown")
    options: dict = {"ocr": ocr}
    if ocr:
        given = F.lit(None).cast("array<string>") if languages is None else F.array(*map(F.lit, languages)).cast("array<string>")
        options["languages"] = files.sparkSession.range(1).select(T.ocr_languages(given)).first()[0]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ordinal": batch["ordinal"], "book": batch["book"], "path": batch["path"], "pages": [pages(bytes(c)) for c in batch["content"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ordinal": batch["ordinal"], "book": batch["book"], "text": [converter(bytes(c), **options) for c in batch["content"]]})

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, first, last in zip(batch["path"], batch["first"], batch["last"], strict=True):
                store, inside = named.opened(path)
                with store.open_input_stream(inside) as file:
                    texts.append(converter(file.read(), first=first, last=last, **options))
            yield pd.DataFrame({"ordinal": batch["ordinal"], "book": batch["book"], "first": batch["first"], "text": texts})

    kind = "ordinal long, book string, "
    if pages is None:
        out = files.select("ordinal", "book", "content").mapInPandas(run, kind + "text string")
    else:
        # a row a range, not a file's bytes a range: tasks open the file where it lies
        sizes = files.select("ordinal", "book", "path", "content").mapInPandas(counted, kind + "path string, pages int")
        starts = F.explode(F.sequence(F.lit(1), F.greatest("pages", F.lit(1)), F.lit(at_once))).alias("first")
        cut = sizes.select("ordinal", "book", "path", "pages", starts).withColumn("last", F.least(F.col("first") + at_once - 1, F.greatest("pages", F.lit(1))))
        parts = cut.repartition("path", "first").mapInPandas(ranges, kind + "first int, text string")
        out = parts.groupBy("ordinal", "book").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("x"))  # the ranges of a book
        out = out.select("ordinal", "book", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
    return out.withColumn("text", T.light(F.col("text")))


def last_of_book(books: DataFrame) -> DataFrame:
    """One text a book: of several files with one code that of the last name."""
    return books.groupBy("book").agg(F.max_by("text", "ordinal").alias("text"), F.max("ordinal").alias("ordinal"))


def stem(name: Column) -> Column:
    """A Markdown file's name, as Spark escapes it in a path, without its ending."""
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.md\z", "")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, book, text``: a directory's Markdown files, the book named by the file's stem, numbered in order of name."""
    files = named.read(spark, path, ".md")
    return files.select("ordinal", F.regexp_replace("name", r"\.md\z", "").alias("book"), F.decode("content", "UTF-8").alias("text"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines files, ``file_ord`` telling which of the given paths; blank lines are skipped, broken ones raise."""
    paths = [paths] if isinstance(paths, str) else paths
    frames = [spark.read.schema(schema).option("mode", "FAILFAST").json(p).withColumn("file_ord", F.lit(i)) for i, p in enumerate(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_ord, ordinal, line`` of text files' lines that aren't blank: the path's number, and the line's place from 0 over all files, in order of path, of name, and in the file.

    Blocks of a file are read by different tasks; each counts its lines, and the counts before a block are added to its own.
    """
    paths = [paths] if isinstance(paths, str) else paths
    frames = [spark.read.text(p).select(F.lit(i).alias("file_ord"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")) for i, p in enumerate(paths)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    # a task reads a block from its start to its end: places within it follow from the numbers that the task gives its rows
    read = shared.stored(rows.where(T.strip(F.col("line")) != "").withColumn("at", F.monotonically_increasing_id()), "lines")
    blocks = read.groupBy("file_ord", "file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file_ord", "file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    offsets = blocks.select("file_ord", "file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return read.join(offsets, ["file_ord", "file", "block"]).select("file_ord", (F.col("at") + F.col("offset")).alias("ordinal"), "line")


def numbered_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """``json_lines`` with ``ordinal``, the row's place from 0 over all files."""
    rows = numbered_lines(spark, paths)
    return rows.select("ordinal", "file_ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*", "ordinal", "file_ord")


def coerced(rows: DataFrame) -> DataFrame:
    """Missing texts as empty ones, missing paths as empty paths, missing numbers as 0."""
    for name, kind in rows.dtypes:
        empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>"), "int": F.lit(0)}.get(kind)
        if empty is not None:
            rows = rows.withColumn(name, F.coalesce(F.col(name), empty))
    return rows


def samples(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """Evaluation samples, the first ``limit`` in order of file and line if one is given; a set without any raises."""
    rows = json_lines(spark, path, SAMPLE) if limit is None else numbered_json_lines(spark, path, SAMPLE).where(F.col("ordinal") < limit).drop("ordinal")
    if rows.isEmpty():
        raise ValueError(f"no samples in {path}")
    return rows
