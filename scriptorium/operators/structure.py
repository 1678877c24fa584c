"""Markdown structure by window functions: lines, headings, sections with their paths and pages, chapters and paragraphs.

One shuffle by document serves every window, since all of them partition by it and order by line or section number. Documents of any length, as
lines, go through scans by runs instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import scans
from scriptorium.sources import shared

LEVELS = range(1, 7)
# What is a heading, and what a page marker.
HEADING = r"(?U)^(#{1,6})\s+(.*?)\s*\z"
PAGE = r"(?iuU)^(?:Page|Страница)\s+([0-9]+)\s*\z"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line_no (from 0), line``; an empty text has no line."""
    return docs.where(F.coalesce(F.col(text), F.lit("")) != "").select(key, F.posexplode(T.split_lines(F.col(text))).alias("line_no", "line"))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return T.strip(F.regexp_extract(line, HEADING, 2))


def page_number(line: Column) -> Column:
    """The number of a page marker, null for other lines."""
    return F.nullif(F.regexp_extract(line, PAGE, 1), F.lit("")).cast("int")


def marked(rows: DataFrame) -> DataFrame:
    """Lines with ``page``, a page marker's number, and ``level``, a heading's level or 0."""
    # most lines are neither: a look at the first letter spares them the patterns
    marker, heading = F.col("line").rlike(r"(?iu)^[pс]"), F.col("line").startswith("#")
    return rows.withColumn("page", F.when(marker, page_number(F.col("line")))).withColumn("level", F.when(heading, heading_level(F.col("line"))).otherwise(0))


def _grouped(rows: DataFrame, key: str) -> DataFrame:
    """A row a section of marked lines with ``section_seq`` and ``open_page``."""
    body = F.when((F.col("level") == 0) & F.col("page").isNull(), F.struct("line_no", "line"))
    first = lambda c: F.max(F.when(F.col("level") > 0, c))
    return rows.where("section_seq > 0").groupBy(key, "section_seq").agg(
        F.max("level").alias("level"),
        first(heading_title(F.col("line"))).alias("title"),
        F.array_sort(F.collect_list(body)).alias("body"),
        first(F.col("open_page")).alias("page_start"),
        F.max_by("page", F.when(F.col("page").isNotNull(), F.col("line_no"))).alias("last_page"),
    )


def _last_at() -> dict[str, Column]:
    """For each level the heading that may be open there: the last one of that level or above."""
    return {f"_at_{n}": F.when(F.col("level") <= n, F.struct("level", "title")) for n in LEVELS}


def _finished(grouped: DataFrame, key: str) -> DataFrame:
    """The columns of sections, from grouped lines with ``_at_1`` to ``_at_6``."""
    joined = T.strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n"))
    open_ = [F.when((F.col(f"_at_{n}")["level"] == n) & (F.col("level") >= n), F.col(f"_at_{n}")) for n in LEVELS]
    path = F.filter(F.array(*open_), lambda x: x.isNotNull())
    return grouped.select(key, F.col("section_seq").cast("int").alias("section_seq"), "level", "title", joined.alias("text"), "page_start", F.coalesce("last_page", "page_start").alias("page_end"), path.alias("path"))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, section_seq, level, title, text, page_start, page_end, path``: a row per heading; text before the first is left out.

    ``path`` holds the open headings, the section's own last, as ``level, title``. A document's lines and sections meet in one task: books that are
    too long for that come as lines, to ``sections_of_lines``.
    """
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked(lines(docs, key, text)).withColumn("section_seq", F.sum((F.col("level") > 0).cast("int")).over(so_far)).withColumn("open_page", F.last("page", ignorenulls=True).over(so_far))
    before = Window.partitionBy(key).orderBy("section_seq").rowsBetween(Window.unboundedPreceding, 0)
    return _finished(_grouped(rows, key).withColumns({n: F.last(c, ignorenulls=True).over(before) for n, c in _last_at().items()}), key)


def sections_of_lines(rows: DataFrame, key: str, run: int | None = None) -> DataFrame:
    """``sections`` of documents that come as lines ``key, line_no, line``: counters, pages and open headings are scanned by runs of ``run`` lines, so that no task gets a whole document.

    A section's own text is one row, as long as it may be.
    """
    stored = shared.stored(marked(rows.select(key, "line_no", "line")), "lines")
    placed = scans.running(stored, key, "line_no", {"section_seq": (F.col("level") > 0).cast("int")}, {"open_page": F.col("page")}, run)
    grouped = shared.stored(_grouped(placed, key), "sections")
    return _finished(scans.running(grouped, key, "section_seq", {}, _last_at(), run), key)


def titles_of(path: Column) -> Column:
    return F.transform(path, lambda x: x["title"])


def title_at(path: Column, level: int) -> Column:
    """The title of the first path entry of a level, else empty."""
    return F.coalesce(F.get(F.filter(path, lambda x: x["level"] == level), F.lit(0))["title"], F.lit(""))


def structural(found: DataFrame, key: str) -> DataFrame:
    """Sections below level 1 with ``book_title, chapter_title, section_path``."""
    chapter = F.when(F.col("level") == 2, F.col("title")).otherwise(title_at(F.col("path"), 2))
    return found.where("level > 1").select(key, "section_seq", title_at(F.col("path"), 1).alias("book_title"), chapter.alias("chapter_title"), titles_of(F.col("path")).alias("section_path"), "text")


def chapter_index(rows: DataFrame, key: str) -> DataFrame:
    """``chapter_index``: chapters by first appearance, from 1."""
    first = F.min("section_seq").over(Window.partitionBy(key, "chapter_title"))
    return rows.withColumn("__first", first).withColumn("chapter_index", F.dense_rank().over(Window.partitionBy(key).orderBy("__first"))).drop("__first")


def paragraphs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, start_line, end_line (from 1), lines``: runs of lines that aren't blank."""
    rows = lines(docs, key, text).withColumn("blank", T.strip(F.col("line")) == "")
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum(F.col("blank").cast("int")).over(so_far)).where("not blank")
    return rows.groupBy(key, "island").agg((F.min("line_no") + 1).alias("start_line"), (F.max("line_no") + 1).alias("end_line"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines")).drop("island")
