"""Tables derived from the given ones, once as DataFrames and once as SQL, so that queries have headings, pages and noise to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import ordinals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """``doc_id, text``, and the documents' columns ``kept``: each document as a Markdown book: its source as the title, parts of four lines, page marks."""
    docs = table(spark, sf_dir, "documents")

    def line(x, i):
        head = F.concat(F.when(i % 8 == 4, F.lit("### Part ")).otherwise("## Part "), i.cast("string"), F.lit("\n"), x)
        page = F.concat(F.lit("Page "), i.cast("string"), F.lit("\n"), x)
        return F.when(i % 4 == 0, head).when(i % 6 == 3, page).otherwise(x)

    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line), "\n\n")
    return docs.select("doc_id", *kept, F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n"), body).alias("text"))


BOOKS = """books AS (
  SELECT doc_id, '# ' || coalesce(source, '') || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i:
    CASE WHEN (i - 1) % 4 = 0 THEN CASE WHEN (i - 1) % 8 = 4 THEN '### Part ' ELSE '## Part ' END || (i - 1)::VARCHAR || chr(10) || x
         WHEN (i - 1) % 6 = 3 THEN 'Page ' || (i - 1)::VARCHAR || chr(10) || x ELSE x END), chr(10) || chr(10)) AS text
  FROM documents)"""

SECTIONS = (
    BOOKS
    + r""",
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM books),
l1 AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^(?:Page|Страница)\s+([0-9]+)\s*$', 1), '') AS INTEGER) AS page FROM l0),
l2 AS (SELECT *, CASE WHEN page IS NULL THEN length(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*$', 1)) ELSE 0 END AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.*?)\s*$', 2)) AS title FROM l1),
l3 AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS INTEGER) AS section_seq, last_value(page IGNORE NULLS) OVER w AS open_page FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
s0 AS (SELECT doc_id, section_seq, CAST(max(level) AS INTEGER) AS level, max(CASE WHEN level > 0 THEN title END) AS title,
    regexp_replace(coalesce(string_agg(CASE WHEN level = 0 AND page IS NULL THEN line END, chr(10) ORDER BY n), ''), '^\s+|\s+$', '', 'g') AS text,
    max(CASE WHEN level > 0 THEN open_page END) AS page_start, arg_max(page, CASE WHEN page IS NOT NULL THEN n END) AS last_page
  FROM l3 WHERE section_seq > 0 GROUP BY doc_id, section_seq),
s1 AS (SELECT *, """
    + ", ".join(f"last_value(CASE WHEN level <= {n} THEN level END IGNORE NULLS) OVER w AS v{n}, last_value(CASE WHEN level <= {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 7))
    + """ FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY section_seq ROWS UNBOUNDED PRECEDING)),
sections AS (SELECT doc_id, section_seq, level, title, text, page_start, coalesce(last_page, page_start) AS page_end,
    list_filter(["""
    + ", ".join(f"CASE WHEN v{n} = {n} AND level >= {n} THEN t{n} END" for n in range(1, 7))
    + """], lambda x: x IS NOT NULL) AS path,
    coalesce(CASE WHEN v1 = 1 THEN t1 END, '') AS book_title, CASE WHEN level = 2 THEN title ELSE coalesce(CASE WHEN v2 = 2 AND level >= 2 THEN t2 END, '') END AS chapter_title FROM s1)"""
)


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, line_no, line``: the lines of all books of a source, one book after the other, as one long book."""
    rows = books(spark, sf_dir, "source").where("doc_id is not null")  # as the SQL's join on the key, without moving the texts
    lines = rows.select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return ordinals.numbered(lines, ["doc_id", "place"], ["source"]).select("source", F.col("ordinal").alias("line_no"), "line")


SHELF_SECTIONS = (
    BOOKS
    + """,
shelves AS (SELECT source, doc_id, unnest(string_split(books.text, chr(10))) AS line, generate_subscripts(string_split(books.text, chr(10)), 1) AS place FROM books JOIN documents d USING (doc_id)),
l0 AS (SELECT source, line, row_number() OVER (PARTITION BY source ORDER BY doc_id, place) AS n FROM (SELECT source, doc_id, line, place FROM shelves)),
l1 AS"""
    + SECTIONS.partition(",\nl1 AS")[2].replace("doc_id", "source")
)


def with_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with words broken at line ends, carriage returns and blanks at line ends."""
    text = F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\non")), F.lit(". "), F.lit(".  \t\r\n\r\n\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


WITH_BREAKS = r"""d AS (SELECT doc_id, replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), '. ', '.  ' || chr(9) || repeat(chr(13) || chr(10), 3)) AS text FROM documents)"""


def with_cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some small letters replaced by Cyrillic ones, so that words mix scripts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "iun", "июн").alias("text"))


WITH_CYRILLIC = "d AS (SELECT doc_id, translate(text, 'iun', 'июн') AS text FROM documents)"
