"""Sinks: Markdown files, JSON lines, logs by day, evaluation reports, printed answers."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import named


def markdown(books: DataFrame, path: str) -> None:
    """``<book>.md`` for each of ``book, text``; the directory's other Markdown files go, once all new ones are there. Two rows of one book raise."""
    named.write(books.select(F.concat("book", F.lit(".md")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), path, ".md")


def json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in UTF-8 with nulls written out; earlier output is replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def query_log(rows: DataFrame, path: str) -> None:
    """Log rows appended under the day of their ``log_date``."""
    rows.write.mode("append").partitionBy("log_date").json(path)


def report(records: DataFrame, path: str) -> str:
    """Evaluation records under a name of the present second in UTC; returns where."""
    target = f"{path.rstrip('/')}/eval_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}.jsonl"
    records.write.json(target)
    return target


def change_logs(logs: DataFrame, path: str, name: str = "book") -> None:
    """A change log of each book as one JSON object, ``<time>_pdf-processing_<book>.json``; earlier logs stay."""
    told = F.to_json(F.struct(F.concat(name, F.lit(".md")).alias("file"), *[c for c in logs.columns if c != name]), {"ignoreNullFields": "false", "pretty": "true"})
    named.write(logs.select(F.concat("created_at", F.lit("_pdf-processing_"), name, F.lit(".json")).alias("name"), F.encode(told, "UTF-8").alias("content")), path, ".json", replace=False)


def _score(c: Column) -> Column:
    return F.coalesce(F.format_string("%.3f", c), F.lit("—"))


def _origin(c: Column, joint: str = " / ", fallback: str = "—", with_id: bool = True) -> Column:
    return T.source_title(c["book_title"], c["chapter_title"], c["section_path"], c["chunk_id"], joint, with_id=with_id, fallback=fallback)


def source_lines(chunks: Column, most: int = 140) -> Column:
    """The numbered sources of an answer with their previews, a line each."""
    text = lambda c: T.truncate(T.strip(F.replace(F.coalesce(c["text_preview"], F.lit("")), F.lit("\n"), F.lit(" "))), most)
    shown = lambda c: F.when(text(c) == "", F.lit("—")).otherwise(text(c))
    return F.transform(chunks, lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), _origin(c), F.lit(" — "), shown(c)))


def debug_lines(chunks: Column) -> Column:
    """Both scores of an answer's chunks, a line each."""
    return F.transform(chunks, lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), c["chunk_id"], F.lit(" vec="), _score(c["vector_score"]), F.lit(" rer="), _score(c["rerank_score"]), F.lit(" "), _origin(c, with_id=False, fallback="")))


def token_line(prompt: Column, completion: Column, total: Column) -> Column:
    """The reply's usage; null if the model told none."""
    return F.when(total.isNotNull(), F.format_string("Tokens: prompt=%s completion=%s total=%s", prompt.cast("string"), completion.cast("string"), total.cast("string")))


def chat_message(answers: DataFrame, debug: bool = False) -> DataFrame:
    """``query_id, message``: an answer as it is sent to a chat: the text, its sources, and with ``debug`` how they were found."""
    some = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    title = lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), _origin(c, with_id=False, fallback="fragment"))
    sources = F.when(some, F.concat(F.lit("Источники:\n"), F.array_join(F.transform("chunks", title), "\n"))).otherwise(F.lit("Источники: нет данных."))
    parts = [F.trim("answer"), sources]
    if debug:
        head = F.format_string("Диагностика\ninitial_k=%d rerank=%s\nКонтекст:\n", "initial_k", F.when(F.col("rerank_enabled"), "on").otherwise("off"))
        parts.append(F.concat(head, F.when(some, F.array_join(debug_lines(F.col("chunks")), "\n")).otherwise(F.lit("—"))))
    return answers.select("query_id", F.concat_ws("\n\n", *parts).alias("message"))


def printed(answers: DataFrame, most: int = 140, debug: bool = False, at_most: int = 1000) -> list[str]:
    """Answers with their numbered sources, as a terminal shows them; with ``debug`` also scores. Of more than ``at_most`` answers an error."""
    lines = F.coalesce(source_lines(F.col("chunks"), most), F.array(F.lit("Источники не найдены")))
    if debug:
        lines = F.concat(lines, F.coalesce(debug_lines(F.col("chunks")), F.array(F.lit("Диагностика недоступна"))))
    tokens = token_line(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))
    rows = answers.select("answer", lines.alias("lines"), tokens.alias("tokens")).limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} answers aren't for a terminal: write them")
    return ["\n".join([r.answer, *r.lines, *([r.tokens] if r.tokens else [])]) for r in rows]
