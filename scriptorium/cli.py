"""Commands over files: ``python -m scriptorium.cli <command> ...``. Paths may be anything Spark reads."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import answer, changes, chunking, cleaning, evaluate, ledger, structure, vectors
from scriptorium.sources import named, readers, settings, writers


def clean(spark: SparkSession, a: argparse.Namespace) -> None:
    """Markdown files, deeply cleaned, to files of the same names."""
    words = spark.read.text(a.dictionary).select(T.strip(F.col("value")).alias("word")) if a.dictionary else None
    writers.markdown(cleaning.deep(readers.markdown_files(spark, a.source), "book", words=words), a.target)


def sections(spark: SparkSession, a: argparse.Namespace) -> None:
    """Markdown files to sections as JSON lines."""
    writers.json_lines(structure.structural(structure.sections(readers.markdown_files(spark, a.source), "book"), "book"), a.target)


def chunks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sections to chunks as JSON lines."""
    s = settings.load(a.config)
    rows = readers.coerced(readers.json_lines(spark, a.source, "book string, section_seq int, " + readers.SECTION)).drop("file_ord")
    writers.json_lines(chunking.chunks(rows, "book", s.chunk_size_tokens, s.chunk_overlap_tokens), a.target)


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """The chunks in which a query's words occur most."""
    rows = readers.numbered_json_lines(spark, a.source, readers.CHUNK)
    vectors.lexical_top_k(rows, a.query, a.k, order="ordinal").select("chunk_id", "score", T.line_preview(F.col("text"), always=True).alias("text")).show(a.k, truncate=False)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks into a collection, with the offline embedding or that of ``--embedder``, in requests of bounded size; the collection is made if it is missing."""
    store = vectors.Collection(spark, a.target, a.dim)
    store.ensure()
    if a.source:
        rows = readers.coerced(readers.json_lines(spark, a.source, readers.CHUNK)).drop("file_ord")
        many = _named(a.embedder)
        if a.ledger:
            known = _ledger(spark, a)
            ask = (lambda calls: answer.embedded(calls, "call", "request", many).withColumnRenamed("vector", "reply")) if many else None
            found = known.replies(rows, "embedding", F.col("text"), lambda c: vectors.hashed_embedding(c, a.dim), {"embedder": a.embedder, "dim": a.dim}, ask).withColumnRenamed("reply", "vector")
        elif many:
            found = answer.embedded(rows, "chunk_id", "text", many)
        else:
            found = rows.withColumn("vector", vectors.hashed_embedding(F.col("text"), a.dim))
        store.upsert(found, "chunk_id")


def _models(a: argparse.Namespace) -> answer.Models:
    return answer.Models(embed=lambda c: vectors.hashed_embedding(c, a.dim))


def _ledger(spark: SparkSession, a: argparse.Namespace) -> ledger.Ledger | None:
    return ledger.Ledger(spark, a.ledger) if a.ledger else None


def _named(name: str | None):
    """A function given as ``module:function``."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """PDF files to a Markdown file per book, by the converter named as module:function."""
    books = readers.converted(readers.pdf_files(spark, a.source), _named(a.converter), a.ocr, a.languages, _named(a.pages), a.pages_at_once)
    writers.markdown(readers.last_of_book(books), a.target)
    for file in named.listing(a.target, ".md"):
        print(f"{a.target.rstrip('/')}/{file.base_name}")


def changes_(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cleaned Markdown files against the originals of the same name, to a change log per book."""
    writers.change_logs(changes.between(readers.markdown_files(spark, a.cleaned), readers.markdown_files(spark, a.source)), a.target)


def ask(spark: SparkSession, a: argparse.Namespace) -> None:
    """One question of a collection."""
    asked = spark.createDataFrame([(1, a.query)], "query_id int, question string")
    points = vectors.Collection(spark, a.source, a.dim).points()
    found = answer.answer(asked, points, _models(a), a.k, not a.no_rerank, prompts_path=a.prompts, log_path=a.log_dir, chat=answer.Chat(temperature=a.temperature), ledger=_ledger(spark, a))
    print("\n\n".join(writers.printed(found, debug=a.debug)))


def evaluate_(spark: SparkSession, a: argparse.Namespace) -> None:
    """A collection's answers to a set of samples: records to a report, means to the terminal."""
    rows = readers.samples(spark, a.dataset, a.limit)
    points = vectors.Collection(spark, a.source, a.dim).points()
    records = evaluate.run(rows, points, _models(a), _named(a.judge), k=a.k, rerank=not a.no_rerank, chat=answer.Chat(temperature=a.temperature), ledger=_ledger(spark, a))
    written = writers.report(records, a.log_dir or "logs/eval")
    means = evaluate.report(spark.read.schema(records.schema).json(written)).first()
    print(f"Samples: {means.n_samples}\nAverage Recall@{a.k}: {means.mean_recall:.3f}\nAverage score: {means.mean_score:.3f}\nLog written to: {written}")


COMMANDS = {"parse": (parse, ["source", "target"]), "clean": (clean, ["source", "target"]), "changes": (changes_, ["cleaned", "source", "target"]), "sections": (sections, ["source", "target"]), "chunks": (chunks, ["source", "target"]), "sample": (sample, ["source", "query"]), "index": (index, ["target"]), "ask": (ask, ["source", "query"]), "eval": (evaluate_, ["source", "dataset"])}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = settings.store()
    parser = argparse.ArgumentParser(prog="scriptorium")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (function, places) in COMMANDS.items():
        p = commands.add_parser(name, help=function.__doc__)
        for n in places:
            p.add_argument(n)
        p.set_defaults(run=function)
        p.add_argument("--config")
        p.add_argument("-k", type=int, default=5)
        p.add_argument("--dim", type=int, default=given.dim)
        if name == "index":
            p.add_argument("source", nargs="*")
            p.add_argument("--embedder", help="module:function from an array of texts to the array of their vectors")
        if name == "clean":
            p.add_argument("--dictionary", help="a text file of words, one a line")
        if name == "parse":
            p.add_argument("--converter", help="module:function from bytes to Markdown")
            p.add_argument("--ocr", action="store_true")
            p.add_argument("--languages", nargs="*")
            p.add_argument("--pages", help="module:function that counts a file's pages; the converter then gets ranges of pages")
            p.add_argument("--pages-at-once", type=int, default=50)
        if name in ("ask", "eval"):
            p.add_argument("--no-rerank", action="store_true")
            p.add_argument("--temperature", type=float)
            p.add_argument("--log-dir")
        if name in ("index", "ask", "eval"):
            p.add_argument("--ledger", help="a folder that keeps what models have answered; what it holds isn't asked for again")
        if name == "ask":
            p.add_argument("--prompts")
            p.add_argument("--debug", action="store_true", default=given.debug)
        if name == "eval":
            p.add_argument("--limit", type=int)
            p.add_argument("--judge", help="module:function of a chat model; without one the score is the token F1")
    a = parser.parse_args(args)
    a.run(spark or SparkSession.builder.appName("scriptorium").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
