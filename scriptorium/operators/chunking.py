"""Token-sized chunks of sections, with stable numbers and identifiers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import structure
from scriptorium.sources import shared

_TOKEN = re.compile(r"\w+|[^\w\s]")
SEPARATORS = ("\n\n", "\n", " ", "")


def default_count(text: str) -> int:
    """Words and single signs; model tokenizers are passed in."""
    return len(_TOKEN.findall(text))


def split_text(text: str, size: int = 800, overlap: int = 120, separators: Sequence[str] = SEPARATORS, count: Callable[[str], int] = default_count) -> list[str]:
    """Chunks of at most ``size`` tokens, cut at the coarsest separator that does, sharing up to ``overlap`` tokens with the one before.

    A separator stays at the head of the piece after it. A piece that no separator can shorten stays whole.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than a chunk")
    out: list[str] = []
    starts = [m.start() for m in _TOKEN.finditer(text)] if count is default_count else None

    def n_tokens(a: int, b: int, by: str) -> int:
        """Tokens of a piece. Pieces cut at white space hold whole tokens, so for them the starts in the whole text are counted."""
        return count(text[a:b]) if starts is None or not by else bisect_left(starts, b) - bisect_left(starts, a)

    def parts(a: int, b: int, by: str) -> list[tuple[int, int]]:
        if not by:
            return [(i, i + 1) for i in range(a, b)]
        cuts, at = [a], text.find(by, a, b)
        while at >= 0:
            cuts.append(at)
            at = text.find(by, at + len(by), b)
        return [(x, y) for x, y in zip(cuts, [*cuts[1:], b], strict=True) if x < y]

    def fill(small: list[tuple[int, int, int]]) -> None:
        window: deque[tuple[int, int, int]] = deque()
        total = 0
        for a, b, n in small:
            if window and total + n > size:
                flush(window)
                while window and (total > overlap or total + n > size):
                    total -= window.popleft()[2]
            window.append((a, b, n))
            total += n
        flush(window)

    def flush(window: deque[tuple[int, int, int]]) -> None:
        if window and (joined := text[window[0][0] : window[-1][1]].strip()):  # neighbouring pieces
            out.append(joined)

    def cut(a: int, b: int, seps: Sequence[str]) -> None:
        at = next((i for i, s in enumerate(seps) if not s or text.find(s, a, b) >= 0), len(seps) - 1)
        small: list[tuple[int, int, int]] = []
        for x, y in parts(a, b, seps[at]):
            n = n_tokens(x, y, seps[at])
            if n < size:
                small.append((x, y, n))
                continue
            fill(small)
            small = []
            if seps[at + 1 :]:
                cut(x, y, seps[at + 1 :])
            else:
                out.append(text[x:y])
        fill(small)

    if text:
        cut(0, len(text), separators)
    return out


def splitter(size: int = 800, overlap: int = 120, count: Callable[[str], int] = default_count):
    """``split_text`` as an Arrow function from text to an array of texts."""

    @F.pandas_udf("array<string>")  # made within a session
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap, count=count))

    return split


def chunks(rows: DataFrame, key: str, size: int = 800, overlap: int = 120, count: Callable[[str], int] = default_count) -> DataFrame:
    """Structural sections to ``key, chunk_id, book_title, chapter_title, section_path, chunk_index, text``.

    Chunks are numbered through each chapter from 1, chapters by first appearance; an id is ``<slug of key>_ch<chapter>_<chunk>``.
    """
    shared.small_batches(rows.sparkSession)
    placed = structure.chapter_index(rows, key).withColumn("parts", splitter(size, overlap, count)(F.col("text")))
    exploded = placed.select("*", F.posexplode("parts").alias("split_pos", "piece"))
    order = Window.partitionBy(key, "chapter_index").orderBy("section_seq", "split_pos")
    exploded = exploded.withColumn("chunk_index", F.row_number().over(order))
    stem = T.slug(F.regexp_replace(F.regexp_extract(F.col(key).cast("string"), r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", ""))
    number = F.format_string("%s_ch%02d_%04d", stem, "chapter_index", "chunk_index")
    return exploded.select(key, number.alias("chunk_id"), "book_title", "chapter_title", "section_path", "chunk_index", F.col("piece").alias("text"))
