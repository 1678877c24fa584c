"""Repeated passages: removes what a document shares, for fifty words or more, with a document of a smaller key.

Anchors are blocks of 25 words that start at multiples of 25. Every window of 50 words holds a whole anchor of its own document, so
a window that is repeated from document r in document d shows up where d's rolling 25-word windows probe the index of r's anchors.
Hits are extended by holding the 50-word windows around them against each other; the windows that hold, laid over each other,
are the maximal repeats.

Most text repeats nothing. So that not every rolling window has to travel, documents are screened first: of each 50-word window
the least hash of its 10-word runs is noted (one in about 21 words). Windows of equal words note the same hash, so text none of
whose hashes is noted in another document holds no repeat; only windows whose hash is shared take part in indexing and probing.
Copies of a whole text are found before by a hash of it. All joins are on hashes with pre-aggregated least keys: a passage in a
third of all documents costs a row for each document that holds it, and no pairs are formed. Hashes of 64 bits find what may be equal;
windows, and copies of a whole text, are taken as equal by 128 bits.

Defined results: a null text has no words; documents of fewer than fifty words keep all; rows with a null key keep all and are
no source; rows that repeat a key don't repeat each other. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import runtime

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a screening run. A window holds an anchor whole wherever it starts if two anchors are at most a window long.
RUN = 10
#: What words' hashes are mixed with for a window's second hash.
SECOND = np.uint64(0x5851F42D4C957F2D)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:n], values[width - size : width - size + n])


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie within ``width`` from a start."""
    change = np.zeros(n + width + 1, np.int64)
    change[:-1] += np.bincount(starts, minlength=n + width)[: n + width]
    change[width:] -= np.bincount(starts, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


class Document:
    """Word hashes of a text and what follows from them."""

    def __init__(self, hashes: np.ndarray, window: int):
        self.hashes, self.window, self.block = hashes, window, window // 2
        self.windows = max(0, len(hashes) - window + 1)

    def noted(self) -> np.ndarray:
        """For each window the least hash of its runs."""
        return least_of(runtime.rolling(self.hashes, RUN), self.window - RUN + 1)

    def live(self, shared: np.ndarray) -> np.ndarray:
        """Windows that pass the screen."""
        return np.isin(self.noted(), shared)

    def blocks(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rolling block hashes, and which of them lie within a live window."""
        rolling = runtime.rolling(self.hashes, self.block)
        return rolling, covered(np.flatnonzero(live), self.window - self.block + 1, len(rolling))

    def around(self, hit: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each live window that holds one of the blocks marked in ``hit``."""
        holds = np.concatenate([[0], np.cumsum(hit)])
        at = np.arange(self.windows)
        near = np.flatnonzero(live & (holds[at + self.window - self.block + 1] > holds[at]))
        first, second = runtime.rolling(self.hashes, self.window)[near], runtime.rolling(runtime.mixed(self.hashes ^ SECOND), self.window)[near]
        order = np.argsort(first, kind="stable")
        order = order[np.concatenate([[True], first[order][1:] != first[order][:-1]])] if len(order) else order
        return first[order], second[order]


def _arrays(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def _hashes(values) -> np.ndarray:
    """A list column's values in a row; none for null."""
    return values.values.to_numpy().view(np.uint64) if values.is_valid else np.empty(0, np.uint64)


def _mapped(rows: DataFrame, window: int, names: tuple[str, ...], make: Callable) -> DataFrame:
    """``k, content`` and arrays of hashes, made of each row's Document and its further columns; rows are ``k, content, t, ...``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = runtime.WordHashes()
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                out.append(make(Document(words.of(WORDS.findall(text)), window), *(_hashes(c[i]) for c in batch.columns[3:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_arrays([x[i] for x in out]) for i in range(len(names)))], ["k", "content", *names])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, content long, " + ", ".join(f"{n} array<long>" for n in names))


def _screen(document: Document) -> tuple[np.ndarray, np.ndarray]:
    return runtime.distinct(document.noted()) if document.windows else document.hashes[:0], np.array([len(document.hashes)], np.uint64)


def _anchors(document: Document, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rolling, inside = document.blocks(document.live(shared))
    aligned = np.arange(len(rolling)) % document.block == 0
    return runtime.distinct(rolling[inside & aligned]), runtime.distinct(rolling[inside])


def _extensions(document: Document, shared: np.ndarray, hits: np.ndarray, hit_anchors: np.ndarray) -> tuple[np.ndarray, ...]:
    live = document.live(shared)
    rolling, inside = document.blocks(live)
    aligned = np.arange(len(rolling)) % document.block == 0
    return *document.around(inside & aligned & np.isin(rolling, hit_anchors), live), *document.around(inside & np.isin(rolling, hits), live)


def _pairs(arrays: DataFrame, column: str) -> DataFrame:
    return arrays.select("k", F.explode(column).alias("h"))


def _by_key(pairs: DataFrame, name: str) -> DataFrame:
    """A document's own hashes together; as many as it has words at most."""
    return pairs.groupBy("k").agg(F.collect_list("h").alias(name))


def _both(arrays: DataFrame, first: str, second: str) -> DataFrame:
    """``k, h, check`` of two arrays side by side."""
    return arrays.select("k", F.explode(F.arrays_zip(F.col(first).alias("h"), F.col(second).alias("check"))).alias("x")).select("k", "x.h", "x.check")


def _in_smaller(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``k, h`` of those of the pairs whose hashes (all columns but ``k``) a source of smaller key has."""
    hashes = [c for c in pairs.columns if c != "k"]
    least = sources.groupBy(*hashes).agg(F.min("k").alias("least"))
    return pairs.join(least, hashes).where("k > least").select("k", "h")


def repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Hashes ``k, hs`` of the windows that documents repeat, and copies ``k, content`` whose whole text a smaller key has."""
    if window % 2 or window < 2 * RUN:
        raise ValueError(f"a window has an even number of words, {2 * RUN} at least")
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).where("k is not null")
    rows = rows.select("k", F.xxhash64("t").alias("content"), "t")
    contents = rows.select("k", "content", F.xxhash64(F.lit(1), "t").alias("check"))
    first = contents.groupBy("content", "check").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").drop("most")
    copies = runtime.stored(contents.join(first, ["content", "check"]).where("k > least").select("k", "content").distinct(), "copies")
    noted = runtime.stored(_mapped(rows, window, ("noted", "n"), _screen).select("k", "content", "noted"), "noted")
    unlike = _pairs(noted.join(copies, ["k", "content"], "left_anti"), "noted")
    shared = unlike.groupBy("h").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x < y").select("h")
    screened = runtime.stored(rows.join(_by_key(unlike.join(shared, "h"), "shared"), "k"), "screened")
    runtime.forget(noted)
    runtime.release(spark)

    anchors = runtime.stored(_mapped(screened, window, ("blocks", "probes"), _anchors), "anchors")
    hits = runtime.stored(_in_smaller(_pairs(anchors, "probes"), _pairs(anchors, "blocks")), "hits")
    hit_anchors = _pairs(anchors, "blocks").join(hits.select("h").distinct(), "h")
    near = screened.join(_by_key(hits, "hits"), "k", "left").join(_by_key(hit_anchors, "anchors"), "k", "left").where("hits is not null or anchors is not null")
    windows = runtime.stored(_mapped(near, window, ("sources", "source_checks", "targets", "target_checks"), _extensions), "windows")
    for done in (screened, anchors, hits):
        runtime.forget(done)
    runtime.release(spark)

    found = runtime.stored(_by_key(_in_smaller(_both(windows, "targets", "target_checks"), _both(windows, "sources", "source_checks")), "hs"), "repeats")
    runtime.forget(windows)
    runtime.release(spark)
    return found, copies


def kept_words(words: list[str], hashes: np.ndarray, repeated: np.ndarray, window: int) -> np.ndarray:
    """Which words no repeated window covers."""
    document = Document(hashes, window)
    if not document.windows or not len(repeated):
        return np.ones(len(words), bool)
    return ~covered(np.flatnonzero(np.isin(runtime.rolling(hashes, window), repeated)), window, len(words))


def without_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` in ``doc``; ``n_words``, ``n_removed``, ``kept`` (the text less the removed words, its other characters as they are), ``kept_sha256`` of the kept words joined by single spaces."""
    found, copies = repeats(docs, window, key, text)
    rows = docs.select(docs[key].alias("__k"), docs[text].cast("string").alias("__t"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("__c", F.xxhash64(F.coalesce("__t", F.lit(""))))
    rows = rows.join(found.select(F.col("k").alias("__k"), "hs"), "__k", "left").join(copies.select(F.col("k").alias("__k"), F.col("content").alias("__c"), F.lit(True).alias("copy")), ["__k", "__c"], "left")
    rows = rows.select("doc", F.col("__t").alias("t"), "hs", F.coalesce("copy", F.lit(False)).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = runtime.WordHashes()
        for batch in batches:
            out = []
            for text_, hs, copy in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text_ = text_ or ""
                words = WORDS.findall(text_)
                if copy and len(words) >= window:
                    kept = np.zeros(len(words), bool)
                elif hs.is_valid and len(words) >= window:
                    kept = kept_words(words, hashes.of(words), _hashes(hs), window)
                else:
                    kept = np.ones(len(words), bool)
                left = words if kept.all() else [w for w, k in zip(words, kept, strict=True) if k]
                out.append((len(words), len(words) - len(left), text_ if len(left) == len(words) else _cut(text_, kept), hashlib.sha256(" ".join(left).encode("utf-8", "surrogatepass")).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, n_words long, n_removed long, kept string, kept_sha256 string")


def _cut(text: str, kept: np.ndarray) -> str:
    """The text less the words that aren't kept and the white space before each of them."""
    out, at = [], 0
    for m, k in zip(WORDS.finditer(text), kept, strict=True):
        if k:
            out.append(text[at : m.end()])
        at = m.end()
    return "".join(out) + text[at:]
