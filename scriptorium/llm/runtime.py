"""What the operators share: stored stages, joins of hot keys and word hashing."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.shared import forget, new_path, shared_dir, stored  # noqa: F401

#: Rows in one Arrow batch: texts are up to hundreds of kilobytes, so few rows are held at a time.
BATCH_ROWS = 300
#: Entries a worker keeps in one of its lookup tables before it starts the table anew.
CACHE_ENTRIES = 150_000


def prepare(spark: SparkSession) -> None:
    """Settings under which the Python stages stay within a small worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; it does so soon after the driver collects garbage."""
    for _ in range(2):  # what the first round frees may hold the last reference to more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def met(rows: DataFrame, few: DataFrame, on: list[str], salt: Column, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``few``, which has a row a key at most, in ``salts`` parts, so that no task gets a hot key's rows whole.

    ``salt`` must be the same when a task runs again. Keys must not be null.
    """
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int")).join(spread, [*on, "_salt"], "left").drop("_salt")


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Runs of rows that agree in their first ``width`` columns, as lists of columns; rows must come sorted by them.

    For many small groups of bounded size: it saves what a call for each group would cost.
    """
    waiting: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        at = 0
        for i, row in enumerate(rows):
            if (rows[i - 1] if i else waiting[-1] if waiting else row)[:width] != row[:width]:
                waiting += rows[at:i]
                at = i
                yield [list(c) for c in zip(*waiting, strict=True)]
                waiting = []
        waiting += rows[at:]
    if waiting:
        yield [list(c) for c in zip(*waiting, strict=True)]


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order. By sorting, which is many times as fast as numpy's own function is for 64-bit hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive entries; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: a window of 2k entries from two of k, the rest from the binary digits of width
    with np.errstate(over="ignore"):
        block, size, out, done = mixed(hashes), 1, None, 0
        for bit in range(width.bit_length()):
            if width >> bit & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else mixed(out * np.uint64(0xA24BAED4963EE407) + part)
                done += size
            if width >> (bit + 1):
                block = mixed(block[:-size] * np.uint64(0x9FB21C651E98DF25) + block[size:])
                size *= 2
    return out
