"""Packing documents into training sequences along a Hilbert curve.

A document's tokens are counted in hashed buckets, the damped counts are scaled to length one and projected to a few
dimensions, and the point's place on a Hilbert curve is the sort key. Documents are range-sorted by it (equal keys by their own
key, so copies spread over partitions) and laid end to end: every sequence but a partition's last is filled to the brim, and
what is left at the end is cut into sequences whose lengths are powers of two, which need no padding. So neighbours in a
sequence resemble each other, and nothing is padded.

Tokens are computed once and stored, since range-sorting reads its input twice.

Defined results: a null text is the empty text, and an empty text is one end token; repeated rows are packed each by itself;
the key may be null; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import runtime
from scriptorium.llm.bpe import byte_chars

#: Hash buckets of a document's vector, its dimensions after projection, and the bits of each on the curve.
BUCKETS, DIMENSIONS, BITS = 1024, 4, 10


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below ``2**bits``, one row each (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


class Projector:
    """Curve places of documents given as token ids."""

    def __init__(self, seed: int = 0):
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(BUCKETS, DIMENSIONS))
        self.salt, self.bucket = np.uint64(seed), np.empty(0, np.int64)

    def places(self, documents: list[np.ndarray]) -> np.ndarray:
        if (most := max((int(ids.max()) for ids in documents), default=0)) >= len(self.bucket):  # the hash bucket of every id so far
            self.bucket = (runtime.mixed(np.arange(2 * most + 1, dtype=np.uint64) ^ self.salt) % np.uint64(BUCKETS)).astype(np.int64)
        counts = np.empty((len(documents), BUCKETS))
        for row, ids in zip(counts, documents, strict=True):
            row[:] = np.bincount(self.bucket[ids], minlength=BUCKETS)
        damped = np.sqrt(counts)
        points = damped @ self.signs / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-12)
        share = 1 / (1 + np.exp(-1.702 * points))  # about evenly spread over 0 to 1
        return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def ranks_of(content: str) -> dict[bytes, int] | None:
    """Ranks of a tokenizers file of byte-level BPE; None unless its ids are those of the bytes and then of the merges in order."""
    model = json.loads(content)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocabulary = model.get("vocab", {})
    made = ["".join(m) for m in merges]
    table = {c: i for i, c in enumerate(byte_chars())}
    if model["type"] != "BPE" or len(set(made)) < len(made) or [vocabulary.get(t) for t in made] != list(range(256, 256 + len(made))) or {vocabulary.get(c) for c in table} != set(range(256)):
        return None
    return {bytes(table[c] for c in t): vocabulary[t] for t in [*table, *made]}


class Tokens:
    """Ids of texts by a tokenizers file, as bytes of one integer type.

    Where the file is plain byte-level BPE split by ``pattern``, texts go through a faster encoder of the same ranks; texts that
    hold a special token's string, which is one id, and other files go through tokenizers itself.
    """

    def __init__(self, content: str, pattern: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(content), kind
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = ranks_of(content)
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def of(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.kind).tobytes()


class Packer:
    """Lays token streams end to end into sequences of ``most`` tokens."""

    def __init__(self, most: int, first: int):
        self.most, self.sequence = most, first
        self.open: list[tuple] = []  # document, its tokens, start, ids
        self.filled = 0

    def _close(self) -> Iterator[tuple]:
        at = 0
        for key, total, start, ids in self.open:
            yield key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at
            at += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.most - self.filled]
            self.open.append((key, len(ids), start, part))
            start += len(part)
            self.filled += len(part)
            if self.filled == self.most:
                yield from self._close()

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences of falling powers of two."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                key, total, start, ids = rest.pop(0)
                self.open.append((key, total, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (key, total, start + room, ids[room:]))
                room -= len(ids[:room])
            yield from self._close()


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, content: str, pattern: str, end_id: int = 0, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """``key, place, ids``: place on the curve, and ids with the end token in the narrowest integer type."""
    from tokenizers import Tokenizer

    kind = "<u2" if Tokenizer.from_str(content).get_vocab_size() <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast((content, pattern, kind))  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, projector = Tokens(*shared.value), Projector(seed)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [tokens.of(t or "") + end for t in batch.column(1).to_pylist()]
            places = projector.places([np.frombuffer(x, kind) for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(ids, pa.binary())], ["k", "place", "ids"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, place long, ids binary").withColumn("width", F.lit(int(kind[-1])))


def pack(docs: DataFrame, content: str, pattern: str, most: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per piece: key, ``start`` and ``length`` in its document, CRC-32 of its ids, ``doc_tokens``, ``sequence_id``, ``offset``."""
    rows = runtime.stored(tokenized(docs, content, pattern, end_id, key, text, seed), "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, "place", "k").sortWithinPartitions("place", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, key_type = Packer(most, TaskContext.get().partitionId() << 40), None
        for batch in batches:
            key_type = batch.column(0).type
            out: list[tuple] = []
            for k, ids, width in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                out += packer.add(k, np.frombuffer(ids.as_buffer(), f"<u{width}"))
            if out:
                yield of(out, key_type)
        if out := list(packer.finish()):
            yield of(out, key_type)

    def of(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        names = ["k", *(x.split()[0] for x in PIECES.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [key_type, *[pa.int64()] * 6], strict=True)], names)

    return sorted_.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, {PIECES}").withColumnRenamed("k", key)
