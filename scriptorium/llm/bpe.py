"""Byte-level BPE by sentencepiece: encode and decode with a public rank vocabulary.

The ranks become a sentencepiece BPE model: every byte is written as one printable character, a piece's score is its
negative rank, and the normaliser is the identity. A merge of highest score is then the merge of lowest rank, so the
ids equal those of the rank file's own library. Texts are first cut by the vocabulary's pattern and every cut is encoded
by itself; cuts that a worker has met are looked up.

Defined results: a null text is the empty text; an empty text has no ids; repeated rows each give a row; ``doc_id`` may be
null and is passed on; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import runtime


def byte_chars() -> list[str]:
    """A printable character for each byte: the printable ones of Latin-1 stand for themselves, the rest for code points from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def read_ranks(content: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def _varint(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: pieces in order of rank, after them one unknown piece, so that ids are ranks."""
    chars = byte_chars()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the bytes {missing}")
    out = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in by_rank]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens, self.cuts = tokens, regex.compile(pattern).findall
        self.table = {i: c for i, c in enumerate(byte_chars())}
        self.known: dict[str, bytes] = {}

    def pieces(self, cuts: list[str]) -> list[list[int]]:
        return self.processor.encode([x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for x in cuts], num_threads=1)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        cuts, known = self.cuts(text), self.known
        if new := [x for x in set(cuts) if x not in known]:
            if len(known) + len(new) > runtime.CACHE_ENTRIES:
                known.clear()
                new = list(set(cuts))
            for x, ids in zip(new, self.pieces(new), strict=True):
                known[x] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, cuts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``decoded`` (bytes), and the SHA-256 of both.

    Without ``with_ids`` only the counts and digests are returned.
    """
    model, tokens = model_bytes(ranks), [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
    shared = docs.sparkSession.sparkContext.broadcast((model, tokens, pattern))  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column(1).to_pylist()]
            back = [codec.decode(x) for x in ids]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
