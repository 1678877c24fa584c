"""Alignment of two tokenizers over the same texts: overlapping tokens, groups between common ends, counts of linked ids in the corpus.

Texts are cut into units, a space and what follows it, where neither tokenizer can join what is on both sides. A task collects the
distinct units of its rows, up to a chunk of ``UNITS``, and how its documents are made of them. Each distinct unit is encoded by
both libraries once, and DuckDB aligns the chunk (``SQL``): the tokens are tables of byte intervals; the ends of both, each once, cut the
line into stretches, and a stretch lies in exactly one token of either side, which ASOF joins find, so stretches are the pairs
of tokens that overlap; a running sum of the common ends numbers the groups. (A join on the two inequalities would give the same pairs, in
quadratic time where a text is one long word.) What DuckDB returns is counted with the times of each unit.

Each chunk's counts of pairs of ids are partial; Spark adds them up, finds the highest count of each id of the second tokenizer (a row an
id of the vocabulary, which bounds what is broadcast), and sends every chunk the counts of its own pairs in pages of ``PAGE``. There they become sums for units and then
for documents. So no table of the corpus is held anywhere, and a pair travels once for each chunk that has it, however often it occurs.

Defined results: a null or empty text, and one that either tokenizer doesn't give back byte for byte, has no tokens, zeros and ''.
A text isn't given back if one of its units isn't: what a tokenizer loses or shortens there, nothing makes good elsewhere. Repeated rows each count and each give a row; keys may be
null and are passed on; other columns are not read. The first tokenizer must cut texts by the byte-level pattern, the second must not normalise and have
no piece with a space behind another character (both are checked); texts are then encoded as if whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import bpe, runtime

#: Distinct units of a chunk, characters of the documents that brought them, and units of its documents, at most (a document isn't divided).
UNITS, UNIT_BYTES, PLACES = 200_000, 1 << 25, 1 << 23
#: Units that are encoded at a time, units in one text of the first library, and entries in a row of a chunk's tables.
ENCODED, JOINED, PAGE = 8192, 64, 4096
#: White space before a space, and spaces at the ends: there a space alone doesn't divide.
ODD = re.compile(r"^ |\s | $")

SQL = """
CREATE TABLE ends AS SELECT coalesce(a.e, b.e) AS e, a.e IS NOT NULL AS first, b.e IS NOT NULL AS second FROM a FULL JOIN b ON a.e = b.e;
CREATE TABLE stretches AS SELECT *, coalesce(sum((first AND second)::INT) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM ends;
CREATE TABLE links AS SELECT a.u, a.id * 4294967296 + b.id AS ab FROM stretches s ASOF JOIN (SELECT u, e, id::BIGINT AS id FROM a) a ON s.e <= a.e ASOF JOIN b ON s.e <= b.e;
CREATE TABLE pairs AS SELECT ab, row_number() OVER () - 1 AS p, n FROM (SELECT ab, sum(times)::BIGINT AS n FROM links JOIN units USING (u) WHERE times > 0 GROUP BY ab);
"""
STRETCH_ROWS = "SELECT g, first, second FROM stretches ORDER BY e"
LINK_ROWS = "SELECT u, p FROM links JOIN pairs USING (ab) ORDER BY u"
PAIR_ROWS = "SELECT ab, n FROM pairs ORDER BY p"


def units_of(text: str) -> list[str]:
    """The units of space and text, each without the space that it starts with."""
    parts = text.split(" ")
    if not ODD.search(text):
        return parts
    out, own, last = [], [parts[0]], parts[0]
    for x in parts[1:]:
        if not x or not last or last[-1].isspace():
            own.append(x)
        else:
            out.append(" ".join(own))
            own = [x]
        last = x or " "
    return [*out, " ".join(own)]


class Encoders:
    """Both tokenizers in one worker: ids of units, and the bytes of every id."""

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        cut = json.loads(first)
        if cut["normalizer"] or (cut["pre_tokenizer"] or {}).get("type") != "ByteLevel" or not cut["pre_tokenizer"]["use_regex"] or cut["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the first tokenizer must cut by the byte-level pattern and not normalise")
        self.first, self.second = tokenizers.Tokenizer.from_str(first), sentencepiece.SentencePieceProcessor(model_proto=second)
        self.first.encode_special_tokens = True
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(re.search("[^▁]▁", x) for x in pieces) or b"identity" not in second[-64:]:
            raise ValueError("the second tokenizer must not normalise, nor have a space behind another character in a piece")
        byte_of = {c: i for i, c in enumerate(bpe.byte_chars())}
        first_bytes = [bytes(map(byte_of.__getitem__, self.first.id_to_token(i))) if all(c in byte_of for c in self.first.id_to_token(i)) else self.first.id_to_token(i).encode() for i in range(self.first.get_vocab_size())]
        second_bytes = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.bytes = first_bytes, second_bytes
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in self.bytes]

    def encode(self, units: list[str], wanted: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both tokenizers: how many tokens each unit has, their ids, unit after unit, and which units they give back as ``wanted``."""
        # the first library is faster with a few long texts than with many short ones: where a unit ends in a letter, the next may follow in the same text
        texts, own, last = [], [], ""
        for x in units:
            if last and (len(own) == JOINED or last[-1].isspace()):
                texts.append(" " + " ".join(own))
                own = []
            own.append(x)
            last = x
        texts.append(" " + " ".join(own))
        flat = _flat([x.ids for x in self.first.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(self.lengths[0][flat])
        sizes = np.diff(np.searchsorted(ends, np.cumsum(np.fromiter(map(len, wanted), np.int64, len(wanted))), "right"), prepend=0)
        found = [self._checked(0, sizes, flat, wanted)]
        if not found[0][2].all():
            ids = [x.ids for x in self.first.encode_batch_fast([" " + x for x in units], add_special_tokens=False)]
            found = [self._checked(0, np.fromiter(map(len, ids), np.int64, len(ids)), _flat(ids), wanted)]
        ids = self.second.encode(units, num_threads=1)
        return [*found, self._checked(1, np.fromiter(map(len, ids), np.int64, len(ids)), _flat(ids), wanted)]

    def _checked(self, side: int, sizes: np.ndarray, flat: np.ndarray, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, tokens = flat.tolist(), self.bytes[side]
        own = np.array(list(map(len, wanted)), np.int64)
        ends = np.concatenate([[0], np.cumsum(self.lengths[side][flat])])
        at = np.concatenate([[0], np.cumsum(sizes)])
        good = ends[at[1:]] - ends[at[:-1]] == own
        if not good.all() or b"".join(map(tokens.__getitem__, found)) != b"".join(wanted):
            good = np.array([b"".join(map(tokens.__getitem__, found[x:y])) == w for x, y, w in zip(at.tolist(), at[1:].tolist(), wanted)], bool)
        return sizes, flat, good


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))


def _written(tokens: list[dict[str, np.ndarray]], groups: list[np.ndarray], n: int) -> list[str]:
    """The groups of each of ``n`` units as text: ids of both sides, group by group."""
    total = len(tokens[0]["u"]) + len(tokens[1]["u"])
    parts, owner = np.empty(total, object), np.empty(total, np.int64)
    n_groups = int(groups[0][-1]) + 1 if total else 0
    for side, end in ((0, "|"), (1, ";")):
        g, other = groups[side], np.bincount(groups[1 - side], minlength=n_groups)
        # a token comes after the other side's tokens of earlier groups, and on the second side of its own group
        place = np.arange(len(g)) + (np.cumsum(other) - (other if side == 0 else 0))[g]
        last = np.append(g[1:] != g[:-1], True)[: len(g)]
        ids, which = np.unique(tokens[side]["id"], return_inverse=True)
        names = np.array([[f"{i},", f"{i}{end}"] for i in ids.tolist()], object).reshape(-1, 2)
        parts[place], owner[place] = names[which, last.astype(np.int64)], tokens[side]["u"]
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    parts = parts.tolist()
    return ["".join(parts[a:b])[:-1] for a, b in zip(bounds, bounds[1:])]


class _Known(dict):
    """The number of each unit, given when it is first asked for."""

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        return found


class Chunk:
    """Documents of a task and the distinct units that they are made of."""

    def __init__(self, encoders: Encoders):
        self.encoders, self.known, self.bytes = encoders, _Known(), 0
        self.keys: list = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def full(self) -> bool:
        return len(self.known) >= UNITS or self.bytes >= UNIT_BYTES or self.size >= PLACES

    def add(self, key: object, text: str | None) -> None:
        found, before = units_of(text) if text else [], len(self.known)
        self.keys.append(key)
        self.places.append(np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)))
        self.size += len(found)
        if len(self.known) > before:
            self.bytes += len(text)

    def aligned(self) -> tuple[dict[str, np.ndarray | list], dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """By unit: counts and groups; by pair: ids and how often; for the links of all units: how many each unit has, and their pairs."""
        units, parts, at = list(self.known), ([], []), 0
        lost = np.ones(len(units), bool)
        for i in range(0, len(units), ENCODED):
            texts = units[i : i + ENCODED]
            wanted = [b" " + x.encode("utf-8", "surrogatepass") for x in texts]
            both = self.encoders.encode(texts, wanted)
            whole = both[0][2] & both[1][2]
            lost[i : i + len(texts)] = ~whole
            for part, (sizes, flat, _), lengths in zip(parts, both, self.encoders.lengths, strict=True):
                kept = flat[np.repeat(whole, sizes)]
                # a token lies between the end before it and its own
                part.append({"u": np.repeat(np.arange(i, i + len(texts), dtype=np.int32)[whole], sizes[whole]), "id": kept, "e": at + np.cumsum(lengths[kept])})
            at += sum(len(w) for w, good in zip(wanted, whole.tolist(), strict=True) if good)
        tokens = [{c: np.concatenate([np.empty(0, np.int64 if c == "e" else np.int32), *(x[c] for x in part)]) for c in ("u", "id", "e")} for part in parts]
        self.places = [x[:0] if lost[x].any() else x for x in self.places]  # a text that isn't given back has no tokens
        times = np.bincount(np.concatenate(self.places), minlength=len(units)) if units else np.empty(0, np.int64)
        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as con:
            for name, x in zip("ab", tokens, strict=True):
                con.register(name, pa.table(x))
            con.register("units", pa.table({"u": np.arange(len(units), dtype=np.int32), "times": times}))
            con.execute(SQL)
            stretches, links, pairs = (con.execute(x).fetchnumpy() for x in (STRETCH_ROWS, LINK_ROWS, PAIR_ROWS))
        groups = [stretches["g"][stretches[side]] for side in ("first", "second")]
        pairs = {"a": pairs["ab"] >> 32, "b": pairs["ab"] & 0xFFFFFFFF, "n": pairs["n"]}
        sizes = np.bincount(links["u"], minlength=len(units)).astype(np.int32)
        last_of_group = np.append(groups[0][1:] != groups[0][:-1], True)[: len(groups[0])]
        by_unit = {
            "written": _written(tokens, groups, len(units)),
            "n_a": np.bincount(tokens[0]["u"], minlength=len(units)),
            "n_b": np.bincount(tokens[1]["u"], minlength=len(units)),
            "n_groups": np.bincount(tokens[0]["u"][last_of_group], minlength=len(units)),
            "n_links": sizes.astype(np.int64),
        }
        return by_unit, pairs, sizes, links["p"].astype(np.int32)

    def rows(self) -> Iterator[dict[str, list]]:
        """Columns of rows of three kinds: pages of pairs, pages of units, documents."""
        units, pairs, sizes, of = self.aligned()
        for page, i in enumerate(range(0, len(pairs["n"]), PAGE)):
            yield {"kind": [0], "page": [page]} | {c: [pairs[c][i : i + PAGE]] for c in ("a", "b", "n")}
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for page, i in enumerate(range(0, len(sizes), PAGE)):
            yield {"kind": [1], "page": [page], "sizes": [sizes[i : i + PAGE]], "pairs": [of[starts[i] : starts[min(i + PAGE, len(sizes))]]]}
        for i in range(0, len(self.keys), runtime.BATCH_ROWS):
            places = self.places[i : i + runtime.BATCH_ROWS]
            counts = {c: [int(units[c][x].sum()) for x in places] for c in ("n_a", "n_b", "n_groups", "n_links")}
            digests = [hashlib.sha256(";".join(map(units["written"].__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in places]
            yield {"kind": [2] * len(places), "page": [0] * len(places), "k": self.keys[i : i + runtime.BATCH_ROWS], "groups_sha256": digests, "units": [x.tobytes() for x in places]} | counts


def chunks(docs: DataFrame, first: str, second: bytes, key: str, text: str) -> DataFrame:
    """``chunk, kind, page`` and the columns of the kinds that ``Chunk.rows`` has."""
    shared = docs.sparkSession.sparkContext.broadcast((first, second))  # two vocabulary files: their size doesn't depend on the data
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = {"a": ints, "b": ints, "n": longs, "sizes": ints, "pairs": ints, "groups_sha256": pa.string(), "units": pa.binary()} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())
    kind = dict(docs.dtypes)[key]
    schema = f"chunk long, kind int, page int, k {kind}, a array<int>, b array<int>, n array<long>, sizes array<int>, pairs array<int>, groups_sha256 string, units binary, n_a long, n_b long, n_groups long, n_links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, task, done, key_type = Encoders(*shared.value), TaskContext.get().partitionId(), 0, pa.null()

        def out(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            for columns in chunk.rows():
                n = len(columns["kind"])
                given = [pa.array([(task << 32) + done] * n, pa.int64()), pa.array(columns["kind"], pa.int32()), pa.array(columns["page"], pa.int32()), pa.array(columns.get("k", [None] * n), key_type)]
                rest = [pa.array(columns.get(c, [None] * n), t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([*given, *rest], ["chunk", "kind", "page", "k", *kinds])

        chunk = Chunk(encoders)
        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk.add(k, t)
                if chunk.full():
                    yield from out(chunk)
                    chunk, done = Chunk(encoders), done + 1
        if chunk.keys:
            yield from out(chunk)

    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(run, schema)


def counted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, n, best`` of the corpus: how many links hold a pair, and whether that is the most for ``b``; and, page by page, ``n`` of each pair, negative where it is best."""
    entries = pages.select("chunk", "page", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "x")).select("chunk", "page", "at", "x.*")
    counts = entries.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    back = entries.drop("n").join(counts, ["a", "b"]).withColumn("value", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")))
    in_order = F.array_sort(F.collect_list(F.struct("at", "value")))
    return counts, back.groupBy("chunk", "page").agg(F.transform(in_order, lambda x: x["value"]).alias("values"))


def _summed(rows: DataFrame) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``, from rows in order of ``chunk, kind, page``: values of pairs, pairs of units, units of documents."""
    kept = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, values, sums, whole = None, [], [], None
        for batch in batches:
            names, found = batch.schema.names, []
            column = lambda c: batch.column(names.index(c))  # noqa: E731, B023
            kinds = column("kind").to_pylist()
            for i, (chunk, kind) in enumerate(zip(column("chunk").to_pylist(), kinds, strict=True)):
                if chunk != of:
                    of, values, sums, whole = chunk, [], [], None
                if kind == 0:
                    values.append(column("values")[i].values.to_numpy())
                elif kind == 1:
                    if len(values) > 1:
                        values = [np.concatenate(values)]
                    own = values[0][column("pairs")[i].values.to_numpy()] if values else np.empty(0, np.int64)
                    ends = np.concatenate([[0], np.cumsum(column("sizes")[i].values.to_numpy())])
                    total = [np.concatenate([[0], np.cumsum(x)]) for x in (own < 0, np.abs(own))]
                    sums.append(np.stack([x[ends[1:]] - x[ends[:-1]] for x in total]))
                else:
                    if whole is None:
                        whole = np.concatenate(sums, axis=1)
                    found.append((i, *whole[:, np.frombuffer(column("units")[i].as_py(), np.int32)].sum(axis=1).tolist()))
            take = pa.array([x[0] for x in found], pa.int64())
            columns = [column(c).take(take) for c in kept] + [pa.array([x[j] for x in found], pa.int64()) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum"])

    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, first: str, second: bytes, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``<key>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row, and ``a, b, n, best``, the corpus's pairs of linked ids."""
    found = runtime.stored(chunks(docs, first, second, key, text), "chunks")
    counts, values = counted(found.where("kind = 0"))
    paged = values.withColumn("kind", F.lit(0)).unionByName(found.where("kind > 0").drop("a", "b", "n"), allowMissingColumns=True)
    out = _summed(paged.repartition("chunk").sortWithinPartitions("chunk", "kind", "page"))
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts
