"""Near-duplicate documents by SimHash and a hierarchical index in Gray order.

A document's fingerprint has 64 bits: a bit is set if it is set in more than half of the hashes of the document's word shingles, repeats
included. Documents whose fingerprints differ in ``distance`` bits at most are linked, and components of links are classes.

Distinct fingerprints are sorted by their rank in the Gray code, where neighbours share most bits, and cut into blocks of ``BLOCK``
consecutive ones. A node keeps the bits that all fingerprints below it share, a mask and their values; ``FAN`` consecutive blocks make an
upper node, ``FAN`` of those the next, up to one root (``levels``). Pairs of nodes come down from the root against itself: a pair goes on to the
pairs of its children as long as the bits that both nodes fix differ in ``distance`` places at most. Masks only grow on the way down, so
what differs above differs below, and a pair of nodes that is dropped takes with it all pairs of fingerprints under it, none of which
could be linked (``near_blocks``). The blocks of the pairs that are left meet, one block at a time, in a task of one of the two; there, runs of ``RUN``
fingerprints are the last nodes, and what passes them is compared (``_Block``). A block of links gives back a spanning forest, so links become
components by distributed union-find without a listed pair for each two members of a group, and no link between fingerprints is lost.

Defined results: letters A to Z are lower-cased, words are what space and ASCII white space divide; a text of one or two words has one shingle, all its words;
null texts and texts without words have the fingerprint 0, which is linked like any other; repeated rows each give a row; rows with a null key have
a fingerprint and a class, the least key in it that isn't null (null, if there is none). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import components, runtime
from scriptorium.operators import ordinals

SEED = 42
#: Fingerprints in a block, blocks (and nodes) under a node, fingerprints in a run inside a block.
BLOCK, FAN, RUN = 1024, 16, 32
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A to Z, and ASCII white space
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    shingles = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in shingles), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = hashes[i : i + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``k, f``: the key and the fingerprint of every row, as a signed integer of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["k", "f"])

    return docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(run, f"k {dict(docs.dtypes)[key]}, f long")


def gray_rank(code: Column) -> Column:
    """The rank of a code in the Gray sequence, as a signed integer that sorts as the unsigned rank does."""
    rank = code
    for places in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, places))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def levels(blocks: DataFrame) -> list[DataFrame]:
    """``node, ones, same``, from the blocks ``node, members`` up to the root: the bits that all fingerprints below share, and which of them are set."""
    members = blocks.select("node", F.explode("members").alias("f"))
    both = lambda f, g: (F.bit_and(f).alias("ones"), F.bit_or(g).alias("any"))
    found = [runtime.stored(members.groupBy("node").agg(*both("f", "f")), "nodes")]
    most = found[0].agg(F.max("node")).first()[0] or 0
    while most:
        most //= FAN
        found.append(runtime.stored(found[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(*both("ones", "any")), "nodes"))
    return [x.select("node", "ones", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))).alias("same")) for x in found]


def near_blocks(nodes: list[DataFrame], distance: int) -> DataFrame:
    """``a, b`` (a <= b) of the blocks whose shared bits leave it open that fingerprints of theirs differ in ``distance`` bits at most."""
    pairs = nodes[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in nodes[-2::-1]:
        side = lambda name: level.select(F.expr(f"node div {FAN}").alias(name), F.struct("node", "ones", "same").alias(f"{name}_"))  # noqa: E731, B023
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        fixed = F.col("a_.same").bitwiseAND(F.col("b_.same"))
        differing = F.bit_count(F.col("a_.ones").bitwiseXOR(F.col("b_.ones")).bitwiseAND(fixed))
        kept = met.where((F.col("a_.node") <= F.col("b_.node")) & (differing <= distance))
        pairs = runtime.stored(kept.select(F.col("a_.node").alias("a"), F.col("b_.node").alias("b")), "pairs")
    return pairs


class _Block:
    """The fingerprints of a block in Gray order, and the bits that each run of them shares."""

    def __init__(self, members: np.ndarray):
        self.members = members
        starts = np.arange(0, len(members), RUN)
        self.ones = np.bitwise_and.reduceat(members, starts)
        self.same = ~(self.ones ^ np.bitwise_or.reduceat(members, starts))
        self.runs = np.append(starts, len(members))

    def near(self, other: _Block, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in both blocks of the fingerprints that differ in ``distance`` bits at most."""
        fixed = self.same[:, None] & other.same[None, :]
        differing = np.bitwise_count((self.ones[:, None] ^ other.ones[None, :]) & fixed)
        for i in range(len(self.ones)):
            against = np.flatnonzero(differing[i] <= distance)
            if len(against):
                mine = np.arange(self.runs[i], self.runs[i + 1])
                theirs = np.concatenate([np.arange(other.runs[j], other.runs[j + 1]) for j in against])
                x, y = np.nonzero(np.bitwise_count(self.members[mine][:, None] ^ other.members[theirs][None, :]) <= distance)
                yield mine[x], theirs[y]


def _forest(found: Iterator[tuple[np.ndarray, np.ndarray]], joined: dict[tuple[int, int], tuple[int, int]], right: int) -> Iterator[tuple[int, int]]:
    """Those of the links from block 0 to block ``right`` that join what wasn't joined before; ``joined`` keeps what is."""

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (y := joined.get(x, x)) != x:
            joined[x] = joined.get(y, y)
            x = y
        return x

    for mine, theirs in found:
        for i, j in zip(mine.tolist(), theirs.tolist(), strict=True):
            x, y = find((0, i)), find((right, j))
            if x != y:
                joined[max(x, y)] = min(x, y)
                yield i, j


def links(blocks: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """``a, b``: linked fingerprints, enough of them to join each component.

    The pair of two blocks belongs to one of them, by turns; that one's task holds its block and one other at a time.
    """
    turn = (F.col("a") + F.col("b")) % 2 == 0
    owned = pairs.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("node"))
    rows = owned.join(blocks, "node").select("owner", (F.col("owner") != F.col("node")).alias("other"), "node", "members")
    dealt = rows.repartition("owner").sortWithinPartitions("owner", "other", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, inside = None, None, {}
        for batch in batches:
            a, b = [], []
            for owner, other, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                block = _Block(members.values.to_numpy(zero_copy_only=False).view(np.uint64))
                if not other:
                    last, own, inside = owner, block, {}
                if owner != last:
                    raise ValueError("a block came without the one that it is held against")
                joined = dict(inside) if other else inside  # what one pair of blocks joins needn't be kept for the next
                for i, j in _forest(own.near(block, distance), joined, int(other)):
                    a.append(own.members[i])
                    b.append(block.members[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, distance: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, fingerprint, component_id`` of every row: the fingerprint in hexadecimal digits, and the least key of the row's component."""
    found = runtime.stored(fingerprints(docs, key, text, width), "fingerprints")
    distinct = runtime.stored(found.groupBy("f").agg(F.min("k").alias("least")).withColumn("rank", gray_rank(F.col("f"))), "distinct")
    ranked = ordinals.numbered(distinct.select("rank", "f"), ["rank"])
    member = F.array_sort(F.collect_list(F.struct("ordinal", "f")))
    blocks = ranked.groupBy(F.expr(f"ordinal div {BLOCK}L").alias("node")).agg(F.transform(member, lambda x: x["f"]).alias("members"))
    blocks = runtime.stored(blocks, "blocks")
    joined = runtime.stored(links(blocks, near_blocks(levels(blocks), distance), distance), "links")
    roots = components.components(joined)
    rooted = distinct.join(roots, distinct["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = runtime.met(rooted, lowest, ["root"], F.xxhash64("f")).select("f", "component_id")
    rows = runtime.met(found, named, ["f"], F.monotonically_increasing_id())
    return rows.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
