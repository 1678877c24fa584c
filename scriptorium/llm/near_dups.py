"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document's shingles are its runs of five words; a shingle that occurs n times weighs 1 + ln n. Each shingle is a Poisson process
whose rate is its weight, and each of its arrivals falls on one of 128 components at random; a component keeps the shingle that
arrives first, and processes end once they can't be first anywhere (ProbMinHash). Two documents agree on a component with the
probability Jaccard of their weights. 25 bands of five components make candidates: at similarity 0.8 a pair is missed once in
20 000 times.

Copies are one text, named by the 64-bit hash of it. In each band the texts of a bucket are held against its least, links are
verified exactly, and linked texts become classes by distributed union-find. The buckets that still hold several classes are dealt to
blocks; inside a block every pair of different classes is verified, unless what was found before has joined them, and a block gives
back a spanning forest. Buckets of several blocks that hold several classes even then are searched between blocks: texts outside
the bucket's commonest class meet every block of it. So no pair is listed, none that could join two classes is left out, no task gets
a whole large bucket, and a large group of near copies has collapsed before any text travels more than once.

Defined results: a text of one to four words has one shingle, all its words; null texts and texts without words are one text;
rows with a null key are left out; rows that repeat a key are one document, in the least of its texts' classes. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import components, runtime

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COMPONENTS, BANDS, ROWS = 128, 25, 5
#: Texts in a block of a bucket that is searched between classes.
BLOCK = 256
#: Parts in which a class's rows meet its number.
SALTS = 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; of all words, if there are fewer."""
    if 0 < len(words) < width:
        return runtime.rolling(words, len(words)) + np.uint64(len(words))
    return runtime.rolling(words, width)


def weighted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their weights."""
    own, counts = np.unique(values, return_counts=True)
    return own, 1 + np.log(counts)


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """The ProbMinHash sketch of each weighted set, a row each; all sets advance together, arrival by arrival. ``m`` is a power of two."""
    first = np.full(len(sets) * m, np.inf)
    held = np.full(len(sets) * m, _NONE, np.uint64)
    element = np.concatenate([s for s, _ in sets]) if sets else np.empty(0, np.uint64)
    weight = np.concatenate([w for _, w in sets]) if sets else np.empty(0)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    time = np.zeros(len(element))
    arrival = 0
    while len(element):
        arrival += 1
        random = runtime.mixed(element + np.uint64(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((random >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        place = owner * m + (random & np.uint64(m - 1)).astype(np.int64)
        sooner = np.flatnonzero(time < first[place])
        sooner = sooner[np.lexsort((element[sooner], -time[sooner]))]  # the soonest is written last
        first[place[sooner]] = time[sooner]
        held[place[sooner]] = element[sooner]
        alive = time < first.reshape(len(sets), m).max(axis=1)[owner]
        element, weight, owner, time = element[alive], weight[alive], owner[alive], time[alive]
    return held.reshape(len(sets), m)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch."""
    cut = sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), cut.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = runtime.mixed(keys * np.uint64(0x9FB21C651E98DF25) + cut[:, :, i])
    return keys.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two weighted sets: the sum over common x of 1 / sum over z of max(a_z / a_x, b_z / b_x)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 1.0 if not len(a[0]) and not len(b[0]) else 0.0
    x, y = a[1][i], b[1][j]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # for z of a greater ratio than x's the first term is the larger, for the others the second
    before = np.searchsorted(ratio, ratio, "left")
    tail = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])[before]
    head = np.concatenate([[0.0], np.cumsum(y)])[before]
    return float((1 / ((only_x + tail) / x + (only_y + head) / y)).sum())


class Texts:
    """What a worker makes of texts."""

    def __init__(self, width: int):
        self.hashes, self.width = runtime.WordHashes(), width

    def words(self, text: str | None) -> list[str]:
        return WORDS.findall(text or "")

    def weighted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return weighted(shingles(self.hashes.of(words), self.width))


def content(text: Column) -> Column:
    """The identity of a text; texts without words have that of the empty text."""
    return F.xxhash64(F.when(text.rlike(WORDS.pattern[:-1]), text).otherwise(""))


def sketched(rows: DataFrame, width: int) -> DataFrame:
    """``k, content, keys``: band keys (none without words) of rows ``k, content, t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(width)
        for batch in batches:
            words = [texts.words(t) for t in batch.column(2).to_pylist()]
            keys = band_keys(sketches([texts.weighted(w) for w in words]))
            lists = [k if w else k[:0] for k, w in zip(keys, words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["k", "content", "keys"])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, content long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those of the pairs ``a, b`` (identities of texts) whose probability Jaccard reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Texts(width)
        last, kept = None, None  # rows come in order of b
        for batch in batches:
            a, b, s, t = (batch.column(i) for i in range(4))
            good = []
            for i, j in enumerate(b.to_pylist()):
                if j != last:
                    last, kept = j, own.weighted(own.words(t[i].as_py()))
                good.append(probability_jaccard(own.weighted(own.words(s[i].as_py())), kept) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])

    first = pairs.join(texts.select(F.col("content").alias("a"), F.col("t").alias("s")), "a")
    both = first.join(texts.select(F.col("content").alias("b"), "t"), "b").select("a", "b", "s", "t")
    return both.mapInArrow(run, "a long, b long")


def _searched(cells: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links ``a, b`` between classes in each cell ``band, left, right`` of rows with ``side`` (0 for both sides, 1 left, 2 right), ``common, content, root, keys, t``."""
    rows = cells.select("band", "left", "right", "side", "common", "content", "root", "keys", "t")
    dealt = rows.repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(width)
        for bands, _, _, side, common, ids, root, keys, ts in runtime.groups(batches, 3):
            if len(set(root)) > 1:
                found = _joined(texts, bands[0], np.array(side), np.array(common), np.array(ids), np.array(root), np.array(keys), ts, threshold)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _joined(texts: Texts, band: int, side: np.ndarray, common: np.ndarray, content: np.ndarray, root: np.ndarray, keys: np.ndarray, ts: list[str], threshold: float) -> list[tuple[int, int]]:
    """Links between classes of the left and the right texts of a cell. A pair that shares an earlier band is left to that one's bucket.

    The two texts of a pair come in the order of their classes, but where the right one is of the bucket's commonest, which the left side leaves out.
    """
    earlier = keys[:, : int(np.argmax(keys[0] == band))]
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    joined = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while joined[x] != x:
            joined[x] = x = joined[joined[x]]
        return x

    def of(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in sets:
            sets[i] = texts.weighted(texts.words(ts[i]))
        return sets[i]

    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(side != 2):
        others = (side != 1) & (common | (root > root[i])) & ~(earlier == earlier[i]).any(axis=1)
        for j in np.flatnonzero(others):
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and probability_jaccard(of(i), of(j)) >= threshold - 1e-12:
                joined[max(x, y)] = min(x, y)
                found.append((int(content[i]), int(content[j])))
    return found


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows ``band, content, ...`` of the buckets that hold several classes, with ``root``."""
    now = rows.join(roots, rows["content"] == roots["node"], "left").select(*[rows[c] for c in rows.columns], F.coalesce("root", "content").alias("root"))
    several = now.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x < y")
    return now.join(several.select("band", "size"), "band")


def _inside(open_: DataFrame, payload: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links within each block of ``band, content, root, block``."""
    rows = open_.withColumns({"left": F.col("block"), "right": F.lit(0).cast("long"), "side": F.lit(0), "common": F.lit(False)})
    return _searched(rows.join(payload, "content"), threshold, width)


def _between(large: DataFrame, payload: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between the blocks of each bucket of ``band, content, root, block, blocks``."""
    counts = large.groupBy("band", "root").agg(F.count("*").alias("times"))
    most = counts.groupBy("band").agg(F.max(F.struct("times", "root")).alias("most"), F.sum("times").alias("all"))
    most = most.select("band", F.col("most.root").alias("of_most"), F.ceil((F.col("all") - F.col("most.times")) / BLOCK).alias("outer"))
    rows = large.join(most, "band").withColumn("common", F.col("root") == F.col("of_most"))
    right = rows.withColumn("left", F.explode(F.expr("sequence(0L, outer - 1)"))).withColumn("right", F.col("block")).withColumn("side", F.lit(2))
    left = rows.where("not common").withColumn("left", F.pmod(F.xxhash64(F.lit(2), "content"), "outer")).withColumn("right", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("side", F.lit(1))
    return _searched(left.unionByName(right).join(payload, "content"), threshold, width)


def classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, class_id, class_size``: of every document the least key of its class, and how many documents the class has."""
    spark = docs.sparkSession
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).where("k is not null")
    rows = rows.select("k", content(F.col("t")).alias("content"), "t")
    found = runtime.stored(sketched(rows, width), "sketches")
    members = found.select("k", "content")
    unique = found.groupBy("content").agg(F.first("keys").alias("keys"))
    bands = runtime.stored(unique.select("content", F.explode("keys").alias("band")), "bands")
    least = bands.groupBy("band").agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least < most").select("band", "least")
    shared = runtime.stored(bands.join(least, "band"), "buckets")  # only what shares a bucket with another text
    runtime.forget(bands)
    one = members.groupBy("content").agg(F.min("k").alias("k")).join(shared.select("content").distinct(), "content")
    texts = runtime.stored(rows.join(one, ["k", "content"]).dropDuplicates(["content"]).select("content", "t"), "texts")
    runtime.release(spark)
    pairs = shared.where("content <> least").select(F.col("content").alias("a"), F.col("least").alias("b")).distinct()
    links = runtime.stored(verified(pairs, texts, threshold, width), "links")
    roots = components.components(links)
    open_ = _rooted(shared.select("band", "content"), roots).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")))
    open_ = runtime.stored(open_.select("band", "content", "root", "blocks", "block"), "open")
    payload = unique.join(open_.select("content").distinct(), "content").join(texts, "content")
    links = runtime.stored(links.unionByName(_inside(open_, payload, threshold, width)), "links")
    runtime.release(spark)
    roots = components.components(links)
    large = open_.where("blocks > 1").drop("root")
    if not large.isEmpty():
        large = _rooted(large, roots)
        roots = components.components(links.unionByName(runtime.stored(_between(large, payload, threshold, width), "between")))
    return _numbered(members, roots, key)


def _numbered(members: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``<key>, class_id, class_size`` of ``k, content``. A class of many is joined in ``SALTS`` parts, so that no task gets it whole."""
    joined = members.join(roots, members["content"] == roots["node"], "left").select("k", F.coalesce("root", "content").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("k").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = joined.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(lowest, ["root", "salt"], "left")
    salted = salted.select("k", F.coalesce("class_id", "k").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
    out = salted.groupBy("k").agg(F.min_by("class_size", "class_id").alias("class_size"), F.min("class_id").alias("class_id"))
    return out.select(F.col("k").alias(key), "class_id", "class_size")


def representatives(docs: DataFrame, threshold: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, that are the least of their class; rows with a null key stay."""
    first = runtime.stored(classes(docs, threshold, width, key, text).where(F.col(key) != F.col("class_id")).select(F.col(key).alias("__copy")), "copies")
    return docs.join(first, docs[key] == first["__copy"], "left_anti")
