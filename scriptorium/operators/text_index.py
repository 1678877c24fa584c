"""A text index for ranking by how often a query's words occur as substrings: an inverted index of whole words, and one of short runs of letters over the words.

A query's word holds no white space, so each of its occurrences in a text lies inside one of the text's words. The index holds, for each word that the texts have between
white space, which texts of a block of ``BLOCK`` have it and how often (``words``), and which words have a run of three characters (``postings``). A search looks up
what words hold a word that is asked for, by the rarest of its runs, and how often; these counts times those of the texts are the exact scores, so the index keeps no text. Scores are made by block of texts
and block of queries as products of matrices, and each gives back its best texts only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import ordinals
from scriptorium.sources import shared

#: Texts of a block, directories of texts, characters of a run, queries of a block, products made at once.
BLOCK, SHELVES, GRAM, QUERIES, AT_ONCE = 1024, 512, 3, 256, 1_000_000
#: Characters of the longest word that is found by its runs; longer ones would make too many of them, and are looked through one by one.
LONG = 64

#: White space as ``(?U)\s`` has it; ``str.split`` takes four separators more.
_BLANKS, _SEPARATORS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile("[\x1c-\x1f]")


def _words(low: str) -> list[str]:
    return [w for w in _BLANKS.split(low) if w] if _SEPARATORS.search(low) else low.split()


def _grams(word: Column) -> Column:
    """The runs of a word, each once; the empty one stands for a word too short or too long for runs."""
    each = F.transform(F.sequence(F.lit(1), F.length(word) - GRAM + 1), lambda i: F.substring(word, i, F.lit(GRAM)))
    return F.when(F.length(word) < GRAM, F.array(F.lit(""))).otherwise(F.array_distinct(each))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``block, place, low``, sorted: the words of each block with the places of the texts that have them."""
    of, held = None, {}

    def out() -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x) // 2 for x in held.values())], dtype=np.int32)
        pairs = np.fromiter((x for row in held.values() for x in row), np.int32, 2 * ends[-1]).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs[:, i].astype(kind))) for i, kind in enumerate((np.int16, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(np.full(len(held), of, np.int64)), *lists], ["word", "block", "texts", "times"])

    for batch in batches:
        for block, place, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != of:
                if held:
                    yield out()
                of, held = block, {}
            for word, times in Counter(_words(low)).items():
                held.setdefault(word, []).extend((place, times))
    if held:
        yield out()


def _best(found: pa.Table, asked: pa.Table, k: int, size: int) -> pa.Table:
    """``q, ordinal, score`` of a block's ``k`` best texts for each of a block of queries, of those that have any of its words."""
    kinds = pa.schema([("q", pa.int64()), ("ordinal", pa.int64()), ("score", pa.int64())])
    if not (found.num_rows and asked.num_rows):
        return kinds.empty_table()

    def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = table[name].combine_chunks()
        return lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)

    (places, n), (times, _), (hits, h), (per, _) = (flat(found, c) for c in ("texts", "times", "hits", "per"))
    (word, _), (query, _), (weight, _) = (flat(asked, c) for c in ("w", "at", "weight"))
    weights = np.zeros((word.max() + 1, query.max() + 1))
    weights[word, query] = weight
    counts = np.zeros(size * len(weights))
    row = np.repeat(np.arange(len(n)), n)  # of each place; it meets all of the row's hits
    first, ends = (np.cumsum(h) - h)[row], np.cumsum(h[row])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        m = h[row[at:to]]
        each = np.repeat(np.arange(at, to), m)
        hit = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
        np.add.at(counts, places[each].astype(np.int64) * len(weights) + hits[hit], times[each].astype(np.float64) * per[hit])
        at = to
    scores = counts.reshape(size, -1) @ weights  # whole numbers, far below 2 ** 53
    top = np.argsort(-scores, axis=0, kind="stable")[:k]
    best = np.take_along_axis(scores, top, 0)
    nth, q = np.nonzero(best > 0)
    block, queries = found["block"][0].as_py(), asked["qb"][0].as_py()
    return pa.table([q + queries * QUERIES, top[nth, q] + block * size, best[nth, q].astype(np.int64)], schema=kinds)


class TextIndex:
    """The index of texts ``key, text`` at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        told = spark.read.json(f"{self.path}/settings").first()
        self.key, self.kind, self.n, self.shelf = told.key, told.kind, told.n, told.shelf
        self.block = told.block

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, text: str = "text", order: str | None = None) -> TextIndex:
        """Indexes every text; ``order`` (the key, unless it is given) must tell the texts apart, and decides between equal scores."""
        spark, path = rows.sparkSession, path.rstrip("/")
        shared.small_batches(spark)
        given = rows.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(order or key).alias("o"))
        numbered = ordinals.numbered(given, ["o"])
        n = rows.count()
        shelf = max(BLOCK, -(-n // SHELVES))
        keys = numbered.select("ordinal", "k").withColumn("shelf", F.expr(f"cast(ordinal div {shelf}L as int)"))
        keys.repartitionByRange("shelf", "ordinal").write.option("compression", "zstd").partitionBy("shelf").parquet(f"{path}/texts")
        # rows come in their order but for how files are cut, so a block is made in few parts
        texts = numbered.select(F.expr(f"ordinal div {BLOCK}L").alias("block"), F.expr(f"cast(ordinal % {BLOCK}L as int)").alias("place"), F.lower("t").alias("low"))
        texts.mapInArrow(_counted, "word string, block long, texts array<smallint>, times array<int>").write.option("compression", "zstd").parquet(f"{path}/words")
        shared.forget(numbered)
        kind = dict(rows.dtypes)[key]
        spark.createDataFrame([(key, kind, n, shelf, BLOCK)], "key string, kind string, n long, shelf long, block int").coalesce(1).write.json(f"{path}/settings")
        index = cls(spark, path)

        word = F.col("word")
        short = F.when(F.length(word) <= LONG, _grams(word)).otherwise(F.array().cast("array<string>"))
        held = index.words().select("word").distinct().select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), short))).alias("gram"), "word")
        held.sortWithinPartitions("gram", "word").write.option("compression", "zstd").parquet(f"{path}/postings")
        return index

    def texts(self, shelves: list[int] | None = None) -> DataFrame:
        """``ordinal, k``: the keys of the indexed texts, of the given directories only."""
        rows = self.spark.read.schema(f"ordinal long, k {self.kind}, shelf int").parquet(f"{self.path}/texts")
        return (rows if shelves is None else rows.where(F.col("shelf").isin(shelves))).drop("shelf")

    def words(self) -> DataFrame:
        """``word, block, texts, times``: the texts of a block, by their place in it, that have a word, and how often."""
        return self.spark.read.parquet(f"{self.path}/words")

    def postings(self) -> DataFrame:
        """``gram, word``: the words that have a run of characters; every word has the empty one, and words longer than ``LONG`` no other."""
        return self.spark.read.parquet(f"{self.path}/postings")

    def _hits(self, words: DataFrame) -> DataFrame:
        """``word, held, per``: the texts' words that hold each of ``words(word)``, and how often a word holds it."""
        asked = shared.stored(words.select(F.col("word").alias("held"), F.explode(_grams(F.col("word"))).alias("gram")), "runs")
        found = self.postings().where("gram <> ''").join(asked.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
        rarest = Window.partitionBy("held").orderBy("n", "gram")  # a run that no word has comes first
        by = asked.where("gram <> ''").join(found, "gram", "left").withColumn("nth", F.row_number().over(rarest)).where("nth = 1 and n is not null").select("held", "gram")
        inside = F.contains("word", "held")
        short = self.postings().where("gram <> ''").join(by, "gram").where(inside).select("word", "held")
        # words too short for runs are looked for in all, and all in words too long for them
        every = self.postings().where("gram = ''").select("word")
        scanned = every.join(asked.where("gram = ''").select("held"), inside).unionByName(every.where(F.length("word") > LONG).join(asked.where("gram <> ''").select("held").distinct(), inside))
        left = F.length("word") - F.length(F.replace(F.col("word"), F.col("held"), F.lit("")))
        out = shared.stored(short.unionByName(scanned).withColumn("per", (left / F.length("held")).cast("int")), "held")
        shared.forget(asked)
        return out

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """``query_id, <key>, score, rank``: for each of ``query_id, query`` what ``vectors.lexical_top_k`` finds in all texts, ties in their order. Blank queries score 0 everywhere."""
        texts = queries.groupBy("query_id").agg(F.array_join(F.collect_list("query"), " ").alias("query"))
        numbered = ordinals.numbered(texts, ["query_id"])
        asked = numbered.select("query_id", F.col("ordinal").alias("q"), F.expr(f"ordinal div {QUERIES}L").alias("qb"), "query")
        words = F.filter(F.split(F.lower("query"), r"(?U)\s+"), lambda t: t != "")
        each = asked.select("q", "qb", F.explode(words).alias("word")).groupBy("q", "qb", "word").agg(F.count("*").alias("weight"))
        # words are numbered within a block of queries
        each = shared.stored(each.withColumn("w", F.dense_rank().over(Window.partitionBy("qb").orderBy("word")) - 1), "asked")
        held = self._hits(each.select("word").distinct())
        hits = held.join(each.select(F.col("word").alias("held"), "qb", "w").distinct(), "held")
        hits = shared.stored(hits.groupBy("word", "qb").agg(F.collect_list(F.struct("w", "per")).alias("x")).select("word", "qb", F.col("x.w").alias("hits"), F.col("x.per").alias("per")), "hits")
        shared.forget(held)
        found = self.words().join(hits, "word").select("qb", "block", "texts", "times", "hits", "per")
        blocks = self.spark.range(-(-self.n // self.block)).withColumnRenamed("id", "block")
        weights = each.groupBy("qb").agg(F.collect_list(F.struct("w", (F.col("q") - F.col("qb") * QUERIES).alias("at"), "weight")).alias("x")).select("qb", F.col("x.w").alias("w"), F.col("x.at").alias("at"), F.col("x.weight").alias("weight"))
        size = self.block
        best = found.groupBy("qb", "block").cogroup(weights.crossJoin(blocks).groupBy("qb", "block")).applyInArrow(lambda f, a: _best(f, a, k, size), "q long, ordinal long, score long")
        # where too few texts have any of the words, the first of the others follow with 0
        filling = asked.select("q", F.explode(F.sequence(F.lit(0), F.lit(min(2 * k, self.n) - 1))).alias("ordinal")) if self.n else best.where("false").select("q", "ordinal")
        scored = best.unionByName(filling.select("q", F.col("ordinal").cast("long").alias("ordinal"), F.lit(0).cast("long").alias("score"))).groupBy("q", "ordinal").agg(F.max("score").alias("score"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "ordinal")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        self.verified = shared.stored(ranked.join(asked.select("q", "query_id"), "q").select("query_id", "ordinal", "score", "rank"), "ranked")
        for stage in (numbered, each, hits):
            shared.forget(stage)
        shelves = [r.shelf for r in self.verified.select(F.expr(f"cast(ordinal div {self.shelf}L as int)").alias("shelf")).distinct().collect()]  # directories, not texts
        keys = self.texts(shelves).select("ordinal", "k")
        return keys.join(self.verified, "ordinal").select("query_id", F.col("k").alias(self.key), "score", "rank")
