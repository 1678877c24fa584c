"""Connected components of links between documents: distributed union-find by large and small stars. DataFrame functions only.

Each round hangs every node's greater neighbours on the node's least neighbour (large star), then a node's lesser neighbours on
the least of them (small star), until every link points straight at its component's least node. Rounds are stored in the
shared folder, nothing is collected but one flag a round, and least neighbours are pre-aggregated, so a hub costs no more than
its links.

Defined results: links of a node to itself, repeated links and links with a null end add nothing; without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import runtime


def _falling(links: DataFrame) -> DataFrame:
    """Distinct links from the greater end ``v`` to the lesser ``m``."""
    return links.where("v <> m").select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether no node has two lesser neighbours and no lesser neighbour has one itself."""
    twice = links.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    inner = links.select(F.col("m").alias("v")).join(links.select("v"), "v", "left_semi")
    return twice.unionByName(inner).isEmpty()


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("v").alias("u"), F.col("m").alias("n")).unionByName(links.select(F.col("m").alias("u"), F.col("v").alias("n")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("n")).alias("to"))
    large = both.where("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("to").alias("m")).where("v <> m").distinct()
    least = large.groupBy("v").agg(F.min("m").alias("to"))
    small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("to").alias("m")), F.struct(F.col("m").alias("v"), F.col("to").alias("m")))).alias("x")).select("x.v", "x.m")
    return _falling(small)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of a link but the roots themselves, the least node of its component."""
    kind = dict(links.dtypes)[a]
    found = runtime.stored(_falling(links.select(F.col(a).alias("v"), F.col(b).cast(kind).alias("m"))), "links")
    while not _settled(found):
        found, before = runtime.stored(_round(found), "links"), found
        runtime.forget(before)
    return found.select(F.col("v").alias("node"), F.col("m").alias("root"))
