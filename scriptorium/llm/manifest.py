"""Merkle manifest of a dataset: a tree of digests for each partition of the rows, a root over the trees, a proof for every row.

A row's leaf is the SHA-256 of its fields, written so that no two rows are written alike. In a tree every ``arity`` consecutive nodes
become the SHA-256 of their digests (the last run may be shorter), level by level, until one node is left; the trees' last nodes,
in order of the trees, become the root in the same way.

Trees are built event by event. A digest that arrives at its parent is kept there under its place; once a parent has as many as
the tree's size lets it have, it is resolved and arrives at its own parent. So tasks resolve what lies in the stretch of leaves that
they read (``_stretches``), and only nodes whose parents lack a child, the frontier, travel on: they meet by ``combineByKey`` in
blocks that grow by ``_step`` levels a round, where partial parents are merged and resolved, until trees are whole. Every resolved
parent leaves reverse links to its children, with the digests of each child's siblings; a node's proof is its own links up to the
frontier and then the proof of the node there, so rounds give proofs backwards and leaves are joined once. A task holds one block, about 4096 nodes.

Defined results: rows with a null key come first, rows of equal keys go by their leaves, and equal rows each have a leaf; a null tree is
a tree of its own and comes first; trees are ordered by their UTF-8 bytes. A proof has an entry a level, also where a node has no
sibling; a lone leaf is its tree's root and has none. Without rows there is nothing. Names of other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from scriptorium.llm import runtime
from scriptorium.operators import ordinals

NODE = "tree string, total long, level int, place long"
PROOF = "array<struct<before: string, after: string>>"


def written(*fields: Column) -> Column:
    """The fields one after the other, each as ``-`` if null, else as its length in bytes, ``:``, and itself."""
    texts = [x.cast("string") for x in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda own, x: digest(F.concat(x["before"], own, x["after"])))


def proof_digest(proof: Column) -> Column:
    """The SHA-256 of the siblings' digests, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""))


def _height(total: int, arity: int) -> int:
    found = 0
    while total > 1:
        total, found = -(-total // arity), found + 1
    return found


def _step(arity: int) -> int:
    """Levels of a block: about 4096 leaves."""
    return max(1, _height(4096, arity))


class Parents:
    """Resolved nodes and partial parents of a part of one tree, up to level ``top``."""

    def __init__(self, total: int, arity: int, top: int):
        self.total, self.arity, self.top = total, arity, min(top, _height(total, arity))
        self.came: list[tuple[int, int]] = []
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.links: dict[tuple[int, int], list[str]] = {}
        self.open: dict[tuple[int, int], str] = {}

    def children(self, level: int, place: int) -> int:
        """How many children the tree's size gives a parent."""
        below = -(-self.total // self.arity ** (level - 1))
        return min(self.arity, below - place * self.arity)

    def arrive(self, level: int, place: int, own: str) -> None:
        """A node is known: it is open until its parent is resolved, which is the next to arrive."""
        while True:
            self.open[level, place] = own
            if level >= self.top:
                return
            level, (place, child) = level + 1, divmod(place, self.arity)
            there = self.partial.setdefault((level, place), {})
            there[child] = own
            if len(there) < self.children(level, place):
                return
            found = [x for _, x in sorted(self.partial.pop((level, place)).items())]
            for i in range(len(found)):
                del self.open[level - 1, place * self.arity + i]
            self.links[level, place] = found
            own = hashlib.sha256("".join(found).encode()).hexdigest()

    def enter(self, level: int, place: int, own: str) -> Parents:
        self.came.append((level, place))
        self.arrive(level, place, own)
        return self

    def merge(self, other: Parents) -> Parents:
        self.came += other.came
        self.links |= other.links
        for (level, place), own in other.open.items():
            self.arrive(level, place, own)
        return self

    def ways(self) -> Iterator[tuple[int, int, int, int, list[tuple[str, str]]]]:
        """For every node that came: the open node above it, and the links between."""
        known: dict[tuple[int, int], tuple[int, int, list[tuple[str, str]]]] = {}

        def way(level: int, place: int) -> tuple[int, int, list[tuple[str, str]]]:
            if (level, place) not in known:
                above, (parent, child) = level + 1, divmod(place, self.arity)
                if all_ := self.links.get((above, parent)):
                    to_level, to_place, rest = way(above, parent)
                    known[level, place] = to_level, to_place, [("".join(all_[:child]), "".join(all_[child + 1 :])), *rest]
                else:
                    known[level, place] = level, place, []
            return known[level, place]

        for level, place in self.came:
            yield level, place, *way(level, place)


def _stretches(leaves: DataFrame, arity: int, carried: list[str]) -> DataFrame:
    """Resolves what lies within the stretches of leaves ``tree, total, ordinal, leaf`` that tasks read.

    Gives the leaves, with what they carry and ``up_level, up_place, proof`` to the open node above them, and the open nodes, whose ``up_level`` is null.
    """
    step = _step(arity)
    rows = leaves.select("tree", F.expr(f"ordinal div {arity**step}L").alias("block"), "total", "ordinal", "leaf", *carried)
    schema = f"{NODE}, digest string, up_level int, up_place long, proof {PROOF}, " + ", ".join(f"`{c}` {kind}" for c, kind in leaves.select(*carried).dtypes)
    kinds = [to_arrow_type(x.dataType) for x in StructType.fromDDL(schema)]
    names = [x.name for x in StructType.fromDDL(schema)]

    def batch(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trees, _, totals, places, leaf, *rest in runtime.groups(batches, 2):
            parents = Parents(totals[0], arity, step)
            for place, own in zip(places, leaf, strict=True):
                parents.enter(0, place, own)
            ways = [(level, place, [{"before": x, "after": y} for x, y in links]) for _, _, level, place, links in parents.ways()]
            yield batch(trees, totals, [0] * len(trees), places, leaf, *map(list, zip(*ways, strict=True)), *rest)
            n = len(parents.open)
            nothing = [[None] * n] * (3 + len(rest))
            yield batch(trees[:1] * n, totals[:1] * n, [x for x, _ in parents.open], [x for _, x in parents.open], list(parents.open.values()), *nothing)

    return rows.sortWithinPartitions("tree", "block", "ordinal").mapInArrow(run, schema)


def _merged(open_: DataFrame, arity: int, top: int) -> DataFrame:
    """Open nodes meet in blocks of ``top`` levels: ``up_level, up_place, proof`` of those that came, and what is open still, whose ``up_level`` is null."""
    spark = open_.sparkSession
    block = lambda r: (r.tree, r.place // arity ** max(0, top - r.level))
    events = open_.rdd.map(lambda r: (block(r), (r.total, r.level, r.place, r.digest)))
    first = lambda x: Parents(x[0], arity, top).enter(*x[1:])
    blocks = events.combineByKey(first, lambda parents, x: parents.enter(*x[1:]), Parents.merge, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def rows(found: tuple[tuple[str, int], Parents]) -> Iterator[tuple]:
        (tree, _), parents = found
        for level, place, to_level, to_place, links in parents.ways():
            yield tree, parents.total, level, place, None, to_level, to_place, links
        for (level, place), own in parents.open.items():
            yield tree, parents.total, level, place, own, None, None, None

    return spark.createDataFrame(blocks.flatMap(rows), f"{NODE}, digest string, up_level int, up_place long, proof {PROOF}")


def _continued(lower: DataFrame, above: DataFrame) -> DataFrame:
    """The proofs of ``lower``, which end at open nodes, with those of the nodes in ``above`` behind them."""
    up = above.select(F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("place").alias("_place"), F.col("proof").alias("_proof"), *[c for c in ("subroot", "root") if c in above.columns])
    joined = lower.join(up, (lower["tree"] == up["_tree"]) & (lower["up_level"] == up["_level"]) & (lower["up_place"] == up["_place"]))
    return joined.withColumn("proof", F.concat("proof", "_proof")).drop("_tree", "_level", "_place", "_proof", "up_level", "up_place")


def _forest(leaves: DataFrame, arity: int, carried: list[str], named: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The leaves and, round by round, the open nodes with their ways, and the last node of each tree ``tree, digest``."""
    height = _height(leaves.agg(F.max("total")).first()[0] or 0, arity)
    found = runtime.stored(_stretches(leaves, arity, carried), named)
    open_, rounds, top = found.where("up_level is null").drop(*carried), [], _step(arity)
    while not rounds or top < height:
        top += _step(arity)
        merged = runtime.stored(_merged(open_, arity, top), named)
        rounds.append(merged.where("up_level is not null"))
        open_ = merged.where("up_level is null")
    return found.where("up_level is not null").drop("level", "place", "total"), rounds, open_.select("tree", "digest")


def _proved(rounds: list[DataFrame]) -> DataFrame:
    above = rounds[-1]
    for lower in rounds[-2::-1]:
        above = _continued(lower, above)
    return above


def manifest(rows: DataFrame, leaf: Column, key: str, within: str, carried: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """``<key>, leaf, subroot, root, proof`` of each row, and the columns ``carried``.

    ``proof`` lists, level by level up to the root, the digests of the siblings ``before`` and ``after``; ``folded`` leads from a leaf and its proof to the root.
    """
    if arity < 2:
        raise ValueError("a parent needs two children at least")
    carried = {"_key": F.col(key)} | (carried or {})
    tree = F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")).alias("tree")  # null comes first, by itself
    own = rows.select(tree, leaf.alias("leaf"), *[x.alias(c) for c, x in carried.items()], F.monotonically_increasing_id().alias("_id"))
    own = runtime.stored(own, "leaves")
    leaves = ordinals.numbered(own, ["_key", "leaf", "_id"], ["tree"]).drop("_id")
    low, rounds, subroots = _forest(leaves, arity, list(carried), "trees")
    # the trees' last nodes are the leaves of one more tree
    tops = ordinals.numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digest").alias("leaf")), ["of"], ["tree"])
    top, top_rounds, root = _forest(tops, arity, ["of"], "roots")
    top = _continued(top, _proved(top_rounds)).join(root.select("tree", F.col("digest").alias("root")), "tree")
    trees = top.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("_above"))
    last = rounds[-1].join(trees, "tree").withColumn("proof", F.concat("proof", "_above")).drop("_above")
    proved = _continued(low, _proved([*rounds[:-1], last]))
    return proved.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[c for c in carried if c != "_key"])
