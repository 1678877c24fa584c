"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words. DataFrame functions only.

A text is cut into sections at blank lines, into paragraphs at line ends, and a paragraph into leaves of at most five words
that end where a sentence does. Every cut is loss-free, so equal roots mean equal texts. Every node is hashed by the whole SHA-256
of the whole hashes below it. The written form holds the tree, ``root/section(paragraph:leaf,leaf;paragraph:leaf|section(...``, with 12
hexadecimal digits for what is below the root, so that two fingerprints alone tell where texts differ.

Defined results: a null text is the empty text, whose tree has one section of one paragraph without leaves; the likeness of
two trees without leaves is 1. Rows that repeat a key are ordered by their text; null keys count as smallest; the next document
of the only document is itself. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space and its complement, alike in every regular expression dialect.
SPACE, SOLID = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
#: Up to five words, of which only the last may end a sentence; or what white space is left at the end.
LEAF = rf"{SPACE}*(?:{SOLID}*[^ \t\n\x0B\f\r.!?]{SPACE}+){{0,4}}{SOLID}+|{SPACE}+"
DIGITS = 12
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS = 4


def whole(text: Column) -> Column:
    return F.sha2(text, 256)


def short(digest: Column) -> Column:
    return F.substring(digest, 1, DIGITS)


def tree(text: Column) -> Column:
    """Sections: a struct of the hash and its paragraphs, each a struct of its hash and its leaves' shortened hashes."""
    found = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), whole)
    paragraph = lambda x: F.struct(whole(F.array_join(x, ",")).alias("hash"), F.transform(x, short).alias("leaves"))
    paragraphs = lambda s: F.transform(F.transform(F.split(s, "\n", -1), found), paragraph)
    section = lambda ps: F.struct(whole(F.array_join(F.transform(ps, lambda p: p["hash"]), ",")).alias("hash"), ps.alias("paragraphs"))
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), paragraphs), section)


def fingerprint(sections: Column) -> Column:
    """A tree's written form."""
    paragraph = lambda p: F.concat(short(p["hash"]), F.lit(":"), F.array_join(p["leaves"], ","))
    written = lambda s: F.concat(short(s["hash"]), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ";"))
    return F.concat(root(sections), F.lit("/"), F.array_join(F.transform(sections, written), "|"))


def root(sections: Column) -> Column:
    return whole(F.array_join(F.transform(sections, lambda s: s["hash"]), ","))


def leaves(sections: Column) -> Column:
    """The tree's distinct leaf hashes."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct leaf hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def differing(a: Column, b: Column) -> Column:
    """Where tree ``a`` differs from ``b``: ``section, paragraph`` (from 0) of the paragraphs of ``a`` under branches that ``b`` lacks."""
    theirs = F.transform(b, lambda s: s["hash"])
    known = F.flatten(F.transform(b, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    place = lambda i: lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p["hash"].alias("hash"))

    def lost(z: Column) -> Column:
        inside = lambda s, i: F.when(F.array_contains(z["theirs"], s["hash"]), F.slice(F.transform(s["paragraphs"], place(i)), 1, 0)).otherwise(F.transform(s["paragraphs"], place(i)))
        left = F.filter(F.flatten(F.transform(z["own"], inside)), lambda x: ~F.array_contains(z["known"], x["hash"]))
        return F.transform(left, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    # bound to names of their own: inside a lambda an outer expression would be computed for every element
    return F.flatten(F.transform(F.array(F.struct(a.alias("own"), theirs.alias("theirs"), known.alias("known"))), lost))


def _bucket(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below the key: first among every n-th of them, then among those between."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < key))
    # one expression each: thousands of single literals would take the driver long to put together
    array = lambda xs: f"cast(array({','.join(f'{int(x)}L' if x > -(2**63) else 'bigint(-9223372036854775808)' for x in xs)}) as array<bigint>)"
    tops, inner = F.expr(array([g[-1] for g in groups[:-1]])), F.expr(f"array({','.join(map(array, groups))})")
    group = below(tops)
    return F.when(key.isNull(), 0).otherwise(group * step + below(F.element_at(inner, group + 1)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, tree, next_text, next_leaves``: each document beside the next one in descending order of the key, after the last the first.

    Documents are dealt to buckets by quantiles of the key, as many as a multiple of the shuffle partitions; the first document of
    each lower bucket is also dealt, as a guest, to the bucket above it. So the order needs no single task.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].cast("long").alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    n = BUCKETS * parts
    found = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("k"), sorted(set(found or []))))
    tops = sorted(((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("k").alias("top")).collect()), reverse=True)  # a row a bucket
    guests = [(above, top) for (above, _), (_, top) in zip(tops, tops[1:] + tops[:1], strict=True)]
    invited = spark.createDataFrame(guests, "to int, k long") if guests else spark.createDataFrame([], "to int, k long")
    visits = rows.join(F.broadcast(invited), rows["k"].eqNullSafe(invited["k"])).select(rows["k"], "t", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(visits).repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("k").desc_nulls_last(), "t")
    dealt = dealt.withColumn("tree", tree(F.col("t"))).withColumn("leaves", leaves(F.col("tree")))
    beside = dealt.select("k", "t", "tree", "leaves", "guest", F.lead("t").over(order).alias("next_text"), F.lead("leaves").over(order).alias("next_leaves"))
    return beside.where("guest = 0").select(F.col("k").alias(key), F.col("t").alias(text), "tree", "leaves", "next_text", "next_leaves")


def edited_by_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next document, with likenesses and where they differ."""
    rows = with_next(docs, key, text).withColumn("n_chars", F.length(text).cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col(text), F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.withColumn("edited_tree", tree(F.col("edited"))).withColumn("edited_leaves", leaves(F.col("edited_tree")))
    return rows.select(
        key,
        "n_chars",
        "edited",
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        differing(F.col("tree"), F.col("edited_tree")).alias("differing"),
    )
