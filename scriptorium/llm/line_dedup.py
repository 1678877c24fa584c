"""Fuzzy line dedup by MinHash over character shingles. DataFrame functions only.

Lines that aren't blank are compared by the sets of their runs of eight characters (a shorter line is one run). Each set has 24
extreme hashes. Every run of every line is hashed to four words of 64 bits; a component orders the runs by one of the words, rotated by
one of three numbers of places, and takes the least or the greatest. The leading 21 bits of the twelve that take the least are all different bits of the
four words, and so are those of the twelve that take the greatest, so bands behave as those of independent hashes do (``tests/llm`` holds the bits and the
rates). Eight bands of three make candidates: at similarity 0.8 a pair is missed once in 310 times, at 0.9 once in 34 000.

A bucket of two lines is a pair. The lines of larger buckets, of equal buckets those of the first, are dealt to blocks of about ``BLOCK`` lines. Inside a block every
pair of lines is ruled out by the bound that their bitmaps give (it loses nothing) or verified by the exact Jaccard similarity,
unless what was found before has joined the two already; a block gives back one link for each join, a spanning forest. Links become
components by distributed union-find. Buckets of several blocks that still hold several components are searched once more between
blocks: lines outside the bucket's commonest component meet every block of it, and what is found joins components. So no pair is listed, no large bucket is gathered whole
(those that are too large for a task are counted before their lines travel, ``heavy``) and no link between components is lost. One line of each component stays, where it comes first: in the document of the least key, at
the least line number. Other lines of the component go.

Lines are named by a 64-bit hash and told apart by a second one: a line goes only with lines that agree in both, or in the component
of the line that its first hash stands for.

Defined results: a null text has no line; blank lines always stay; equal lines are one line; rows with a null key are left alone;
rows that repeat a key are one document of which every row loses the same line numbers, so keys should be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import components, runtime

SHINGLE, BANDS, ROWS = 8, 8, 3
#: The four hashes of a run, each the hash of the one before, and the places by which components rotate them: of those that take the least, and the greatest.
HASHES, PLACES = "hgef", ((0, 21, 42), (10, 31, 52))
#: What an earlier family of components rotated its two hashes by; only its test reads it.
TURNS = (15, 22)
#: Runs of a line in a row while it is signed.
STEP = 12
#: Words of a line's bitmap.
WORDS = 16
#: Words that are compared first.
FIRST_WORDS = 4
#: Lines in a block of a bucket.
BLOCK = 64
#: Lines of a bucket that one task may get, at least, and how many of a larger share's are drawn to find it.
LARGE, SEEN = 1 << 14, 64
#: Parts in which the places of a line meet the first of them, so that no task gets those of a line that is everywhere.
SALTS = 8


def _last(wide: Column) -> Column:
    """Where the last run of a line in UTF-32 starts, in bytes from 1."""
    return F.greatest(F.length(wide) - (4 * SHINGLE - 1), F.lit(1))


def _run(wide: Column, start: Column) -> Column:
    """The hash of a run of a line in UTF-32."""
    return F.xxhash64(F.substring(wide, start, F.lit(4 * SHINGLE)))


def _hashes(line: Column) -> Column:
    """The run hashes of a line, in order."""
    # the encoded line is bound to a name of its own: inside a lambda an outer expression would be computed for every element
    runs = lambda wide: F.transform(F.sequence(F.lit(1), _last(wide), F.lit(4)), lambda start: _run(wide, start))
    return F.transform(F.array(F.encode(line, "UTF-32")), runs)[0]


def shingles(line: Column) -> Column:
    """The distinct run hashes of a line."""
    return F.array_distinct(_hashes(line))


def alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct hashes reaches the threshold."""
    return F.size(F.array_intersect(a, b)) * (1 + threshold) >= threshold * (F.size(a) + F.size(b)) - 1e-9


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, n, id, check, line`` of the lines that aren't blank, numbered from 0."""
    rows = docs.select(docs[key].alias("k"), F.posexplode(F.split(docs[text].cast("string"), "\n", -1)).alias("n", "line"))
    rows = rows.where("k is not null").where(F.col("line").rlike(r"[^\s]"))
    return rows.select("k", "n", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("check"), "line")


def _turned(word: Column, places: int) -> Column:
    places %= 64
    return F.shiftleft(word, places).bitwiseOR(F.shiftrightunsigned(word, 64 - places)) if places else word


def places(i: int) -> tuple[bool, str, int]:
    """Whether the i-th component takes the greatest, the hash that it orders runs by, and the places by which that is rotated."""
    greatest, at = divmod(i, BANDS * ROWS // 2)
    return bool(greatest), HASHES[at % len(HASHES)], PLACES[greatest][at // len(HASHES)]


def _component(i: int) -> Column:
    """The i-th component of the lines that rows of ``STEP`` runs are grouped by."""
    greatest, word, turn = places(i)
    values = [_turned(F.col(f"{word}{j}"), turn) for j in range(STEP)]
    return F.max(F.greatest(*values)) if greatest else F.min(F.least(*values))


def banded(lines: DataFrame) -> DataFrame:
    """``id, bands``: the band keys of each line ``id, line``. Extremes are taken before rows travel, so a line that is everywhere costs a row a task."""
    wide = lines.select("id", F.encode("line", "UTF-32").alias("wide")).select("id", "wide", _last(F.col("wide")).alias("last"))
    rows = wide.select("id", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * STEP))).alias("start"))
    runs = rows.select("id", *[_run(F.col("wide"), F.least(F.col("start") + 4 * j, "last") if j else F.col("start")).alias(f"h{j}") for j in range(STEP)])
    for before, word in zip(HASHES, HASHES[1:], strict=False):
        runs = runs.select("*", *[F.xxhash64(f"{before}{j}").alias(f"{word}{j}") for j in range(STEP)])
    least = runs.groupBy("id").agg(*[_component(i).alias(f"m{i}") for i in range(BANDS * ROWS)])
    key = lambda b: F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)])
    return least.select("id", F.array(*map(key, range(BANDS))).alias("bands"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose similarity reaches the threshold."""
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("s")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")
    # a filter would compute the sets at every mention; behind a generator they are columns
    sets = both.select("a", "b", F.inline(F.array(F.struct(shingles(F.col("s")).alias("x"), shingles(F.col("t")).alias("y")))))
    return sets.where(alike(F.col("x"), F.col("y"), threshold)).select("a", "b")


def drawn(texts: DataFrame) -> DataFrame:
    """``id, line, runs, bits`` of lines ``id, line``: how many distinct runs a line has, and the parity of their number in each of 64 x WORDS bins.

    Two sets differ in at least as many runs as their bitmaps differ in bits.
    """
    runs = texts.select("id", F.explode(shingles(F.col("line"))).alias("h"))
    bins = runs.select("id", F.pmod("h", F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, int(shiftrightunsigned(h, 8) & 63))").alias("bit"))
    words = bins.groupBy("id", "word").agg(F.bit_xor("bit").alias("bits"), F.count("*").alias("runs"))
    of = lambda w: F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0))
    maps = words.groupBy("id").agg(F.sum("runs").alias("runs"), *[of(w).alias(f"b{w}") for w in range(WORDS)])
    return texts.join(maps.select("id", "runs", F.array(*[f"b{w}" for w in range(WORDS)]).alias("bits")), "id")


def _possible(x: Column, y: Column, threshold: float) -> Column:
    """Whether two drawn lines may be alike: no earlier band has the pair, and the bitmaps leave it open, of which the first words settle most."""
    apart = lambda words: sum(F.bit_count(x["bits"][w].bitwiseXOR(y["bits"][w])) for w in range(words))
    within = lambda words: apart(words) * (1 + threshold) <= (1 - threshold) * (x["runs"] + y["runs"]) + 1e-9
    sizes = (F.least(x["runs"], y["runs"]) + 1e-9) >= threshold * F.greatest(x["runs"], y["runs"])
    return sizes & within(FIRST_WORDS) & ~F.arrays_overlap(x["earlier"], y["earlier"]) & within(WORDS)


def _shares(x: Column, y: Column, hx: Column, hy: Column, threshold: float) -> Column:
    """``alike`` of two drawn lines, whose numbers of distinct runs are known, by the hashes of all their runs."""
    both = x["runs"] - F.size(F.array_except(hx, hy))
    return both * (1 + threshold) >= threshold * (x["runs"] + y["runs"]) - 1e-9


def _joined(left: Column, right: Column, threshold: float) -> Column:
    """Links ``a, b`` that join the components of two lists of lines ``root, common, earlier, runs, bits, line``: a spanning forest of what is alike.

    The two lines of a pair come in the order of their components, but where the right one is of the bucket's commonest, which the left list leaves out.
    """

    def found(z: Column) -> Column:
        label = lambda labels, x: F.element_at(labels, F.array_position(z["names"], x["root"]).cast("int"))

        def pair(labels: Column, x: Column, h: Column, y: Column) -> Column:
            p, q = label(labels, x), label(labels, y)
            merged = F.transform(labels, lambda c: F.when((c == p) | (c == q), F.least(p, q)).otherwise(c))
            return F.when((p != q) & _shares(x, y, h, _hashes(y["line"]), threshold), merged).otherwise(labels)

        def against(labels: Column, x: Column, near: Column) -> Column:
            one = lambda own, h: F.aggregate(near, own, lambda now, y: pair(now, x, h, y))
            return F.when(F.size(near) == 0, labels).otherwise(F.aggregate(F.array(_hashes(x["line"])), labels, one))

        def row(labels: Column, x: Column) -> Column:
            # what is joined already is left out here, so that a line of which nothing else is near isn't hashed again
            near = F.filter(z["right"], lambda y: (y["common"] | (x["root"] < y["root"])) & (label(labels, x) != label(labels, y)) & _possible(x, y, threshold))
            return F.aggregate(F.array(near), labels, lambda now, ys: against(now, x, ys))

        labels = F.aggregate(z["left"], z["names"], row)
        return F.filter(F.arrays_zip(z["names"].alias("a"), labels.alias("b")), lambda c: c["a"] != c["b"])

    roots = F.array_distinct(F.transform(F.concat(left, right), lambda x: x["root"]))
    return F.flatten(F.transform(F.array(F.struct(left.alias("left"), right.alias("right"), roots.alias("names"))), found))


def _item() -> Column:
    return F.struct("root", "common", "earlier", "runs", "bits", "line")


def _inside(dealt: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` within each block of ``band, own, id, earlier``."""
    rows = dealt.join(lines, "id").withColumn("root", F.col("id")).withColumn("common", F.lit(False)).repartition("band", "own")
    blocks = rows.groupBy("band", "own").agg(F.collect_list(_item()).alias("all"))
    return _links(blocks.select(F.col("all").alias("left"), F.col("all").alias("right")), threshold)


def _between(dealt: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between the blocks of each bucket of ``band, own, blocks, id, earlier, root``: lines outside the commonest component meet every block."""
    counts = dealt.groupBy("band", "root").agg(F.count("*").alias("times"))
    most = counts.groupBy("band").agg(F.max(F.struct("times", "root")).alias("most"), F.count("*").alias("roots"), F.sum("times").alias("size")).where("roots > 1")
    most = most.select("band", F.col("most.root").alias("of_most"), F.ceil((F.col("size") - F.col("most.times")) / BLOCK).alias("outer"))
    rows = dealt.join(most, "band").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id"), "outer")).withColumn("common", F.col("root") == F.col("of_most"))
    every = F.expr("sequence(0L, blocks - 1)")
    placed = rows.select("band", "id", "root", "common", "earlier", F.explode(F.transform(F.expr("sequence(0L, outer - 1)"), lambda o: F.struct(o.alias("o"), F.col("own").alias("i"), F.lit(False).alias("out")))).alias("at"))
    outside = rows.where("not common").select("band", "id", "root", "common", "earlier", F.explode(F.transform(every, lambda i: F.struct(F.col("block").alias("o"), i.alias("i"), F.lit(True).alias("out")))).alias("at"))
    both = placed.unionByName(outside).select("band", "id", "root", "common", "earlier", "at.*").join(lines, "id").repartition("band", "o", "i")
    blocks = both.groupBy("band", "o", "i").agg(F.collect_list(F.when(F.col("out"), _item())).alias("left"), F.collect_list(F.when(~F.col("out"), _item())).alias("right"))
    return _links(blocks, threshold)


def _links(blocks: DataFrame, threshold: float) -> DataFrame:
    return blocks.select(F.explode(_joined(F.col("left"), F.col("right"), threshold)).alias("x")).select("x.a", "x.b")


def _members(bands: DataFrame) -> DataFrame:
    return bands.select("id", F.posexplode("bands").alias("place", "band"))


def heavy(bands: DataFrame) -> DataFrame:
    """``band, size, a, b, content`` of the buckets that are too large for one task, in which rows needn't meet.

    They are looked for among the lines of some hashes of the id, so that a bucket of ``share`` lines has ``SEEN`` of them: that finds all that matter, and a few
    smaller ones do no harm. They are fewer than eight times the shuffle partitions, whatever the data.
    """
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(LARGE, bands.count() * BANDS // (4 * parts))
    drawn = _members(bands.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, share // SEEN))) == 0))
    found = drawn.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN // 2).select("band")
    return _members(bands).join(F.broadcast(found), "band").groupBy("band").agg(*_summary())


def _summary() -> list[Column]:
    return [F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("b"), F.bit_xor(F.xxhash64(F.lit(3), "id")).alias("content")]


def shared(bands: DataFrame) -> DataFrame:
    """``id, band, place, size, a, b, content``: a row for each line of each bucket of several; ``place`` is the band's number, ``a`` and ``b`` are the bucket's least and greatest line.

    Equal ``size, a, b, content`` mean equal members. The members of a bucket are counted where they meet, in one shuffle; those of ``heavy`` buckets are counted
    before they travel, and get the counts without meeting.
    """
    large = runtime.stored(heavy(bands), "heavy")
    known = F.broadcast(large.select(F.col("band").alias("_band"), *[F.col(c).alias(f"_{c}") for c in ("size", "a", "b", "content")]))  # bounded, see ``heavy``
    rows = _members(bands)
    whole = Window.partitionBy("band")
    met = rows.join(known.select("_band"), F.col("band") == F.col("_band"), "left_anti")
    counted = met.select("id", "band", "place", F.count("*").over(whole).alias("size"), F.min("id").over(whole).alias("a"), F.max("id").over(whole).alias("b"), F.bit_xor(F.xxhash64(F.lit(3), "id")).over(whole).alias("content"))
    told = rows.join(known, F.col("band") == F.col("_band")).select("id", "band", "place", *[F.col(f"_{c}").alias(c) for c in ("size", "a", "b", "content")])
    return counted.where("size > 1").unionByName(told.where("size > 1"))


def _first_of_equals(members: DataFrame) -> DataFrame:
    """``band`` of the larger buckets, only the first of those with the same lines: the others have no pair that it hasn't."""
    buckets = members.where("size > 2 and id = a")
    return buckets.groupBy("size", "a", "b", "content").agg(F.min(F.struct("place", "band")).alias("first")).select("first.band")


def _components(lines: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The lines ``id, check, line`` that share a bucket with another, and ``node, root`` of all that are linked but the roots themselves."""
    spark = lines.sparkSession
    bands = runtime.stored(banded(lines.select("id", "line")), "bands")
    runtime.release(spark)
    members = runtime.stored(shared(bands), "members")
    pairs = members.where("size = 2 and id = a").select("a", "b").distinct()
    dealt = members.where("size > 2").join(_first_of_equals(members).select("band"), "band", "left_semi").join(bands, "id")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = runtime.stored(dealt.select("id", "band", "blocks", "own", F.expr("slice(bands, 1, place)").alias("earlier")), "dealt")
    runtime.forget(bands)
    runtime.release(spark)
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(dealt.select("id")).distinct()
    texts = lines.groupBy("id").agg(F.min(F.struct("check", "line")).alias("x")).join(wanted, "id")
    texts = runtime.stored(texts.select("id", "x.check", "x.line"), "lines")
    runtime.release(spark)
    drawn_ = runtime.stored(drawn(texts.select("id", "line").join(dealt.select("id").distinct(), "id")), "drawn")
    links = runtime.stored(_verified(pairs, texts, threshold).unionByName(_inside(dealt, drawn_, threshold)), "links")
    runtime.release(spark)
    roots = components.components(links)
    large = dealt.where("blocks > 1")
    if not large.isEmpty():
        large = large.join(roots, large["id"] == roots["node"], "left").select("id", "band", "blocks", "own", "earlier", F.coalesce("root", "id").alias("root"))
        between = runtime.stored(_between(large, drawn_, threshold), "between")
        runtime.release(spark)
        above = components.components(between)  # links of roots, which are few: what hangs on them need not travel through every round again
        moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = runtime.stored(moved.unionByName(above), "roots")
        runtime.release(spark)
    return texts.select("id", "check"), roots


def removed_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, removed``: the numbers of the lines that each document loses; documents that lose none are left out."""
    lines = lines_of(docs, key, text)
    places = runtime.stored(lines.select("id", "check", "k", "n"), "places")
    named, roots = _components(lines.select("id", "check", "line"), threshold)
    nodes = roots.select(F.col("node").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    rows = places.join(nodes.join(named, "id"), ["id", "check"], "left")
    rows = rows.select("k", "n", F.coalesce("root", "id").alias("set"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("part"))
    heads = rows.groupBy("set", "part").agg(F.min(F.struct("k", "n")).alias("head"), F.count("*").alias("times")).where("times > 1").drop("times")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k", "n"), F.lit(SALTS)).cast("int"))
    gone = salted.join(heads, ["set", "part", "salt"]).where(F.struct("k", "n") != F.col("head"))
    return gone.groupBy("k").agg(F.array_sort(F.collect_set("n")).alias("removed"))


def without_lines(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, less the lines they lose; those that lose their last line that isn't blank go."""
    gone = removed_lines(docs, threshold, key, text).select(F.col("k").alias("__k"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, docs[key] == gone["__k"], "left")
    kept = F.array_join(F.filter(F.split(docs[text].cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    joined = joined.withColumn("__kept", F.when(F.col("__removed").isNull(), docs[text]).otherwise(kept))
    joined = joined.where(F.col("__removed").isNull() | F.col("__kept").rlike(r"[^\s]"))
    return joined.select(*[F.col("__kept").alias(c) if c == text else docs[c] for c in docs.columns])  # a null text stays null
