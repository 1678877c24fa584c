"""Paragraphs that look misread: scores by scripts, capitals, odd signs, and a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import dictionary, structure

# Signs besides letters, digits and white space that clean text holds.
ALLOWED = r""" .,:;!?"'«»„()\[\]{}<>\-–—/%&+#°•…"""


def _cyrillic(w: Column) -> Column:
    return w.rlike(f"[{T.CYR}]")


def _latin(w: Column) -> Column:
    return w.rlike("[A-Za-z]")


def _words(words: Column, in_cyrillic: Column, known: Column | None) -> Column:
    """Counts and flags over the words, in order: whether a short Latin word counts depends on the Cyrillic words up to it."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("n_latin", "n_cyr", "n_latin_only", "n_flagged", "mixed", "capitals", "strangers", "unknown")])

    def looked_at(w: Column) -> Column:
        """What the fold needs of a word, each found once. Words hold letters of ``LETTER`` only, so classes tell their case: case folding costs many times more."""
        large, small = w.rlike("[A-ZА-ЯЁ]"), w.rlike("[a-zа-яё]")
        return F.struct(
            _cyrillic(w).alias("cyr"), _latin(w).alias("lat"), F.length(w).alias("length"), (large & ~small).alias("upper"),
            w.rlike("[A-ZА-ЯЁ].*[A-ZА-ЯЁ]").alias("capitals"), (F.lit(None) if known is None else F.lower(w)).alias("word"),
        )

    def judged(x: Column, n_cyr: Column) -> Column:
        unknown = x["cyr"] & (x["length"] >= 5) & ~F.array_contains(known, x["word"]) if known is not None else F.lit(False)
        stranger = in_cyrillic & x["lat"] & ~x["cyr"] & ((x["length"] >= 4) | (n_cyr >= 3)) & ~x["upper"]
        return F.struct((x["cyr"] & x["lat"]).alias("mixed"), (x["capitals"] & ~x["upper"]).alias("capitals"), stranger.alias("stranger"), unknown.alias("unknown"))

    def step(a: Column, x: Column) -> Column:
        n_cyr = a["n_cyr"] + x["cyr"].cast("int")
        j = judged(x, n_cyr)
        mixed, capitals, stranger, unknown = (j.getField(n) for n in ("mixed", "capitals", "stranger", "unknown"))
        values = {
            "n_latin": a["n_latin"] + x["lat"].cast("int"),
            "n_cyr": n_cyr,
            "n_latin_only": a["n_latin_only"] + (x["lat"] & ~x["cyr"]).cast("int"),
            "n_flagged": a["n_flagged"] + (mixed | capitals | stranger | unknown).cast("int"),
            "mixed": a["mixed"] + mixed.cast("int"),
            "capitals": a["capitals"] + capitals.cast("int"),
            "strangers": a["strangers"] + stranger.cast("int"),
            "unknown": a["unknown"] + unknown.cast("int"),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    return F.aggregate(F.transform(words, looked_at), zero, step)


def scored(paragraphs: DataFrame, known: str | None = None) -> DataFrame:
    """Paragraphs (``lines`` array) with ``text, score, reasons`` and ``kept_always``; ones without words and headings are left out.

    Where the column ``known`` holds the words that a dictionary has, longer Cyrillic words that it lacks count too; else none does.
    """
    df = paragraphs.withColumn("text", T.strip(F.array_join("lines", "\n")))
    df = df.where(~F.regexp_replace(F.element_at("lines", 1), r"(?U)^[\s\x1c-\x1f]+", "").startswith("#") & F.col("text").rlike(rf"[{T.LETTER}']"))
    df = df.withColumn("found", F.regexp_extract_all("text", F.lit(rf"[{T.LETTER}']+"), F.lit(0)))
    words = F.filter(F.transform("found", lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")
    # behind a generator the fold and the counts are columns; a filter on the score would compute them at every mention
    counts = F.struct(F.size("found").alias("n_words"), (T.n_cyrillic(F.col("text")) >= T.n_latin(F.col("text"))).alias("in_cyr"))
    df = df.select("*", F.inline(F.array(F.struct(words.alias("words"), counts.alias("c"))))).drop("found")
    df = df.select("*", F.explode(F.array(_words(F.col("words"), F.col("c.in_cyr"), None if known is None else F.col(known)))).alias("w")).drop("words")
    solid = F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]++", ""))
    weird = F.length(F.regexp_replace("text", rf"(?U)[\s\x1c-\x1f0-9{T.LETTER}{ALLOWED}]++", ""))
    df = df.withColumn("weird", F.when(solid > 0, weird / solid).otherwise(0.0)).withColumn("latin_share", F.col("w.n_latin") / F.greatest(F.col("w.n_latin") + F.col("w.n_cyr"), F.lit(1)))
    odd, share = F.col("weird") > 0.05, (F.col("w.n_cyr") >= 4) & (F.col("w.n_latin") > 0) & (F.col("latin_share") > 0.2)
    only = F.col("c.in_cyr") & (F.col("w.n_latin_only") > 0)
    extra = F.greatest(F.when(F.col("w.strangers") > 0, 0.5).otherwise(0.0), F.when(only, F.least(F.lit(0.6), 0.4 + 0.05 * F.col("w.n_latin_only"))).otherwise(0.0))
    parts = F.col("w.n_flagged") / F.col("c.n_words") + F.when(odd, F.least(F.lit(0.4), (F.col("weird") - 0.05) * 4)).otherwise(0.0) + F.when(share, F.least(F.lit(0.4), (F.col("latin_share") - 0.2) * 2)).otherwise(0.0)
    named = [(F.col("w.mixed") > 0, "mixed-script"), (F.col("w.capitals") > 0, "mixed-case"), (F.col("w.unknown") > 0, "unknown-cyr"), (F.col("w.strangers") > 0, "latin-in-cyr"), (odd, "weird-chars"), (share, "latin-ratio"), (only, "latin-only")]
    reasons = F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in named]), lambda x: x.isNotNull()))
    short, comment = F.length("text") <= 10, F.col("text").rlike(r"(?d)^<!--.*-->\z")
    latin = _latin(F.col("text"))
    score = F.when(short, F.when(latin, 0.6).otherwise(0.3)).when(comment, 0.7).otherwise(F.least(F.lit(1.0), parts + extra))
    why = F.when(short, F.when(latin, F.array(F.lit("latin-only"), F.lit("short-fragment"))).otherwise(F.array(F.lit("short-fragment")))).when(comment, F.array(F.lit("html-comment"))).otherwise(reasons)
    return df.withColumn("score", score).withColumn("reasons", why).withColumn("kept_always", short | comment | (F.col("w.mixed") > 0)).drop("c", "w", "weird", "latin_share")


def priority(reasons: Column) -> Column:
    """0 for Latin among Cyrillic, 1 for mixed scripts, 2 for odd signs, 4 for mere fragments, else 3."""
    has = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    return F.when(has("latin-only", "latin-in-cyr"), 0).when(has("mixed-script", "latin-ratio"), 1).when(has("unknown-cyr", "weird-chars"), 2).when(has("short-fragment"), 4).otherwise(3)


def suspicious(docs: DataFrame, key: str, text: str = "text", min_score: float = 0.45, most: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """``key, rank, text, score, reasons, start_line, end_line``: each document's suspicious paragraphs, worst first, ``most`` at most.

    ``words(word)`` is a dictionary; it is asked once for each document's longer Cyrillic words.
    """
    rows = structure.paragraphs(docs, key, text)
    if words is not None:
        long = F.filter(F.regexp_extract_all(text, F.lit(rf"[{T.LETTER}']+"), F.lit(0)), lambda w: _cyrillic(w) & (F.length(w) >= 5))
        asked = F.transform(long, lambda w: F.lower(F.regexp_replace(w, "^'+|'+$", "")))
        rows = rows.join(dictionary.with_known(docs.select(key, text), words, key, asked).select(key, "known"), key)
    rows = scored(rows, None if words is None else "known").where(F.col("kept_always") | ((F.col("score") >= min_score) & (F.size("reasons") > 0)))
    order = Window.partitionBy(key).orderBy(priority(F.col("reasons")), F.round("score", 9).desc(), "start_line")
    rows = rows.withColumn("rank", F.row_number().over(order))
    if most is not None:
        rows = rows.where(F.col("rank") <= most)
    return rows.select(key, "rank", "text", "score", "reasons", "start_line", "end_line")
