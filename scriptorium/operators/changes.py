"""What a clean-up changed: a log of line and word differences per document (an Arrow function; a document is one row)."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources import shared


class Matcher(difflib.SequenceMatcher):
    """``difflib``'s matches, found by pairs of neighbours: blank lines are many, a blank line after a given one is not.

    The longest match of a range is the first of its length, so what is left of it only has shorter ones, and what is right of it none longer: a scan
    ends at the first match of the length that the range before it had. Where no pair matches, each item takes the first equal one.
    """

    def __init__(self, a: Sequence[Hashable], b: Sequence[Hashable]):
        super().__init__(None, a, b, autojunk=False)

    def get_matching_blocks(self) -> list[difflib.Match]:
        if self.matching_blocks is None:
            self.matching_blocks = [difflib.Match(*m) for m in self._merged(sorted(self._blocks()))]
        return self.matching_blocks

    def _merged(self, blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for i, j, n in blocks:
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
                out[-1] = (*out[-1][:2], out[-1][2] + n)
            else:
                out.append((i, j, n))
        return [*out, (len(self.a), len(self.b), 0)]

    def _blocks(self) -> list[tuple[int, int, int]]:
        ids: dict = {}
        a, b = ([ids.setdefault(x, len(ids)) for x in s] for s in (self.a, self.b))
        single, pairs = {}, {}
        for j, x in enumerate(b):
            single.setdefault(x, []).append(j)
        for j, x in enumerate(zip(b, b[1:], strict=False)):
            pairs.setdefault(x, []).append(j)
        met = [pairs.get(x, ()) for x in zip(a, a[1:], strict=False)]

        def longest(alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
            best, before = (alo, blo, 0), {}
            for i in range(alo, ahi - 1):
                now, places = {}, met[i]
                for at in range(bisect_left(places, blo), len(places)):
                    j = places[at]
                    if j >= bhi - 1:
                        break
                    n = now[j] = before.get(j - 1, 1) + 1
                    if n > best[2]:
                        best = (i - n + 2, j - n + 2, n)
                        if n == most:
                            return best
                before = now
            return best

        out, todo = [], [(0, len(a), 0, len(b), -1)]
        while todo:
            alo, ahi, blo, bhi, most = todo.pop()
            i, j, n = longest(alo, ahi, blo, bhi, most) if most < 0 or most > 1 else (0, 0, 0)
            if n:
                out.append((i, j, n))
                todo += [(alo, i, blo, j, n - 1), (i + n, ahi, j + n, bhi, n)]
                continue
            for i in range(alo, ahi):
                places = single.get(a[i], ())
                at = bisect_left(places, blo)
                if at < len(places) and places[at] < bhi:
                    out.append((i, places[at], 1))
                    blo = places[at] + 1
        return out


def differences(before: str, after: str) -> list[dict]:
    """``line`` (from 1, in the original), ``before``, ``after``: words of a line that changed alone, whole blocks of lines else."""
    old, new = before.splitlines(), after.splitlines()
    out: list[dict] = []
    for kind, a, b, c, d in Matcher(old, new).get_opcodes():
        if kind == "equal":
            continue
        if b - a > 1 or d - c > 1:
            out.append({"line": a + 1, "before": "\n".join(old[a:b]), "after": "\n".join(new[c:d])})
            continue
        words, others = " ".join(old[a:b]).split(), " ".join(new[c:d]).split()
        for way, e, f, g, h in Matcher(words, others).get_opcodes():
            if way != "equal":
                out.append({"line": a + 1, "before": " ".join(words[e:f]), "after": " ".join(others[g:h])})
    return out


def change_log():
    """``differences`` as a function of two columns."""

    @F.pandas_udf("array<struct<line:int,before:string,after:string>>")
    def log(before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([differences(a or "", b or "") for a, b in zip(before, after, strict=True)])

    return log


def between(cleaned: DataFrame, original: DataFrame, name: str = "book", text: str = "text") -> DataFrame:
    """``<name>, created_at, total_changes, changes`` of cleaned books against the originals of the same name; books without one are left out."""
    shared.small_batches(cleaned.sparkSession)
    both = cleaned.select(name, F.coalesce(text, F.lit("")).alias("after")).join(original.select(name, F.coalesce(text, F.lit("")).alias("before")), name)
    found = both.select(name, F.explode(F.array(change_log()(F.col("before"), F.col("after")))).alias("changes"))
    return found.select(name, F.date_format(F.current_timestamp(), "yyyy-MM-dd_HH-mm-ss").alias("created_at"), F.size("changes").alias("total_changes"), "changes")
