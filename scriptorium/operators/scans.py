"""Running values over sequences of any length: scans by runs, whose results are carried from run to run.

A window by sequence gives one task the whole sequence. Here a sequence is cut into runs of consecutive rows; each run is scanned by
itself, gives a summary, the summaries (a row a run) are scanned, and what comes before a run is handed back to its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a run.
RUN = 1 << 16


def run_of(ordinal: str, length: int) -> Column:
    return F.expr(f"`{ordinal}` div {length}L")


def running(rows: DataFrame, key: str, ordinal: str, sums: Mapping[str, Column], lasts: Mapping[str, Column], length: int | None = None) -> DataFrame:
    """The rows with running ``sums`` and the ``lasts`` non-null values up to each row, by ``ordinal`` (from 0, gaps are allowed) among rows of one ``key``.

    Equals windows by ``key`` in order of ``ordinal``; a task gets runs of ``length`` ordinals at most. ``rows`` is read twice: store what is dear.
    """
    rows = rows.withColumn("_run", run_of(ordinal, length or RUN))
    inside = Window.partitionBy(key, "_run").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_sum_{n}") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(inside).alias(f"_last_{n}") for n, c in lasts.items()])
    ends = rows.groupBy(key, "_run").agg(
        F.lit(0).alias("_nothing"),
        *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col(ordinal))).alias(f"_last_{n}") for n, c in lasts.items()],
    )
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(key).alias("_key"), F.col("_run").alias("_of"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in lasts],
    ).where("_of > 0")
    joined = local.join(carried, local[key].eqNullSafe(carried["_key"]) & (local["_run"] == carried["_of"]), "left")
    out = [(F.coalesce(f"_sum_{n}", F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(f"_last_{n}", f"_before_{n}").alias(n) for n in lasts]
    kept = [local[c] for c in rows.columns if c != "_run" and c not in sums and c not in lasts]
    return joined.select(*kept, *out)
