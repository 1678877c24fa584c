"""Global row numbers without a single task: range partitions, a count for each run, prefix sums of the counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources import shared


def numbered(rows: DataFrame, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The rows with ``ordinal``, their number from 0 by ``order`` among rows equal in ``within``, and ``total``, how many those are.

    Rows are dealt to ranges and sorted there, whatever the sizes of the groups; the sums run over a row for each range and group, and
    what is stored is read by them and by the result. Nulls come first and are equal to each other. Rows that tie in all columns of
    ``order`` fall into one range, in any order: end ``order`` with a column that tells them apart where many may tie.
    """
    # the places come from the stored columns, not from where a later scan finds the rows
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    placed = shared.stored(dealt.withColumn("_run", F.spark_partition_id()).withColumn("_at", inside), "numbered")
    runs = placed.groupBy(*within, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy(*within)
    before = F.sum("_n").over(every.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select(
        *[F.col(c).alias(f"_{c}") for c in within],
        F.col("_run").alias("_r"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"),
        F.sum("_n").over(every).alias("total"),
    )
    same = placed["_run"] == offsets["_r"]
    for c in within:
        same &= placed[c].eqNullSafe(offsets[f"_{c}"])
    out = placed.join(offsets, same).select(*[placed[c] for c in rows.columns], (F.col("_at") + F.col("_offset")).alias("ordinal"), "total")
    out._stored_at = placed._stored_at  # for who has read the rows and wants them gone
    return out
