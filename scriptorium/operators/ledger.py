"""A ledger of model calls: what a model has answered is stored, and asked again of nobody.

A call is named by the SHA-256 of its settings and its request. A run joins the ledger first, asks only what is absent, each different request once, and appends the
replies wave by wave; so a second run makes no call, and one that broke goes on where it stopped. Equal requests get one reply, also from a model that would vary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Jobs in which the calls of a run are made: a broken run loses the calls of one.
WAVES = 8


class Ledger:
    """Replies by the names of their calls, in Parquet files under a path, one directory for each kind of call (its replies have one type)."""

    def __init__(self, spark: SparkSession, path: str, waves: int = WAVES):
        self.spark, self.path, self.waves = spark, path.rstrip("/"), waves

    def _known(self, kind: str) -> DataFrame | None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target):
            return None
        # two runs at once may both have made a call: one reply of it stays
        return self.spark.read.parquet(f"{self.path}/{kind}").groupBy("call").agg(F.min_by("reply", F.struct("asked_at", "task")).alias("reply"))

    def replies(self, rows: DataFrame, kind: str, request: Column, call: Callable[[Column], Column] | None = None, settings: Mapping | None = None, many: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows with ``reply``, what ``call`` makes of the column ``request``; the settings are part of a call's name. A null request has no reply and makes no call.

        A model that takes many requests at a time goes in as ``many``: it gets rows ``call, request`` and returns them with ``reply``.
        """
        told = F.lit(json.dumps(dict(settings or {}), sort_keys=True, ensure_ascii=False))
        name = F.sha2(F.concat_ws("\n", F.lit(kind), told, F.to_json(F.struct(request.alias("request")), {"ignoreNullFields": "false"})), 256)
        named = rows.withColumn("_request", request).withColumn("_call", F.when(F.col("_request").isNotNull(), name))
        wanted = named.where("_call is not null").groupBy("_call").agg(F.any_value("_request").alias("_request"))
        for wave in range(self.waves):
            part = wanted.where(F.pmod(F.xxhash64("_call"), F.lit(self.waves)) == wave)
            known = self._known(kind)
            if known is not None:
                part = part.join(known.select(F.col("call").alias("_call")), "_call", "left_anti")
            # behind a generator the reply is a column: the model is asked once for it
            part = part.select(F.col("_call").alias("call"), F.col("_request").alias("request"))
            asked = part.withColumn("reply", F.explode(F.array(call(F.col("request"))))) if many is None else many(part)
            asked = asked.select("call", "reply").withColumn("asked_at", F.current_timestamp()).withColumn("task", F.spark_partition_id())
            asked.write.mode("append").parquet(f"{self.path}/{kind}")
        known = self._known(kind).select(F.col("call").alias("_call"), "reply")
        return named.join(known, "_call", "left").select(*rows.columns, "reply")

    def calls(self, kind: str) -> DataFrame:
        """``call, reply`` of all calls of a kind."""
        known = self._known(kind)
        if known is None:
            raise LookupError(f"no calls of the kind {kind!r}")
        return known
