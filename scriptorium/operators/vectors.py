"""The vector collection: similarity, filtered top-k, two-stage ranking, and upsert into a Parquet table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.sources import shared


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length, null for vectors of different dimensions."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


# ---- filters


def compile_filter(spec: dict | None, df: DataFrame) -> Column:
    """A payload filter as a predicate: ``must`` all, ``should`` one at least, ``must_not`` none; an empty list restricts nothing."""
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict):
        raise TypeError(f"a filter is a dict, not {type(spec).__name__}")
    if unknown := set(spec) - {"must", "should", "must_not"}:
        raise ValueError(f"unknown filter parts: {sorted(unknown)}")
    as_list = lambda name: spec.get(name) if isinstance(spec.get(name), list) else [spec[name]] if spec.get(name) else []
    out = F.lit(True)
    for c in as_list("must"):
        out = out & _condition(c, df)
    if any_of := [_condition(c, df) for c in as_list("should")]:
        one = F.lit(False)
        for c in any_of:
            one = one | c
        out = out & one
    for c in as_list("must_not"):
        out = out & ~_condition(c, df)
    return out


def _condition(c: dict, df: DataFrame) -> Column:
    if not isinstance(c, dict):
        raise TypeError("a condition is a dict")
    if set(c) & {"must", "should", "must_not"}:
        return compile_filter(c, df)
    if "has_id" in c:
        return F.col("point_id").isin([str(x) for x in c["has_id"]])
    for name in ("is_null", "is_empty"):
        if name in c:
            key = c[name]["key"]
            column = F.col(key)
            blank = F.size(column) == 0 if dict(df.dtypes)[key].startswith("array") else F.lit(False)
            return column.isNull() | blank if name == "is_empty" else column.isNull()
    if set(c) == {"key", "match"}:
        return F.coalesce(_match(c["key"], c["match"], df), F.lit(False))
    if set(c) == {"key", "range"}:
        return F.coalesce(_range(F.col(c["key"]), c["range"]), F.lit(False))
    raise ValueError(f"unknown condition: {sorted(c)}")


def _match(key: str, match: dict, df: DataFrame) -> Column:
    column, is_array = F.col(key), dict(df.dtypes)[key].startswith("array")
    one_of = lambda values: F.arrays_overlap(column, F.array(*map(F.lit, values))) if is_array else column.isin(list(values))
    kinds = {
        "value": lambda v: one_of([v]),
        "any": lambda v: one_of(v) if v else F.lit(False),
        "except": lambda v: F.size(F.array_except(column, F.array(*map(F.lit, v)))) > 0 if is_array else ~column.isin(list(v)),
        "text": lambda v: F.contains(F.lower(column), F.lit(v.lower())),
    }
    (kind, value), *more = match.items()
    if kind not in kinds or more:
        raise ValueError(f"unknown match: {sorted(match)}")
    return kinds[kind](value)


def _range(column: Column, bounds: dict) -> Column:
    kinds = {"gt": lambda v: column > v, "gte": lambda v: column >= v, "lt": lambda v: column < v, "lte": lambda v: column <= v}
    if unknown := set(bounds) - set(kinds):
        raise ValueError(f"unknown range bounds: {sorted(unknown)}")
    out = F.lit(True)
    for k, v in bounds.items():
        out = out & kinds[k](v)
    return out


# ---- search


def top_k(points: DataFrame, query: list[float], k: int = 5, spec: dict | None = None, threshold: float | None = None, vector: str = "vector", key: str = "point_id") -> DataFrame:
    """The k points nearest to one query vector, best first, ties by key: the payload filter reaches the scan, the sort keeps k rows a task."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    found = points.where(compile_filter(spec, points)).withColumn("score", F.coalesce(cosine(F.col(vector), wanted), F.lit(0.0)))
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    return found.orderBy(F.desc("score"), key).limit(k)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of components of each vector of a column, 0 where it is null, has a null or non-finite component or no length; and the vectors, scaled to length 1, end to end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.sqrt(np.bincount(owner, flat**2, len(sizes)))
    good = np.isfinite(norms) & (norms > 0)
    return np.where(good, sizes, 0), flat[good[owner]] / norms[owner][good[owner]]


def packed(rows: DataFrame, key: str, vector: str, most: int, within: Sequence[str] = ()) -> DataFrame:
    """``<within>, dim, ids, matrix``: rows in blocks of at most ``most`` of one dimension, as they lie in their partitions; ``matrix`` holds unit vectors as 64-bit numbers.

    Vectors without a direction (see ``unit_rows``) have the dimension 0 and no matrix.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = unit_rows(batch.column(1))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            given = [c.to_pylist() for c in batch.columns[2:]]
            groups: dict[tuple, list[int]] = {}
            for i, d in enumerate(sizes.tolist()):
                groups.setdefault((*(c[i] for c in given), d), []).append(i)
            for (*same, dim), members in groups.items():
                for at in range(0, len(members), most):
                    part = np.array(members[at : at + most])
                    matrix = flat[(starts[part][:, None] + np.arange(dim)).ravel()].tobytes()
                    ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column(0).take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], c.type) for v, c in zip(same, batch.columns[2:], strict=True)), pa.array([dim], pa.int32()), ids, pa.array([matrix], pa.binary())], [*within, "dim", "ids", "matrix"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in within) + f"dim int, ids array<{kinds[key]}>, matrix binary"
    return rows.select(key, F.col(vector).cast("array<double>").alias("v"), *within).mapInArrow(run, schema)


def rounded(scores: np.ndarray, places: int | None) -> np.ndarray:
    return scores if places is None else np.sign(scores) * np.floor(np.abs(scores) * 10.0**places + 0.5) / 10.0**places


def nearest(pairs: DataFrame, k: int, threshold: float | None, places: int | None) -> DataFrame:
    """``q, p, score, compared``: of each pair of a block of points ``dim, ids, matrix`` and one of queries ``q_dim, q_ids, q_matrix`` the k nearest points of each query, ties by id.

    One matrix product a pair; blocks of different dimensions, or without a direction, score 0.
    """
    pairs = pairs.select("dim", "ids", "matrix", "q_dim", "q_ids", "q_matrix")
    kinds = [pairs.schema[n].dataType.elementType for n in ("q_ids", "ids")]
    ddl = f"q {kinds[0].simpleString()}, p {kinds[1].simpleString()}, score double, compared double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim, q_dim = batch.column(0)[row].as_py(), batch.column(3)[row].as_py()
                ids, q_ids = batch.column(1)[row].values, batch.column(4)[row].values
                order = pc.sort_indices(ids)
                scores = np.zeros((len(q_ids), len(ids)))
                if dim and dim == q_dim:
                    x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, dim) for c in (2, 5))
                    scores = (y @ x.T)[:, order.to_numpy()]
                compared = rounded(scores, places)
                q_at, p_at = [], []
                for i in range(len(q_ids)):
                    good = np.arange(len(ids)) if threshold is None else np.flatnonzero(scores[i] >= threshold)
                    if len(good) > k:
                        good = good[compared[i, good] >= np.partition(compared[i, good], len(good) - k)[len(good) - k]]
                    good = good[np.argsort(-compared[i, good], kind="stable")][:k]
                    q_at.append(np.full(len(good), i))
                    p_at.append(good)
                i, j = np.concatenate(q_at), np.concatenate(p_at)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(order).take(pa.array(j)), pa.array(scores[i, j]), pa.array(compared[i, j])], ["q", "p", "score", "compared"])

    return pairs.mapInArrow(run, ddl)


def best_of(near: DataFrame, k: int) -> DataFrame:
    """Of ``q, p, score, compared`` the k best of each query, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("compared"), "p"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def batch_top_k(points: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, vector: str = "vector", key: str = "point_id", query_key: str = "query_id", query_vector: str = "query_vector", block: int = 256, places: int | None = None) -> DataFrame:
    """The k nearest points of every query, by scores rounded to ``places`` if given, ties by key; a key stands for one point.

    Only keys and vectors travel, in blocks; each block of queries meets each block of points in one matrix product, which gives back
    k points a query. The points' other columns are joined to what is left. A vector that is null, has no length or another
    number of components than the query's scores 0. ``vector_index`` spares most of the products.
    """
    slices = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = packed(queries, query_key, query_vector, block).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    sliced = packed(points, key, vector, 4 * block).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    # queries are repeated for each slice, which estimates of their size don't know: they don't travel through the driver
    best = best_of(nearest(sliced.join(asked.hint("merge"), "slice"), k, threshold, places), k).select(F.col("q").alias(query_key), F.col("p").alias("__point"), "score", "rank")
    return best.join(points, F.col("__point") == F.col(key)).select(query_key, *points.columns, "score", "rank")


def rerank(found: DataFrame, score: Column, top_n: int, query_key: str = "query_id") -> DataFrame:
    """A second scorer's order over first-stage results; equal scores keep the first stage's order. Both scores stay."""
    scored = found.withColumnRenamed("rank", "initial_rank").withColumnRenamed("score", "vector_score").withColumn("rerank_score", score)
    order = Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), "initial_rank")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def lexical_overlap(query: Column, text: Column) -> Column:
    """The default offline rerank score: the share of a query's distinct words that a text has."""
    own = F.array_distinct(T.tokens(query))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, T.tokens(text))) / F.size(own)).otherwise(0.0)


def term_count(text: Column, query: Column) -> Column:
    """How often the words of a query occur in a text as substrings; a word given twice counts twice."""
    times = lambda low, t: ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("long")
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")
    # the text is bound to a name of its own: inside a lambda an outer expression would be computed for every word
    counted = lambda low: F.aggregate(words, F.lit(0).cast("long"), lambda s, t: s + times(low, t))
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), counted)[0]


def lexical_top_k(rows: DataFrame, query: str, k: int, text: str = "text", order: str = "ord") -> DataFrame:
    return rows.withColumn("score", term_count(F.col(text), F.lit(query))).orderBy(F.desc("score"), order).limit(k)


# ---- embedding


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The default offline embedding: words counted in ``dim`` hash buckets, scaled to length 1 (counted in an Arrow function)."""

    @F.pandas_udf("array<float>")  # made within a session
    def counted(places: pd.Series) -> pd.Series:
        def scaled(found: np.ndarray) -> np.ndarray:
            counts = np.bincount(found, minlength=dim).astype(np.float64)
            return (counts / max(np.sqrt((counts**2).sum()), 1e-300)).astype(np.float32)

        return places.map(scaled)

    return counted(F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")))


# ---- the store


class Collection:
    """A directory of Parquet files in ``BUCKETS`` parts by a hash of the id, and numbered manifests that tell where each part lies.

    An upsert reads and rewrites only the parts that its points fall into and then puts a new manifest in place; a manifest is created
    only if its number is free, so of two writers at once one raises and has changed nothing. Readers keep the manifest they
    began with; ``vacuum`` removes what the newest one doesn't name.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, dim: int, metric: str = "cosine"):
        self.spark, self.path, self.dim, self.metric = spark, path.rstrip("/"), dim, metric

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        target, files = self._file(path)
        return [x.getPath().getName() for x in files.listStatus(target)] if files.exists(target) else []

    def ensure(self) -> None:
        """Creates the collection if it is missing; one that exists is left as it is."""
        if not self._names(f"{self.path}/properties"):
            self.spark.createDataFrame([(self.dim, self.metric)], "dim int, metric string").coalesce(1).write.mode("append").json(f"{self.path}/properties")

    def _current(self) -> tuple[int, dict[int, str]]:
        """The number of the newest manifest, and the directory of each part; 0 and nothing before the first."""
        numbers = [int(n) for n in self._names(f"{self.path}/manifests") if n.isdigit()]
        if not numbers:
            return 0, {}
        target, files = self._file(f"{self.path}/manifests/{max(numbers)}")
        stream = files.open(target)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), {int(k): v for k, v in json.loads(text).items()}

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/data/{p}" for p in parts])

    def points(self) -> DataFrame:
        _, parts = self._current()
        if not parts:
            raise LookupError("the collection holds no points")
        return self._read(sorted(parts.values()))

    def upsert(self, rows: DataFrame, key: str = "point_id", order: str | None = None) -> None:
        """Adds points; one with a known id takes the other's place. Of equal ids in ``rows`` the greatest ``order`` stays.

        Write, audit, publish: the rows are computed once, into files that no manifest names, and what is wrong with them is observed on the way.
        Only if nothing is, those files and the parts that they fall into become new parts, and a manifest names them; else the collection stays as it was.
        """
        blank = F.col(key).isNull() | (T.strip(F.col(key).cast("string")) == "")
        part = F.pmod(F.xxhash64("point_id"), F.lit(self.BUCKETS)).cast("int")
        bad = F.col("vector").isNull() | (F.size("vector") != self.dim)
        rank = F.col(order) if order else F.lit(0)
        named = rows.select("*", F.when(~blank, T.point_id(F.col(key))).alias("__id"), rank.alias("__order"))
        named = named.withColumn("point_id", F.col("__id")).drop("__id").withColumn("__part", part)
        audit, name = Observation(), uuid.uuid4().hex
        arrived = f"{self.path}/data/{name}-arrived"
        watched = named.observe(audit, F.count("*").alias("rows"), F.count_if(bad).alias("bad"), F.count_if(blank).alias("blank"))
        try:
            watched.write.partitionBy("__part").parquet(arrived)
            found = audit.get
            if found["bad"]:
                raise ValueError(f"{found['bad']} of {found['rows']} vectors don't have {self.dim} components")
            if found["blank"]:
                raise ValueError(f"{found['blank']} of {found['rows']} point ids are blank")
            if found["rows"]:
                number, parts = self._current()
                touched = {int(x.removeprefix("__part=")) for x in self._names(arrived) if x.startswith("__part=")}
                fresh = last_wins(self.spark.read.schema(named.schema).parquet(arrived), "point_id", F.col("__order")).drop("__order").withColumn("__gen", F.lit(1))
                if known := [parts[p] for p in touched if p in parts]:
                    earlier = self._read(known).withColumn("__gen", F.lit(0)).withColumn("__part", part)
                    fresh = last_wins(earlier.unionByName(fresh, allowMissingColumns=True), "point_id", F.col("__gen"))
                fresh.drop("__gen").write.partitionBy("__part").parquet(f"{self.path}/data/{name}")
                self._point_at(number + 1, parts | {p: f"{name}/__part={p}" for p in touched})
        finally:
            shared.delete(self.spark, arrived)

    def _point_at(self, number: int, parts: dict[int, str]) -> None:
        target, files = self._file(f"{self.path}/manifests/{number}")
        try:
            stream = files.create(target, False)
        except Exception as e:
            raise RuntimeError("another writer has changed the collection meanwhile: try again") from e
        try:
            stream.write(bytearray(json.dumps(parts).encode()))
        finally:
            stream.close()

    def vacuum(self) -> int:
        """Removes files that the newest manifest doesn't name, and says of how many writes; not while others read or write."""
        number, parts = self._current()
        kept = {p.split("/")[0] for p in parts.values()}
        gone = [n for n in self._names(f"{self.path}/data") if n not in kept]
        for path in [*(f"data/{n}" for n in gone), *(f"manifests/{n}" for n in self._names(f"{self.path}/manifests") if n.isdigit() and int(n) < number)]:
            target, files = self._file(f"{self.path}/{path}")
            files.delete(target, True)
        return len(gone)


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, that of the greatest order."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n")
