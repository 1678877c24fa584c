"""Exact top-k by integer inner product through norm-bucketed retrieval.

Vectors are scaled to integers, range-partitioned by length and packed into buckets of similar length. A query takes a first
lower bound of its k-th best score from its own bucket. Against any other bucket that bound becomes a local cosine threshold,
``bound / (|query| * longest in bucket)``: above 1 the whole bucket is left out, near 1 a few coordinates of the candidates'
directions are tested against the range the threshold leaves them, and else only lengths are. What remains is verified by
the exact product. Queries are packed into blocks. Buckets of neighbouring lengths lie at one place; which places a block must
reach is settled from lengths and bounds alone, so vectors are sent only where a product can count, and neither side is broadcast.

Defined results: rows whose id is null, or whose vector is null or holds a null, non-finite or (scaled) out-of-range
component, take no part; a score that leaves the range of long raises ``OverflowError``; a vector meets only vectors of its own dimension; rows equal in id and vector count once; a query
never meets a row of its own id; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import runtime

#: Local cosine threshold from which coordinates are tested, and how many of them.
COORDINATE_FROM, COORDINATES = 0.85, 4
#: Room for rounding in the bounds, which are computed in floating point.
SLACK = 1e-9


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, queries, lists = (batch.column(i) for i in range(3))
            out = []
            for i, q, v in zip(ids.to_pylist(), queries.to_pylist(), lists, strict=True):
                if i is None or not v.is_valid or (values := v.values).null_count:
                    continue
                x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
                    out.append((i, bool(q), len(x), float(np.sqrt((x * x).sum())), x.astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, [pa.int64(), pa.bool_(), pa.int32(), pa.float64(), pa.binary()], strict=True)], ["id", "is_query", "dim", "norm", "ints"])

    return run


def _packed(ints: np.ndarray) -> bytes:
    """A matrix in the narrowest integer type, named by the first byte."""
    top = max(int(ints.max(initial=0)), -int(ints.min(initial=0)) - 1)
    kind = next(i for i, bits in enumerate((15, 31, 63)) if top < 1 << bits)
    return bytes([kind]) + ints.astype(("<i2", "<i4", "<i8")[kind]).tobytes()


def _matrix(packed: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(packed, ("<i2", "<i4", "<i8")[packed[0]], offset=1).reshape(rows, dim) if dim else np.zeros((rows, 0), np.int64)


BLOCK = "dim int, rows int, top double, ids binary, bounds binary, vectors binary"


def _block_row(dim: int, ids, bounds, ints: np.ndarray) -> tuple:
    norms = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
    return dim, len(ids), float(norms.max(initial=0.0)), np.asarray(ids, "<i8").tobytes(), np.asarray(bounds, "<f8").tobytes(), _packed(ints)


def _block_batch(rows: list[tuple], extra: list[tuple[str, pa.Array]] | None = None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = [x.split()[0] for x in BLOCK.split(", ")]
    for name, array in extra or []:
        arrays.append(array)
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products: by floating point where every partial sum is exact in it, else by whole numbers."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = queries.astype(object) @ rows.astype(object).T
    if whole.size and max(abs(whole.max()), abs(whole.min())) >= 1 << 63:
        raise OverflowError("a score leaves the range of long")
    return whole.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def survivors(query: np.ndarray, bound: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Places of the bucket's rows that can reach ``bound``; None if no row can. ``norms`` fall."""
    length, top = float(np.sqrt((query * query).sum())), float(norms[0])
    if not np.isfinite(bound) or length * top == 0:
        return None if bound > 0 and np.isfinite(bound) else np.arange(len(rows))
    local = bound / (length * top)
    if local > 1 + SLACK:
        return None
    if local <= 0:
        return np.arange(len(rows))
    reach = np.searchsorted(-norms, -(bound / length) * (1 - SLACK), "right")  # rows long enough
    if local < COORDINATE_FROM:
        return np.arange(reach)
    local = min(local, 1.0)
    direction = query / length
    kept = np.arange(reach)
    for f in np.argsort(-np.abs(direction))[:COORDINATES]:
        a, b = np.arccos(np.clip(direction[f], -1, 1)), np.arccos(local)
        low, high = np.cos(min(np.pi, a + b)) - 1e-7, np.cos(max(0.0, a - b)) + 1e-7
        x = rows[kept, f] / np.maximum(norms[kept], 1e-300)
        kept = kept[(x >= low) & (x <= high)]
    return kept


def least_top(queries: np.ndarray, bounds: np.ndarray) -> float:
    """The length below which no row can reach the bound of any of the queries."""
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((lengths > 0) & (bounds > 0), bounds / lengths, -np.inf)
    return float(need.min(initial=np.inf)) * (1 - SLACK)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = _matrix(row["vectors"], row["dim"], row["rows"])
            ids = np.frombuffer(row["ids"], "<i8")
            queries = _matrix(row["q_vectors"], row["dim"], row["q_rows"])
            bounds, query_ids = np.frombuffer(row["q_bounds"], "<f8"), np.frombuffer(row["q_ids"], "<i8")
            norms, real, wide = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)), rows.astype(np.float64), queries.astype(np.float64)
            kept = [survivors(wide[i], bounds[i], real, norms) for i in range(len(queries))]
            many = [i for i, x in enumerate(kept) if x is not None and len(x) > len(rows) // 4]
            together = dict(zip(many, exact_scores(queries[many], rows), strict=True)) if many else {}
            for i, x in enumerate(kept):
                if x is None or not len(x):
                    continue
                scores = together[i][x] if i in together else exact_scores(queries[i : i + 1], rows[x])[0]
                good = (scores >= bounds[i]) & (ids[x] != query_ids[i])
                x, scores = x[good], scores[good]
                at = best(scores, ids[x], k)
                if len(at):
                    yield np.full(len(at), query_ids[i]), np.full(len(at), row["q_no"] + i), ids[x[at]], scores[at]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding", bucket_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """``query_id, rank, <key>, score``: the k rows of highest inner product for each row that ``is_query`` marks."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[key].cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), vectors[vector].cast("array<double>").alias("v"))
    ints = rows.mapInArrow(_integers(scale), "id long, is_query boolean, dim int, norm double, ints binary")
    ints = runtime.stored(ints.dropDuplicates(["id", "ints"]), "vectors")
    places = max(1, -(-ints.count() // (2 * bucket_rows)))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        waiting: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                waiting.setdefault(x["dim"], []).append(x)
                if len(waiting[x["dim"]]) == bucket_rows:
                    yield bucket(x["dim"], waiting.pop(x["dim"]), place)
        for dim, xs in waiting.items():
            yield bucket(dim, xs, place)

    def bucket(dim: int, xs: list, place: int) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(x["ints"] for x in xs), "<i8").reshape(len(xs), dim)
        norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        ids, m = np.array([x["id"] for x in xs], np.int64)[order], m[order]
        asking = [i for i, j in enumerate(order) if xs[j]["is_query"]]
        bounds = []
        for i, scores in zip(asking, exact_scores(m[asking], m), strict=True) if asking else ():
            own = scores[ids != ids[i]]
            bounds.append(float(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else -np.inf)
        q = _block_row(dim, ids[asking], bounds, m[asking].reshape(len(asking), dim))
        return _block_batch([_block_row(dim, ids, [], m)], [("q_rows", pa.array([q[1]], pa.int32())), ("q_ids", pa.array([q[3]], pa.binary())), ("q_bounds", pa.array([q[4]], pa.binary())), ("q_vectors", pa.array([q[5]], pa.binary())), ("place", pa.array([place], pa.int32()))])

    near = ints.repartitionByRange(places, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id"))
    buckets = runtime.stored(near.mapInArrow(bucketed, BLOCK + ", q_rows int, q_ids binary, q_bounds binary, q_vectors binary, place int"), "buckets")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() + 1) << 32
        waiting: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, bounds, ms = zip(*waiting.pop(dim), strict=True)
            ids, bounds, m = np.concatenate(ids), np.concatenate(bounds), np.concatenate(ms)
            done = _block_batch([_block_row(dim, ids, bounds, m)], [("no", pa.array([number], pa.int64())), ("need", pa.array([least_top(m, bounds)], pa.float64()))])
            number += len(ids)
            return done

        for batch in batches:
            for x in batch.to_pylist():
                m = _matrix(x["q_vectors"], x["dim"], x["q_rows"])
                for at in range(0, len(m), query_rows):
                    cut = slice(at, at + query_rows)
                    waiting.setdefault(x["dim"], []).append((np.frombuffer(x["q_ids"], "<i8")[cut], np.frombuffer(x["q_bounds"], "<f8")[cut], m[cut]))
                    if sum(len(y[0]) for y in waiting[x["dim"]]) >= query_rows:
                        yield out(x["dim"])
        for dim in list(waiting):
            yield out(dim)

    asked = buckets.where("q_rows > 0").select("dim", "q_rows", "q_ids", "q_bounds", "q_vectors")
    asking = runtime.stored(asked.mapInArrow(blocks, BLOCK + ", no long, need double"), "queries")
    # from lengths and bounds alone, in parts: which places each block must reach
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = buckets.groupBy("place", "dim").agg(F.max("top").alias("longest")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    needs = asking.select("dim", "no", "need", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("part"))
    routes = tops.join(needs, ["dim", "part"]).where("longest >= need").select("place", "no")
    sent = asking.select("dim", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("bounds").alias("q_bounds"), F.col("vectors").alias("q_vectors"), F.col("no").alias("q_no"))
    sent = sent.join(routes, F.col("q_no") == F.col("no")).drop("no")
    met = buckets.select("place", "dim", "rows", "ids", "vectors").join(sent, ["place", "dim"]).select("dim", "rows", "ids", "vectors", "q_rows", "q_ids", "q_bounds", "q_vectors", "q_no")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _search(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "query_no", "id", "score"])

    found = met.mapInArrow(search, "query_id long, query_no long, id long, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), F.asc("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
