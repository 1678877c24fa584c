"""An inverted file over vectors: cells around centroids, so that a query opens only cells that can hold a hit.

Vectors are cut into cells by the nearest centroid, by angle; centroids are fitted by Spark's distributed k-means on a bounded sample (``SAMPLE`` rows, those of the least hashes of
their keys), every row is indexed. A cell keeps the least and greatest angle between its members and its centroid. Angles obey the triangle inequality, so no member of a
cell is nearer to a query than the query's angle to the centroid less what the cell's angles allow. A search first opens the most promising cells that hold k points,
which gives a score to beat, and then every cell whose bound reaches that score (``exact``); or just the ``probes`` nearest cells, as many as reached the wanted
recall on a sample of rows at the time of building. Cells are directories, so what isn't opened isn't read.

What the driver holds is a row a cell, of which there are ``MOST_CELLS`` at most. Vectors without a direction, or with another number of components than most of the sample, lie
in a cell of their own and score 0 with every query; so does every point with a query like that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import vectors
from scriptorium.sources import shared

SAMPLE, MOST_CELLS, ROUNDS = 50_000, 4096, 12
#: The cell of vectors without a direction.
APART = -1
#: Queries on which the probes are measured.
TRIALS = 200
MARGIN = 1e-9
#: Entries of a matrix of rows by cells that a worker holds at once.
MOST_ENTRIES = 1 << 18


def _slices(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a matrix of rows by cells has ``MOST_ENTRIES`` at most."""
    step = max(1, MOST_ENTRIES // max(1, cells))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _angles(sizes: np.ndarray, flat: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the unit vectors have the centroids' dimension, and their angles to every centroid."""
    dim = centroids.shape[1]
    fits = sizes == dim
    unit = flat[np.repeat(fits, sizes)].reshape(-1, dim)
    return fits, np.arccos(np.clip(unit @ centroids.T, -1.0, 1.0))


class VectorIndex:
    """The index of points ``key, vector`` at a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()
        self.cells = [r.cell for r in rows]
        self.sizes, self.least, self.most = (np.array([r[c] for r in rows]) for c in ("n", "least", "most"))
        self.near = [i for i, c in enumerate(self.cells) if c != APART]
        self.centroids = np.array([rows[i].centroid for i in self.near]) if self.near else np.empty((0, 1))
        told = spark.read.json(f"{self.path}/settings").first()
        self.probes, self.kind = told.probes, told.kind

    @classmethod
    def build(cls, points: DataFrame, path: str, cells: int | None = None, key: str = "point_id", vector: str = "vector", sample: int = SAMPLE, recall: float = 0.9, k: int = 10, seed: int = 1) -> VectorIndex:
        """Indexes every point; ``cells`` is the square root of their number unless it is given. The probes reach ``recall`` of the k nearest on a sample of points."""
        spark, path = points.sparkSession, path.rstrip("/")
        points = points.select(key, F.col(vector).cast("array<double>").alias("vector"))
        n = points.count()
        cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        drawn = shared.stored(points.where("vector is not null").orderBy(F.xxhash64(key), key).limit(sample), "sample")
        sizes = drawn.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = sizes.dim if sizes else 0
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        fit = drawn.where((F.size("vector") == dim) & good)
        centroids = np.empty((0, max(dim, 1)))
        if dim and not fit.isEmpty():
            # by rows, the distances of all pairs of centroids would come to the driver in every round
            model = KMeans(k=cells, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine", solver="block").fit(fit.select(array_to_vector("vector").alias("features")))
            found = np.array(model.clusterCenters())
            centroids = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, len(centroids)):
                fits, angles = _angles(*vectors.unit_rows(batch.column(1)), centroids)
                cell, angle = np.full(len(batch), APART, np.int32), np.zeros(len(batch))
                if len(centroids) and fits.any():
                    cell[fits] = angles.argmin(axis=1)
                    angle[fits] = angles.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

        kind = dict(points.dtypes)[key]
        rows = points.mapInArrow(placed, f"`{key}` {kind}, vector array<double>, cell int, angle double")
        # ranges, not hashes: a large cell becomes several files, a small one few
        rows.repartitionByRange("cell", "angle").write.partitionBy("cell").parquet(f"{path}/points")
        laid = spark.read.schema(f"`{key}` {kind}, vector array<double>, angle double, cell int").parquet(f"{path}/points")
        told = laid.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        middle = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)] + [(APART, None)], "cell int, centroid array<double>")
        told.join(middle, "cell").coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(1, kind)], "probes int, kind string").coalesce(1).write.json(f"{path}/settings")
        index = cls(spark, path, key)
        index._measure(drawn, recall, k)
        shared.forget(drawn)
        return index

    def _measure(self, drawn: DataFrame, recall: float, k: int) -> None:
        """Finds how many nearest cells hold ``recall`` of the k nearest points of sampled queries, and keeps the number."""
        asked = drawn.orderBy(F.xxhash64(F.lit(7), self.key), self.key).limit(TRIALS).select(F.col(self.key).alias("query_id"), F.col("vector").alias("query_vector"))
        true = self.search(asked, k).select("query_id", F.col(self.key)).join(self.points().select(self.key, "cell"), self.key)
        order = self._routed(asked).select("q", F.explode("order").alias("x")).select("q", F.col("x.cell").alias("cell"), F.col("x.nth").alias("nth"))
        ranks = true.join(order, (F.col("query_id") == F.col("q")) & (true["cell"] == order["cell"])).groupBy("nth").count().orderBy("nth").collect()  # a row a cell at most
        whole, seen, self.probes = sum(r["count"] for r in ranks), 0, len(self.cells)
        for r in ranks:
            seen += r["count"]
            if seen >= recall * whole:
                self.probes = r.nth + 1
                break
        self.spark.createDataFrame([(self.probes, self.kind)], "probes int, kind string").coalesce(1).write.mode("overwrite").json(f"{self.path}/settings")

    def points(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed points, of the given cells only: other directories aren't read."""
        rows = self.spark.read.schema(f"`{self.key}` {self.kind}, vector array<double>, angle double, cell int").parquet(f"{self.path}/points")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def _routed(self, asked: DataFrame) -> DataFrame:
        """``q, v, order``: for each query the cells ``cell, nth, bound, before``, most promising first, ``before`` being how many points the cells before hold."""
        centroids, near, least, most, sizes, cells = self.centroids, self.near, self.least, self.most, self.sizes, np.array(self.cells, int)
        kind = pa.struct([("cell", pa.int32()), ("nth", pa.int32()), ("bound", pa.float64()), ("before", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, len(cells)):
                bound = np.zeros((len(batch), len(cells)))
                sort = np.zeros((len(batch), len(cells)))
                fits, angles = _angles(*vectors.unit_rows(batch.column(1)), centroids) if len(near) else (np.zeros(len(batch), bool), np.empty((0, 0)))
                if fits.any():
                    gap = np.maximum(0.0, np.maximum(angles - most[near], least[near] - angles))
                    bound[np.ix_(fits, near)] = np.cos(gap)
                    sort[np.ix_(fits, near)] = np.cos(angles)
                order = np.lexsort((-sort, -bound), axis=1) if len(cells) else np.empty((len(batch), 0), int)
                flat = order.ravel()
                before = np.cumsum(sizes[order], axis=1) - sizes[order] if len(cells) else order
                fields = [pa.array(cells[flat], pa.int32()), pa.array(np.tile(np.arange(len(cells)), len(batch)), pa.int32()), pa.array(np.take_along_axis(bound, order, axis=1).ravel(), pa.float64()), pa.array(before.ravel(), pa.int64())]
                starts = pa.array(np.arange(len(batch) + 1) * len(cells), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(fields, fields=list(kind)))], ["q", "v", "order"])

        q = dict(asked.dtypes)["query_id"]
        rows = asked.select(F.col("query_id").alias("q"), F.col("query_vector").cast("array<double>").alias("v"))
        return rows.mapInArrow(run, f"q {q}, v array<double>, order array<struct<cell:int,nth:int,bound:double,before:bigint>>")

    def _scored(self, routes: DataFrame, k: int, threshold: float | None, places: int | None, block: int = 256) -> DataFrame:
        """``q, p, score, compared`` of routes ``q, v, cell``: each opened cell's blocks of points against the blocks of its queries."""
        opened = [r.cell for r in routes.select("cell").distinct().collect()]  # cells, not queries
        asked = vectors.packed(routes, "q", "v", block, ["cell"]).select("cell", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        held = vectors.packed(self.points(opened), self.key, "vector", 4 * block, ["cell"])
        # routes are small as stored and large as blocks, a query's vector for each cell: they don't travel through the driver
        return vectors.nearest(held.join(asked.hint("merge"), "cell"), k, threshold, places)

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, exact: bool = True, probes: int | None = None, places: int | None = None) -> DataFrame:
        """``query_id, <key>, score, rank``: the k nearest points of each of ``query_id, query_vector``, ties by key.

        ``exact`` gives what a search of all points gives; otherwise only the ``probes`` nearest cells of each query are opened.
        """
        routed = shared.stored(self._routed(queries), "routes")
        each = routed.select("q", "v", F.explode("order").alias("x")).select("q", "v", "x.*")
        if not exact:
            found = self._scored(each.where(F.col("nth") < (probes or self.probes)), k, threshold, places)
        else:
            first = shared.stored(self._scored(each.where(F.col("before") < k), k, threshold, places), "near")
            reached = vectors.best_of(first, k).where(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("compared").alias("_least"))
            rest = each.where(F.col("before") >= k).join(reached, F.col("q") == F.col("_q"), "left")
            margin = MARGIN if places is None else 10.0**-places
            least = F.greatest(F.coalesce("_least", F.lit(-2.0)), F.lit(-2.0 if threshold is None else threshold)) - margin
            found = first.unionByName(self._scored(rest.where(F.col("bound") >= least).select("q", "v", "cell"), k, threshold, places))
        return vectors.best_of(found, k).select(F.col("q").alias("query_id"), F.col("p").alias(self.key), "score", "rank")
