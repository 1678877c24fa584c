import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import vectors
from scriptorium.operators.vector_index import APART, VectorIndex
from scriptorium.plans import catalogue


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Points around 24 centres, and odd ones; an index with 16 cells."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(24, 16))
    data = [(i, (centres[i % 24] + 0.15 * draw.normal(size=16)).tolist()) for i in range(1500)]
    data += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, 2.0]), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, []), (2006, data[3][1]), (2007, [float("inf")] * 16)]
    points = spark.createDataFrame(data, "point_id long, vector array<double>").repartition(3).cache()
    return points, VectorIndex.build(points, f"file://{tmp_path_factory.mktemp('index')}/v", cells=16)


def asked(points, every=30):
    rows = points.where(F.col("point_id") % every == 0)
    return rows.select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"))


def ranked(found):
    return sorted((r.query_id, r["rank"], r.point_id, round(r.score, 9)) for r in found.collect())


@pytest.mark.parametrize(("k", "threshold"), [(5, None), (40, None), (10, 0.97), (3000, 0.2)])
def test_exact_search_equals_the_whole(spark, clustered, k, threshold):
    points, index = clustered
    odd = spark.createDataFrame([(9001, None), (9002, [1.0, 2.0]), (9003, [0.0] * 16)], "query_id long, query_vector array<double>")
    queries = asked(points, 75).unionByName(odd)
    want = ranked(vectors.batch_top_k(points, queries, k, threshold, places=9))
    assert ranked(index.search(queries, k, threshold, places=9)) == want and want


def test_every_point_has_a_cell(clustered):
    points, index = clustered
    cells = {r.cell: r["count"] for r in index.points().groupBy("cell").count().collect()}
    assert sum(cells.values()) == points.count() and cells[APART] == 7
    assert index.points().select("point_id").distinct().count() == points.count()


def test_only_cells_that_can_hold_a_hit_are_opened(clustered):
    points, index = clustered
    routes = index._routed(asked(points, 1500)).select("q", F.explode("order").alias("x")).select("q", "x.*")
    assert routes.count() == len(index.cells)
    opened = routes.where("bound >= 0.9").count()
    assert 0 < opened < len(index.cells) / 2
    plan = index.points([0, 1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert index.points([0, 1]).select(F.input_file_name().alias("f")).where("f not like '%cell=0/%' and f not like '%cell=1/%'").count() == 0


def test_probing_recalls_most(clustered):
    points, index = clustered
    queries = asked(points, 10)
    want = {(r[0], r[2]) for r in ranked(index.search(queries, 10))}
    got = {(r[0], r[2]) for r in ranked(index.search(queries, 10, exact=False))}
    assert index.probes < len(index.cells) and len(want & got) / len(want) >= 0.9


def test_opened_again_and_empty(spark, clustered, tmp_path):
    points, index = clustered
    again = VectorIndex(spark, index.path)
    assert again.probes == index.probes and ranked(again.search(asked(points, 500), 3)) == ranked(index.search(asked(points, 500), 3))
    empty = VectorIndex.build(points.where("false"), f"file://{tmp_path}/none")
    assert empty.search(asked(points, 500), 3).count() == 0 and empty.search(asked(points, 500), 3, exact=False).count() == 0
    assert index.search(asked(points).where("false"), 3).count() == 0


def test_recall_of_the_query(spark):
    found = catalogue.vector_index_recall(spark, "/root/testdata/sf0.01").agg(F.avg("recall").alias("r")).first()
    assert found.r >= 0.9


def test_workers_hold_few_rows_by_cells(monkeypatch):
    import pyarrow as pa

    from scriptorium.operators import vector_index

    monkeypatch.setattr(vector_index, "MOST_ENTRIES", 1000)
    got = list(vector_index._slices(iter([pa.RecordBatch.from_arrays([pa.array(range(25))], ["x"])]), 100))
    assert [len(b) for b in got] == [10, 10, 5] and [x for b in got for x in b.column(0).to_pylist()] == list(range(25))
    assert [len(b) for b in vector_index._slices(iter(got[:1]), 5000)] == [1] * 10


def test_blocks_and_distances_of_centroids_stay_off_the_driver(spark, tmp_path):
    draw = np.random.default_rng(2)
    points = spark.createDataFrame([(i, draw.normal(size=64).tolist()) for i in range(600)], "point_id long, vector array<double>")
    spark.sparkContext.setJobGroup("build", "")
    index = VectorIndex.build(points, f"file://{tmp_path}/v", cells=130)
    spark.sparkContext.setJobGroup("other", "")
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("build") for s in told.getJobInfo(j).stageIds]
    names = [s.name for s in stages if s]
    assert any("KMeans" in n for n in names) and not any("DistanceMeasure" in n for n in names)
    routes = index._routed(asked(points)).select("q", "v", F.explode("order.cell").alias("cell"))
    for joined in (index._scored(routes, 3, None, None), vectors.batch_top_k(points, asked(points), 3)):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        blocks = next(x for x in plan.splitlines() if "Join" in x and "matrix" not in x and ("[cell" in x or "[slice" in x))
        assert "SortMergeJoin" in blocks
