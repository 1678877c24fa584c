import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import vectors


def embedding(folder, size=4):
    """A model that leaves a file for every text it embeds."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import uuid

        for _ in texts:
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return pd.Series([[float(len(t))] * size for t in texts])

    return embed


def state(store):
    return sorted((r.point_id, r.text, r.vector) for r in store.points().collect())


def test_points_are_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = vectors.Collection(spark, f"file://{tmp_path}/store", 4)
    store.ensure()
    rows = spark.range(10).select(F.concat(F.lit("p"), "id").alias("chunk_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    store.upsert(rows.withColumn("vector", embedding(calls)("text")), "chunk_id")
    assert len(list(calls.iterdir())) == 10
    store.upsert(rows.where("id > 5").withColumn("vector", embedding(calls)("text")), "chunk_id")
    assert len(list(calls.iterdir())) == 14 and store.points().count() == 10


@pytest.mark.parametrize("wrong", ["short", "null", "blank"])
def test_a_bad_batch_changes_nothing(spark, tmp_path, wrong):
    store = vectors.Collection(spark, f"file://{tmp_path}/store", 2)
    store.ensure()
    good = spark.createDataFrame([(str(i), f"t{i}", [1.0, float(i)]) for i in range(20)], "point_id string, text string, vector array<float>")
    store.upsert(good)
    before, files = state(store), sorted(p.name for p in (tmp_path / "store/data").iterdir())
    one = {"short": ("7", "new", [1.0]), "null": ("7", "new", None), "blank": (" ", "new", [1.0, 1.0])}[wrong]
    with pytest.raises(ValueError, match="1 of 21"):
        store.upsert(good.withColumn("text", F.lit("new")).unionByName(spark.createDataFrame([one], good.schema)))
    assert state(store) == before
    assert sorted(p.name for p in (tmp_path / "store/data").iterdir()) == files
    store.upsert(good.where("point_id = '7'").withColumn("text", F.lit("new")))
    assert [t for i, t, _ in state(store) if t == "new"] == ["new"]


def test_a_failing_batch_changes_nothing(spark, tmp_path):
    store = vectors.Collection(spark, f"file://{tmp_path}/store", 1)
    store.ensure()
    good = spark.createDataFrame([("1", "a", [1.0])], "point_id string, text string, vector array<float>")
    store.upsert(good)
    before = state(store)
    with pytest.raises(Exception, match="broken"):
        store.upsert(good.withColumn("text", F.raise_error(F.lit("broken"))))
    assert state(store) == before


def test_of_equal_ids_the_greatest_order_stays(spark, tmp_path):
    store = vectors.Collection(spark, f"file://{tmp_path}/store", 1)
    store.ensure()
    rows = [("1", "a", [1.0], 2), ("1", "b", [1.0], 3), ("2", "c", [1.0], 1), ("1", "d", [1.0], 1)]
    store.upsert(spark.createDataFrame(rows, "point_id string, text string, vector array<float>, ord int"), order="ord")
    assert sorted(t for _, t, _ in state(store)) == ["b", "c"]
