import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import topk


def brute(rows, k, scale=1024.0):
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[(i, tuple(math.floor(float(x) * scale) for x in v))] = None
    out = set()
    for q, a in kept:
        if q % 3 == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(b) == len(a)))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "ties", "odd"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 8))
    if kind == "unit":
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    if kind == "lengths":
        m *= np.exp(rng.normal(size=(150, 1)) * 2)
    if kind == "ties":
        m[40:120] = m[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    if kind == "odd":
        rows += [(200, None), (None, [1.0] * 8), (201, [None] * 8), (202, [math.inf] * 8), (204, [1.0, 2.0]), (207, [3.0, -1.0]), (210, []), (213, []), (3, rows[3][1]), (216, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5, bucket_rows=32, query_rows=7).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_survivors_never_lose_a_reaching_row():
    rng = np.random.default_rng(1)
    for _ in range(200):
        rows = rng.integers(-50, 50, size=(60, 4)).astype(float)
        rows = rows[np.argsort(-np.linalg.norm(rows, axis=1))]
        q = rng.integers(-50, 50, size=4).astype(float)
        scores = rows @ q
        bound = np.sort(scores)[-rng.integers(1, 5)]
        kept = topk.survivors(q, bound, rows, np.linalg.norm(rows, axis=1))
        assert set(np.flatnonzero(scores >= bound)) <= set([] if kept is None else kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 3 == 0).count() == 0


def test_large_numbers_are_exact():
    a = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, -7]])
    assert topk.exact_scores(*a)[0, 0] == (2**40 + 1) * (2**20 + 1) - 21
    with pytest.raises(OverflowError):
        topk.exact_scores(np.array([[2**40]]), np.array([[2**40]]))


def test_blocks_are_not_sent_where_nothing_can_count(spark):
    """Long vectors of one direction: the short ones' places are out of reach, and results stay exact."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in (rng.normal(size=6) * 0.01 + np.eye(6)[0]) * (100 if i % 3 == 0 else 1)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5, bucket_rows=8, query_rows=7).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 5)
    q = np.array([[3, 4], [6, 8]])
    assert topk.least_top(q, np.array([50.0, 20.0])) == pytest.approx(2.0) and topk.least_top(q, np.array([50.0, -np.inf])) == -np.inf


def test_scores_out_of_range_raise(spark):
    df = spark.createDataFrame([(0, [1e14, 1e14]), (1, [1e14, 1e14])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(df, F.col("vec_id") % 3 == 0, k=1).collect()
