import random

import pytest

from scriptorium.llm import components


def plain(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(parent) if find(x) != x}


RNG = random.Random(4)
CASES = [[], [(1, 1), (None, 2), (3, None)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(99, i) for i in range(40, 60)], [(RNG.randrange(120), RNG.randrange(120)) for _ in range(90)] * 2]


@pytest.mark.parametrize("links", CASES)
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in components.components(df).collect()} == plain(links)
