import numpy as np

from quarry.llm.components import components
from quarry.storage import Scratch


def brute(edges):
    low = {n: n for e in edges for n in e}
    for _ in range(len(low) + 1):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components(spark):
    random = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)]  # a path
    edges += [(1000, 1000 + int(i)) for i in range(1, 300)]  # a hub
    edges += [(int(a), int(b)) for a, b in random.integers(2000, 2200, (120, 2))]
    edges += edges[:5] + [(b, a) for a, b in edges[:5]]
    edges = [e for e in edges if e[0] != e[1]]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.component for r in got.collect()} == brute(edges)
    assert got.count() == len(brute(edges))


def test_no_edges(spark):
    none = spark.createDataFrame([(4, 4)], "a long, b long")
    assert components(none, Scratch(spark, "t")).count() == 0
