"""Communities: the surveyed fixture, quality against label propagation, connectedness, options and refusals."""

import random

import pytest

from lorespan.operators import communities as C
from lorespan.operators import graph as G


def modularity(found, edges):
    total, degree, inner = 0.0, {}, 0.0
    for a, b, w in edges:
        if a != b:
            total += 2 * w
            for x in (a, b):
                degree[found[x]] = degree.get(found[x], 0) + w
            inner += 2 * w * (found[a] == found[b])
    return inner / total - sum(k * k for k in degree.values()) / total**2


def rows(df):
    return {r.node: r.community for r in df.collect()}


def test_two_pairs_and_a_lone_node(spark):
    edges = spark.createDataFrame([("n1", "n2", 4.0), ("n4", "n3", 3.0), ("n3", "n4", 1.0), ("n1", "n1", 9.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([("n3",), ("n1",), ("n2",), ("n4",), ("n0",)], "node string")
    assert rows(C.leiden_communities(edges, nodes)) == {"n0": 0, "n1": 1, "n2": 1, "n3": 2, "n4": 2}


def test_quality_connectedness_and_repeats(spark):
    rng = random.Random(1)
    ring = [(c * 5 + i, c * 5 + j, 1.0) for c in range(4) for i in range(5) for j in range(i)] + [(c * 5, ((c + 1) % 4) * 5 + 1, 1.0) for c in range(4)]
    blocks = [(100 + i, 100 + j, float(rng.randint(1, 3))) for i in range(30) for j in range(i) if rng.random() < (0.5 if i // 10 == j // 10 else 0.05)]
    path = [(200 + i, 201 + i, 1.0) for i in range(6)]
    edges = ring + blocks + path
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    found = rows(C.leiden_communities(df))
    assert modularity(found, edges) >= modularity(rows(G.label_communities(df)), edges)
    # every community is connected
    near = {}
    for a, b, _ in edges:
        if found[a] == found[b]:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for c in set(found.values()):
        members = {n for n in found if found[n] == c}
        seen, todo = set(), [min(members)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        assert seen == members
    # numbered by their least nodes, and the same for rows in another order and partitioning
    assert [found[n] for n in sorted({min(n for n in found if found[n] == c) for c in set(found.values())})] == list(range(len(set(found.values()))))
    assert all(found[c * 5 + i] == found[c * 5] for c in range(4) for i in range(5))
    again = spark.createDataFrame([(b, a, w) for a, b, w in reversed(edges)], df.schema).repartition(7)
    assert rows(C.leiden_communities(again)) == found


def test_resolution(spark):
    square = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)], "a long, b long, weight double")
    assert set(rows(C.leiden_communities(square, resolution=4.0)).values()) == {0, 1, 2, 3}
    assert set(rows(C.leiden_communities(square, resolution=0.1)).values()) == {0}


def test_refusals_and_nothing(spark):
    schema = "a long, b long, weight double"
    for bad in (0.0, -1.0, None, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            C.leiden_communities(spark.createDataFrame([(1, 2, bad)], schema))
    with pytest.raises(ValueError):
        C.leiden_communities(spark.createDataFrame([(1, 2, 1.0)], schema), spark.createDataFrame([(1,)], "node long"))
    with pytest.raises(ValueError):
        C.leiden_communities(spark.createDataFrame([], schema), resolution=0)
    assert C.leiden_communities(spark.createDataFrame([(None, 1, 1.0)], schema)).count() == 0


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 1000, 3).repartition(5)
    assert [(r.id, r.number) for r in C.numbered(df, "id").orderBy("id").collect()] == [(3 * i, i) for i in range(334)]
    assert C.numbered(df.limit(0), "id").count() == 0
