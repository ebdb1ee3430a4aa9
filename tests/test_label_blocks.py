"""Label propagation over blocks of edges: the same labels as by joins, and what it may cost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators import graph as G
from lorespan.operators import label_blocks as B
from lorespan.shared import materialize

EDGES = "a long, b long, weight long"


def shuffled(spark):
    """Rows that this session's stages have shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def trade(n=4000, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(200), -1 - rng.randrange(40), 1 + (rng.random() < 0.1)) for _ in range(n)]


def test_rounds_shuffle_no_edges(spark):
    """an edge is shuffled once for each of its ends, however many rounds there are."""
    edges = spark.createDataFrame(trade(), EDGES)
    before = shuffled(spark)
    assert G.label_communities(edges).count() == 240
    assert shuffled(spark) - before < 4 * 4000


def mixed(seed):
    rng = random.Random(seed)
    far = [0, 2**62, -(2**62), 2**33, -5]
    node = lambda: rng.choice(far) + rng.randrange(25)
    return [(a := node(), rng.choice([a, node(), node(), node()]), rng.choice([0, 1, 1, 2, 300])) for _ in range(350)]


@pytest.mark.parametrize("rows", [trade(300), mixed(1)], ids=["trade", "mixed"])
def test_blocks_equal_joins(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "BLOCK_EDGES", 60)
    linked = materialize(spark.createDataFrame(rows, EDGES).filter("a <> b"), "linked")
    found = [sorted(map(tuple, labels.select("node", "label").collect())) for labels in (B.labels_by_blocks(linked), G._labels_by_rows(linked))]
    assert found[0] == found[1] and len(found[0]) == len({x for a, b, _ in rows for x in (a, b) if a != b})


def test_a_node_of_too_many_edges_goes_by_joins(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i, 1) for i in range(1, 200)] + [(i, i + 1, 1) for i in range(1, 50)], EDGES)
    want = sorted(map(tuple, G.label_communities(rows).collect()))
    monkeypatch.setattr(B, "MOST_EDGES", 150)
    assert B.labels_by_blocks(rows) is None
    assert sorted(map(tuple, G.label_communities(rows).collect())) == want


def test_odd_edges(spark):
    assert G.label_communities(spark.createDataFrame([], EDGES)).collect() == []
    odd = [(1, 1, 5), (None, 2, 1), (3, None, 1), (4, 5, None), (4, 6, 2), (7, 8, None)]
    for kind in ("long", "double"):
        edges = spark.createDataFrame(odd, EDGES).withColumn("weight", F.col("weight").cast(kind))
        assert {r.node: r.community for r in G.label_communities(edges).collect()} == {4: 4, 5: 4, 6: 4, 7: 7, 8: 7}
    with pytest.raises(Exception, match="fit a long"):
        G.label_communities(spark.createDataFrame([(1, 2, 2**62), (1, 3, 2**62)], EDGES))


def test_hash_is_sparks(spark):
    rng = random.Random(4)
    longs = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(200))]
    got = spark.createDataFrame([(x,) for x in longs], "x long").select("x", F.xxhash64("x").alias("h"), F.xxhash64("x", F.lit(0)).alias("h0"), F.xxhash64("x", F.lit(7)).alias("h7")).collect()
    x = np.array([r.x for r in got])
    for turn, name in ((None, "h"), (0, "h0"), (7, "h7")):
        assert B.xxhash64(x, turn).tolist() == [r[name] for r in got]


def test_packed_arrays():
    arrays = [np.array(x, np.int64) for x in ([], [0, -128], [127, 128], [2**31 - 1, -(2**31)], [2**31], [-(2**63), 2**63 - 1])] + [np.array(x, bool) for x in ([], [True] * 8, [False, True, True] * 3)]
    for was, now in zip(arrays, B.unpack(B.pack(*arrays)), strict=True):
        assert now.tolist() == was.tolist()
