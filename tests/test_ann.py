"""Cells of nearest neighbours: recall against the exact answer, access inside the probe, and exact search by both ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators import ann
from lorespan.operators import retrieval as R
from lorespan.operators import search as Q


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 16))
    rows = [(i, (middle[i % 20] * 2 + rng.normal(size=16)).tolist()) for i in range(2000)]
    return spark.createDataFrame(rows + [(5000, None), (5001, [0.0] * 16)], "vec_id long, embedding array<double>").repartition(3).cache()


def test_recall_and_access(spark, vectors, tmp_path):
    queries = vectors.filter("vec_id % 20 = 7 AND vec_id < 1000").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "l2"):
        path = str(tmp_path / metric)
        ann.write_cells(vectors, path, 40, metric)
        assert spark.read.parquet(f"{path}/vectors").count() == 2001
        found, exact = ann.probe_cells(spark, path, queries, 10, 8, metric=metric), R.knn(vectors, queries, 10, metric)
        assert ann.recall_of(found, exact).first()[0] >= 0.9
        # with all cells the answer is the exact one
        whole = ann.probe_cells(spark, path, queries, 10, 40, metric=metric)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))
    # a reader of few vectors finds as many as there are, however near the others lie
    allowed = vectors.filter("vec_id % 50 = 3").select("vec_id")
    path = str(tmp_path / "cosine")
    mine = ann.probe_cells(spark, path, queries, 10, 40, allowed)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, R.knn(vectors.join(allowed, "vec_id", "left_semi"), queries, 10).collect())) and mine.count() == 500
    assert ann.probe_cells(spark, path, queries, 10, 4, allowed.limit(0)).count() == ann.probe_cells(spark, path, queries.limit(0), 10, 4).count() == 0
    ann.write_cells(vectors.limit(0), str(tmp_path / "none"), 4)
    assert ann.probe_cells(spark, str(tmp_path / "none"), queries, 10, 4).count() == 0


def test_probes_for_a_recall(spark, vectors, tmp_path, sf):
    path = str(tmp_path / "cells")
    ann.write_cells(vectors, path, 40)
    few, many = (ann.probes_needed(spark, path, vectors, 10, t) for t in (0.5, 0.98))
    assert 1 <= few <= many <= 40
    queries = vectors.filter("vec_id % 7 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    assert ann.recall_of(ann.probe_cells(spark, path, queries, 10, many), R.knn(vectors, queries, 10)).first()[0] >= 0.95
    from lorespan.plans import retrieval

    assert ann.recall_of(retrieval.j3_ann_top10(spark, sf), retrieval.j3_knn_top10(spark, sf)).first()[0] >= 0.9


def test_both_ways_of_the_exact_search(spark, vectors):
    queries = vectors.filter("vec_id < 700").select(F.col("vec_id").alias("query_id"), "embedding")
    small, large = (R.knn(vectors, queries, 5, broadcast_bytes=b) for b in (R.BROADCAST_BYTES, 0))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) and small.count() == 3500


def test_many_slots_keep_apart(spark, vectors):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(30)], "doc_id long, text string")
    slots = spark.createDataFrame([("q", r, s, f"word{10 * r + s}") for r in (1, 2) for s in range(1, 13)], "query_id string, round int, slot int, text string")
    got = {(r.query_id, r.round, r.slot): r.doc_id for r in Q.recall(docs, slots, 1).collect()}
    assert got == {("q", r, s): 10 * r + s for r in (1, 2) for s in range(1, 13) if 10 * r + s < 30}
    points = vectors.filter("vec_id IN (1, 2)").select(F.lit("q").alias("query_id"), F.lit(1).alias("round"), (F.col("vec_id") * 11).cast("int").alias("slot"), "embedding")
    near = Q.recall(docs, slots, 1, vectors, points).filter("branch = 'VECTOR'").collect()
    assert {(r.slot, r.doc_id) for r in near} == {(11, 1), (22, 2)}
