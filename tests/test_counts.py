"""Conflicts counted by sets of sources, and percentiles without a task that holds a group."""

import random

import numpy as np

from lorespan.operators import relational as X
from lorespan.operators import resolution as N


def test_conflicts_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_SOURCES", 3)
    rng = random.Random(2)
    rows = [(i, rng.choice("MS"), rng.sample("abcdefghij", rng.choice([1, 1, 2, 2, 3, 4, 6])), "t", "x") for i in range(120)] + [(500, "M", [], "t", "x"), (501, "M", ["z"], "t", "x")]
    got = N.proposal_conflicts(spark.createDataFrame(rows, "proposal int, action string, sources array<string>, target_name string, target_type string"))
    want = {p: n for p, _, s, _, _ in rows if (n := sum(1 for q, _, t, _, _ in rows if q != p and set(s) & set(t)))}
    assert {r.proposal: r.others for r in got.filter("code = 'SOURCE_ENTITY_OVERLAP'").collect()} == want


def test_percentiles(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.uniform(-5, 5), 1.0])) for k in ("a", "a", "b", "c", None) for _ in range(57)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.low, r.half, r.high) for r in X.percentiles_cont(df, "k", "v", {"low": 0.0, "half": 0.5, "high": 0.95}).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, [0.0, 0.5, 0.95]))
    assert X.percentiles_cont(df.limit(0), "k", "v", {"half": 0.5}).count() == 0
