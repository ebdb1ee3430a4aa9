"""Vector codes against a plain version, with broken rows, ties, repeats and few rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lorespan.llm import vector_codes


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label)."""
    whole = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    if not whole:
        return []
    width = len(whole[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for row in cut:
                groups[nearest(p, row[p])[0]].append(row[p])
            new.append([[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, books[p], strict=True)])
        books = new
    coded = [[nearest(p, row[p]) for p in range(parts)] for row in cut]
    errors = [sum(d for _, d in c) for c in coded]
    of = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        of[label] = of.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k, _ in c), e, of[r[2]], sha) for r, c, e in zip(whole, coded, errors, strict=True)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("entries,rounds,n", [(4, 2, 60), (64, 2, 20), (3, 0, 10), (8, 3, 200)])
def test_equals_the_plain_version(spark, entries, rounds, n):
    rng = random.Random(n)
    data = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-2, 2)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(n)]
    data += [(3, data[3][1], 2), (None, data[1][1], None), (None, data[2][1], 1), (900, None, 1), (901, [], 1), (902, [1.0] * 4, 1), (903, [None] * 8, 1)]
    data += [(904, [0.0] * 7 + [x], 3) for x in (math.nan, math.inf, -math.inf, None)] + [(-1, [math.nan] * 8, 1), (905, [9.0] * 7, 2)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in data], "vec_id long, embedding array<float>, label int, code string, error long").repartition(5)
    as_floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in data]
    got = [tuple(r) for r in vector_codes.compress_vectors(frame, 4, entries, rounds).collect()]
    assert in_order(got) == in_order(plain(as_floats, 4, entries, rounds))


def test_nothing_kept(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    broken = spark.createDataFrame([(1, None, 1), (2, [1.0] * 3, 1)], empty.schema)
    for frame in (empty, broken):
        assert vector_codes.compress_vectors(frame).count() == 0


def test_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e12] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="may not fit a long"):
        vector_codes.compress_vectors(frame).collect()


def test_equals_the_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, vector_codes.op13_vector_codes(spark, sf).collect())) == sorted(con.sql(vector_codes.OP13_SQL).fetchall())
