"""Package seals: any change shows, partitions don't."""

import random

from lorespan.operators import seal


def test_seals(spark):
    rng = random.Random(8)
    blocks = [(d, n, rng.choice(["a", "ab", "", None, "1:a"]), [rng.choice("xy")]) for d in range(12) for n in range(rng.randint(0, 40))] + [(None, 1, "x", ["y"])]
    chunks = [(d, f"c{n}", rng.randint(0, 9)) for d in range(12) for n in range(3)]
    b_schema, c_schema = "doc_id int, place int, text string, path array<string>", "doc_id int, key string, size int"

    def seals(blocks, chunks, parts=3, swap=False):
        b, c = spark.createDataFrame(blocks, b_schema).repartition(parts), spark.createDataFrame(chunks, c_schema).repartition(parts)
        sections = [(b, ["place"]), (c, ["key"])]
        return seal.sealed(sections[::-1] if swap else sections)

    first = seals(blocks, chunks)
    want = {r.doc_id: r.digest for r in first.collect()}
    assert set(want) == set(range(12))
    rng.shuffle(blocks)
    assert {r.doc_id: r.digest for r in seals(blocks, chunks[::-1], 7).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert {r.doc_id: r.digest for r in seals(blocks, chunks, 1).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a changed text, a lost row, a row of another document, two swapped places, a null for an empty text, a repeated row
    own = {d: [b for b in blocks if b[0] == d] for d in range(12)}
    d = max(own, key=lambda x: len(own[x]))
    rest = [b for b in blocks if b[0] != d]
    x, y, *more = sorted(own[d], key=lambda b: b[1])
    empty = next((b for b in own[d] if b[2] == ""), None)
    for changed in ([(*x[:2], "other", x[3]), y, *more], [y, *more], [x, y, *more, (d, 99, "new", ["x"])], [(d, y[1], *x[2:]), (d, x[1], *y[2:]), *more] if x[2:] != y[2:] else [y, *more], [b if b is not empty else (*b[:2], None, b[3]) for b in own[d]] if empty else [y], [x, x, y, *more]):
        got = {r.doc_id: r.digest for r in seals(rest + changed, chunks).collect()}
        assert got[d] != want[d] and {k: v for k, v in got.items() if k != d} == {k: v for k, v in want.items() if k != d}
    assert all(r.digest != want[r.doc_id] for r in seals(blocks, chunks, swap=True).collect())
    stored = spark.createDataFrame([(k, "old" if k == 4 else v) for k, v in want.items() if k != 5] + [(77, "x")], "doc_id int, digest string")
    assert {tuple(r) for r in seal.broken_seals(first, stored).collect()} == {(4, "CHANGED"), (5, "UNSEALED"), (77, "LOST")}
    assert seals([], []).count() == 0
