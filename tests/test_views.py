"""Views with caps, histories with summaries, catalogues, references: against plain versions and fixtures."""

import random

from lorespan.operators import context as C
from lorespan.operators import graph_views as V
from lorespan.operators import parsing as P
from lorespan.sources import tables


def plain_view(edges, root, hops, nodes, most):
    depths, taken, cut = {root: 0}, {}, False
    for depth in range(1, hops + 1):
        if depth > 1 and (len(depths) >= nodes or len(taken) >= most):
            break
        frontier = {n for n, d in depths.items() if d == depth - 1}
        candidates = sorted((e for e in edges if e[1] in frontier or e[2] in frontier), key=lambda e: (-e[3], e[0]))[: most + 1]
        cut |= len(candidates) > most
        for name, a, b, _ in candidates:
            if name in taken:
                continue
            end = b if a in depths else a
            if end not in depths and len(depths) >= nodes:
                cut = True
                continue
            if len(taken) >= most:
                cut = True
                break
            depths.setdefault(end, depth)
            taken[name] = (a, b, depth)
    return {(root, name, *x, cut) for name, x in taken.items()}


def test_subgraphs_with_caps(spark):
    rng = random.Random(4)
    pairs = sorted({(min(p), max(p)) for p in ((rng.randint(1, 25), rng.randint(1, 25)) for _ in range(90)) if p[0] != p[1]})
    edges = [(f"e{i:02d}", *(p if rng.random() < 0.5 else p[::-1]), rng.randint(1, 4)) for i, p in enumerate(pairs)] + [("big", 10**17, 10**17 + 1, 1)]
    df = spark.createDataFrame(edges, "relation string, a long, b long, pieces int")
    roots = spark.createDataFrame([(r,) for r in [1, 2, 3, 7, 99, 10**17]], "root long")
    for hops, nodes, most in ((2, 20, 40), (2, 6, 40), (2, 20, 5), (1, 3, 3), (3, 9, 12)):
        got = {(r.root, r.relation, r.a, r.b, r.depth, r.truncated) for r in V.subgraph_views(df, roots, hops, nodes, most).collect()}
        assert got == set().union(*(plain_view(edges, r, hops, nodes, most) for r in (1, 2, 3, 7, 99, 10**17)))


def plain_history(said, summary, limit, budget):
    said = sorted(said)
    late = summary is not None and sum(t > summary[0] for t, _, _ in said) > 4
    used = None if late else summary
    raw = [m for m in said if used is None or m[0] > used[0]][-(min(12, limit) if used is None else 4) :]
    budget, own = max(64, budget), used[1] if used else 0
    while raw and own + sum(m[2] for m in raw) > budget:
        raw.pop(0)
    if raw and raw[0][1] == "assistant":
        raw.pop(0)
    tokens = sum(m[2] for m in raw)
    if used and own + tokens > budget:
        used, own = None, 0
    state = "PENDING" if late else "USED" if used else "PENDING" if len(said) > 12 or sum(m[2] for m in said) > budget else "NOT_NEEDED"
    return (state, raw[0][0] if raw else None, len(raw), tokens + own, used[0] if used else None)


def test_histories_with_summaries(spark):
    rng, want, messages, summaries = random.Random(9), {}, [], []
    for conv in range(120):
        said = [(t, rng.choice(["user", "assistant"]), rng.randint(1, 60)) for t in range(rng.randint(1, 18))]
        summary = (rng.randint(0, 18), rng.choice([5, 60, 90, 200])) if rng.random() < 0.6 else None
        messages += [(conv, *m) for m in said]
        summaries += [(conv, *summary)] if summary else []
        want[conv] = plain_history(said, summary, 10, 100)
    m, s = spark.createDataFrame(messages, "conv_id int, turn int, role string, tokens int"), spark.createDataFrame(summaries, "conv_id int, covered int, tokens int")
    assert {r.conv_id: tuple(r)[1:] for r in C.history_context(m, s, 10, 100).collect()} == want
    assert {w[0] for w in want.values()} == {"USED", "PENDING", "NOT_NEEDED"}
    assert {r.state for r in C.history_context(m, s, 10, 100, compress=False).collect()} == {"NOT_NEEDED"}


def test_catalogues(spark):
    schema = "dataset string, version string, caseKey string, sha256 string, input string, expected string"
    known = spark.createDataFrame([("d", "1", "a", "h1", "q", "x"), ("d", "2", "a", "h2", "q", "y"), ("e", "1", "b", "h3", "q", "z")], schema)
    read = spark.createDataFrame([("d", "1", "a", "h1", "q", "x"), ("d", "2", "a", "other", "q", "changed"), ("d", "3", "a", "h4", "q", "new"), ("d", "3", "a", "h4", "q", "newer")], schema)
    got = {(r.dataset, r.version, r.expected, r.change) for r in tables.upsert_catalogue(known, read).collect()}
    assert got == {("d", "1", "x", "SAME"), ("d", "2", "y", "CONFLICT"), ("d", "3", "new", "ADDED"), ("e", "1", "z", "KEPT")}
    assert {r.change for r in tables.upsert_catalogue(known.limit(0), read).collect()} == {"ADDED"}


def test_external_references(spark):
    html = '<head><link href="https://a"></head><p>x <a href=" HTTP://b">b</a><a href="/local"><img src="//c"><img src="d.png"></p><script src="http:x"></script>'
    got = {r.id: (r.external, r.blocks) for r in P.external_references(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).collect()}
    assert got == {1: (4, 1), 2: (0, 0), 3: (0, 0)}


def test_claims_are_dropped_one_by_one(spark):
    reports = spark.createDataFrame([(1, "t", "s"), (2, " ", "s"), (3, "t", None), (4, "t", "s")], "report_id int, title string, summary string")
    claims = spark.createDataFrame([(1, 1, " first "), (1, 2, "bad"), (1, 3, " "), (1, 4, "no proof"), (1, 5, "last"), (2, 1, "x"), (3, 1, "x"), *[(4, i, "x") for i in range(9)]], "report_id int, claim int, text string")
    evidence = spark.createDataFrame([(1, 1, 10), (1, 1, 10), (1, 2, 10), (1, 2, 99), (1, 3, 10), (1, 5, 10), (1, 5, 11), (2, 1, 10), (3, 1, 10), *[(4, i, 10) for i in range(9)]], "report_id int, claim int, evidence_id int")
    allowed = spark.createDataFrame([(r, e) for r in range(1, 5) for e in (10, 11)], "report_id int, evidence_id int")
    assert sorted(map(tuple, V.valid_claims(reports, claims, evidence, allowed).collect())) == [(1, 0, 1, "first", 1), (1, 1, 5, "last", 2)]
