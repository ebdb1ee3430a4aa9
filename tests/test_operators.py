"""Operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import context as C
from lorespan.operators import graph as G
from lorespan.operators import lifecycle as L
from lorespan.operators import names as N
from lorespan.operators import parsing as P
from lorespan.operators import relational as X
from lorespan.operators import retrieval as R
from lorespan.operators import similarity as S
from lorespan.sources import tables
from lorespan.streaming import sync


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "a b c\n", T.count_tokens) == 4 and one(spark, "a b", T.prompt_tokens) == 3
    assert one(spark, "a😀", T.utf16_length) == 3
    assert one(spark, "检索系统 of the index v2", T.query_terms) == ["检索", "索系", "系统", "index"]
    assert one(spark, "The President Richard Nixon.", T.answer_text) == "president richard nixon"
    assert one(spark, "HTTP://Ex.ORG/a?utm_x=1&b=2#c", T.canonical_url) == "http://ex.org/a?b=2"
    assert one(spark, "mail a@b.co password: hunter2", T.redact_feedback) == "mail [EMAIL] password=[REDACTED]"
    assert one(spark, " net-work! type ", T.type_name) == "NET_WORK__TYPE" and one(spark, "--", T.type_name) is None
    assert [one(spark, x, T.heading_depth) for x in ("1.2.3 Scope", "第一章 总则", "OVERVIEW", "plain text")] == [3, 1, 1, None]
    assert one(spark, "x\x00y", T.text_quality) == "NUL" and one(spark, "short", T.text_quality) == "LOW_QUALITY"
    assert one(spark, "Authorization: Bearer abcdefghijklmnop12", T.has_credential) and not one(spark, "a bearer of news", T.has_credential)
    assert one(spark, "é\r\nx", T.nfc) == "é\nx" and one(spark, "Ｆ  b ", T.nfkc) == "F b"


def test_similarity(spark):
    pairs = spark.createDataFrame([(1, "Richard Nixon was the president.", "President Richard Nixon"), (2, "no", "yes"), (3, "", "the")], "id int, a string, b string")
    assert {r.id: r.f1 for r in S.token_f1(pairs).collect()} == {1: round(6 / 7, 6), 2: 0.0, 3: 1.0}
    names = spark.createDataFrame([("Microsoft",), ("Micorsoft",), ("Intel",)], "name string")
    assert [(r.a, r.b) for r in S.name_pairs(names, 0.7).collect()] == [("Micorsoft", "Microsoft")]
    assert one(spark, "North Atlantic Treaty Organization", N.acronym) == "nato"


def test_ranking_and_fusion(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    late = spark.createDataFrame([(1, 12, 1)], "query_id int, doc_id int, rank int")
    got = {r.doc_id: r.score for r in R.fuse([(ranked, 1.0), (late, 0.25), (late, 0.25)]).collect()}
    assert got[12] < got[10] and abs(got[12] - 0.5 / 61) < 1e-8
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)] + [(50, [0.0, 0.0]), (51, None)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id in (3, 50)").select(F.col("vec_id").alias("query_id"), "embedding")
    for metric in ("cosine", "dot", "l2"):
        rows = R.knn(v, q, 3, metric).filter("query_id = 3").collect()
        assert sorted(r.rank for r in rows) == [1, 2, 3]
        assert {r.vec_id for r in rows if r.rank == 1} == ({29} if metric == "dot" else {3})
    with pytest.raises(ValueError):
        R.knn(v, q, 3, "other")


def test_access(spark):
    docs = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "b", False), (4, "u", False)], "doc_id int, source string, open boolean")
    grants = spark.createDataFrame([(3, "u"), (3, "u"), (2, "w")], "doc_id int, user_id string")
    assert sorted(r.doc_id for r in R.visible(docs, "u", F.col("open"), grants=grants).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in R.visible(docs, "u", F.col("open")).collect()) == [1, 4]


def test_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    parent = list(range(61))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    two = spark.createDataFrame([(1, 2, 4), (3, 4, 4), (2, 1, 1)], "a int, b int, weight int")
    found = {r.node: r.community for r in G.label_communities(two).collect()}
    assert set(found) == {1, 2, 3, 4} and len({found[1], found[3]}) == 2
    walk = G.bounded_walk(X.either_endpoint(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "a int, b int, weight int"), "a", "b"), spark.createDataFrame([(1,)], "node int"), 3, 5)
    assert sorted(tuple(r.path) for r in walk.collect()) == [(1,), (1, 2), (1, 2, 3), (1, 3), (1, 3, 2)]


def test_parent_plan(spark):
    rows = [(1, r, r, 100, r, 1200, (r - 1) // 3) for r in range(1, 7)]
    got = C.plan_parents(spark.createDataFrame(rows, "query_id long, rank int, child_id long, child_tokens int, parent_id long, parent_tokens int, doc_id long")).collect()
    assert sum(r.included for r in got) == 4 and sum(r.tokens for r in got) == 3200
    assert {r.reason for r in got if not r.included} <= {"PER_DOCUMENT_PARENT_LIMIT", "PARENT_LIMIT"} and next(r for r in got if r.child_id == 3).reason == "PER_DOCUMENT_PARENT_LIMIT"


def test_reserved_branches(spark):
    rows = [(1, r, 100 + r, r % 3, 31 - r if r > 25 else None, r, None) for r in range(1, 31)]
    got = C.reserve_branches(spark.createDataFrame(rows, "query_id long, rank int, doc_id long, slot int, graph_rank int, bm25_rank int, vector_rank int"), 12).collect()
    assert len(got) == 12 and {130, 129}.issubset({r.doc_id for r in got}) and {101, 102, 103, 104, 105, 106} <= {r.doc_id for r in got}


def test_parsing():
    text = "# Head\n\npara one\npara two\n\n- a\n- b\n\n| x | y |\n| - | - |\n```py\n# no head\n```\nend"
    assert [(k, d) for k, d, _ in P.markdown_blocks(text)] == [("HEADING", 1), ("PARAGRAPH", 0), ("LIST", 0), ("TABLE", 0), ("CODE", 0), ("PARAGRAPH", 0)]
    html = "<html><head><title>t</title></head><body><script>x</script><h1>A &amp; b</h1><div><p>one <b>two</b></p><p>three<br>four</p></div><form><p>no</p></form></body></html>"
    assert P.html_blocks(html) == [("h1", "/html[1]/body[1]/h1[1]", "A & b"), ("p", "/html[1]/body[1]/div[1]/p[1]", "one two"), ("p", "/html[1]/body[1]/div[1]/p[2]", "threefour")]
    assert P.table_grid([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 1, 1)]]) == [["a", "b", ""], ["", "c", "d"]]
    assert [a for a, _ in P.child_windows("x" * 700)] == [0, 260, 520] and list(P.child_windows("  \n")) == []


def test_lifecycle(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changed = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, L.upsert(current, changed, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    stale = L.stale_projection(spark.createDataFrame([(1, 1), (2, 5), (4, 1)], "k int, v int"), spark.createDataFrame([(1, 1), (2, 4), (3, 9)], "k int, v int"), "k", "v")
    assert sorted(map(tuple, stale.collect())) == [(2, "UPSERT"), (3, "DELETE"), (4, "UPSERT")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;two\n3;four\n")
    assert [r.y for r in tables.read_csv(spark, str(tmp_path / "a.csv"), ";").collect()] == ["two", "four"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "d.pdf").write_bytes(b"%PDF-1.7")
    assert tables.read_files(spark, str(tmp_path / "f")).first()["format"] == "PDF"
    index, pointer = str(tmp_path / "index"), str(tmp_path / "pointer")
    for g, v in ((1, "old"), (2, "new")):
        tables.write_generation(spark.createDataFrame([(7, v)], "id int, v string"), index, g)
        tables.publish(spark, pointer, g)
    assert [r.v for r in tables.published(spark, index, pointer).collect()] == ["new"]
    tables.publish(spark, pointer, 1)
    assert [r.v for r in tables.published(spark, index, pointer).collect()] == ["old"]
    assert tables.fingerprint("a", "b") != tables.fingerprint("ab", "")


def test_index_sync(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "k int, v int, deleted boolean"
    for rows in ([(1, 1, False), (1, 3, False), (2, 1, False)], [(1, 2, False), (2, 2, True), (3, 1, False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = spark.readStream.schema(schema).parquet(source)
        sync.sync_index(changes, index, "k", "v").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = [(1, 3, False), (2, 2, True), (3, 1, False)]
    assert sorted(map(tuple, sync.read_index(spark, index, schema).collect())) == want
    number, places = tables.newest_pointer(spark, f"{index}/pointers")
    # a batch that dies while it writes leaves a folder without a success mark: the last whole pointer stays in force
    (tmp_path / "index" / "pointers" / f"number={number + 1}").mkdir()
    assert tables.newest_pointer(spark, f"{index}/pointers") == (number, places)
    assert sorted(map(tuple, sync.read_index(spark, index, schema).collect())) == want
    assert sync.read_index(spark, str(tmp_path / "none"), schema).count() == 0


def test_shared_folder(spark):
    from lorespan import shared

    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = shared.materialize(spark.range(3), "three")
    assert kept.count() == 3
    shared.discard(kept)
    import os

    assert not os.path.exists(kept._written_at.removeprefix("file:"))


def test_label_communities_end_where_no_node_gains(spark):
    pair = spark.createDataFrame([(1, -1, 1)], "a long, b long, weight long")
    assert {r.node: r.community for r in G.label_communities(pair).collect()} == {1: -1, -1: -1}
    rows = [(i, -1 - (i * i + k) % 9, 1 + (i * k) % 3) for i in range(1, 25) for k in range(3)]
    found = {r.node: r.community for r in G.label_communities(spark.createDataFrame(rows, "a long, b long, weight long")).collect()}
    assert found.keys() == {x for a, b, _ in rows for x in (a, b)}
    for node in found:
        votes = {}
        for a, b, w in rows:
            if node in (a, b):
                other = found[b if node == a else a]
                votes[other] = votes.get(other, 0) + w
        assert votes.get(found[node], 0) == max(votes.values()), node


def test_search_of_several_slots(spark):
    from lorespan.operators import search as Q

    hits = spark.createDataFrame([(1, 1, 1, "BM25", 10, 7.5, 1), (1, 1, 1, "BM25", 11, 5.0, 2), (1, 1, 1, "VECTOR", 11, 0.9, 1), (1, 2, 2, "BM25", 12, 3.0, 1), (1, 2, 2, "BM25", 11, 2.0, 2)], "query_id long, round int, slot int, branch string, doc_id long, score double, rank int")
    got = {r.doc_id: (r.score, r["rank"]) for r in Q.rank_candidates(hits).collect()}
    assert got == {10: (7.5, 1), 12: (3.0, 2), 11: (round(1 / 62 + 1 / 61 + 0.25 / 62, 9), 3)}
    got = {r.doc_id: r.score for r in Q.rank_candidates(hits, mode="rrf").collect()}
    assert got[10] == round(1 / 61, 9) and got[12] == round(0.25 / 61, 9)
    graph = spark.createDataFrame([(1, 12, 1), (1, 99, 2)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: r.score for r in Q.rank_candidates(hits, graph=graph, graph_weight=2.0).collect()}
    assert got[12] == round(0.25 / 61 + 2 / 61, 9) and got[99] == round(2 / 62, 9) and got[10] == round(1 / 61, 9)
    slots = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "b"), (2, 1, 1, "c")], "query_id long, round int, slot int, text string")
    assert {(r.query_id, r.slot): r.status for r in Q.slot_status(slots, hits).collect()} == {(1, 1): "SUCCESS", (1, 2): "DEGRADED", (2, 1): "FAILED"}
    plan = spark.createDataFrame([(1, 1, " a "), (1, 2, "b"), (1, 3, "a"), (1, 4, ""), (1, 5, "x" * 501), (1, 6, "c")], "query_id long, position int, text string")
    assert sorted((r.position, r.text) for r in Q.normalize_queries(plan, 2).collect()) == [(1, "a"), (2, "b")]


def test_second_hop_and_pairs(spark):
    from lorespan.operators import search as Q

    queries = spark.createDataFrame([(1, "who directed the film")], "query_id long, text string")
    c = spark.createDataFrame([(1, 1, "[x] - Big Film", "It stars Ann Lee and Bob Ray, no Summary"), (1, 2, "Summary", "by Ann Lee"), (1, 9, "Too Late", "No Body Here")], "query_id long, rank int, title string, text string")
    existing = spark.createDataFrame([(1, "who directed the film ann lee")], "query_id long, text string")
    got = [(r.position, r.text) for r in Q.second_hop_queries(queries, c, existing, 3).orderBy("position").collect()]
    assert got == [(1, "who directed the film Bob Ray"), (2, "who directed the film Big Film")]
    rows = [(1, 10, 1, 1, "alpha beta"), (1, 11, 2, 2, "gamma delta film"), (1, 12, 3, 3, "omega")]
    cand = spark.createDataFrame(rows, "query_id long, doc_id long, document long, rank int, text string")
    paths = spark.createDataFrame([(1, 10, 7, None, 1, "made alpha"), (1, 12, 8, 7, 2, "directed omega")], "query_id long, doc_id long, relation long, parent_relation long, depth int, shown string")
    assert [(r.parent, r.child) for r in Q.best_pair(queries, cand, paths).collect()] == [(10, 12)]
    evidence = spark.createDataFrame([(1, r, r, (r - 1) // 2, [2] if r in (2, 5) else [1]) for r in range(1, 7)], "query_id long, rank int, doc_id long, document long, slots array<int>")
    slots = spark.createDataFrame([(1, 2)], "query_id long, slot int")
    pair = spark.createDataFrame([(1, 1, 4)], "query_id long, parent long, child long")
    assert [r.doc_id for r in Q.diversified_evidence(evidence, slots, pair, 3).collect()] == [1, 4, 5]
    assert [r.doc_id for r in Q.diversified_evidence(evidence, slots, None, 3).collect()] == [1, 2, 3]


def test_vectors_are_cached_and_checked(spark):
    from lorespan.operators import search as Q

    v = spark.createDataFrame([(1, [1.0, -2.5]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1e300, 1.0]), (5, None)], "id long, v array<double>")
    enc = v.select("id", Q.encode_vector("v").alias("b"))
    back = enc.withColumn("c", F.sha2("b", 256)).select("id", Q.decode_vector("b", "c").alias("d"))
    assert {r.id: r.d for r in back.collect()} == {1: [1.0, -2.5], 2: None, 3: None, 4: None, 5: None}
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, text string")
    key = lambda t: F.sha2(F.concat_ws("|", F.lit("default"), F.lit(t)), 256)
    cache = spark.range(1).select(key("a").alias("key"), F.lit(b"A").alias("bytes"), F.sha2(F.lit(b"A"), 256).alias("checksum")).unionByName(spark.range(1).select(key("b").alias("key"), F.lit(b"B").alias("bytes"), F.lit("wrong").alias("checksum")))
    provide = lambda rows: rows.select("key", F.encode("text", "UTF-8").alias("bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("checksum"))
    found, made = Q.read_through(inputs, cache, provide)
    assert sorted((r.id, bytes(r.bytes)) for r in found.collect()) == [(1, b"A"), (2, b"b"), (3, b"A"), (4, b"c")] and made.count() == 2


def test_chunks_cover_blocks_in_order(spark):
    from lorespan.operators import chunking as K

    rng = random.Random(5)
    md = "# A\n\n" + " ".join(f"w{i}" for i in range(80)) + "\n\n## B\n\ntext under b\n\n# C\n\n" + "x" * 130 + "\n\n   \n\ntail"
    chunks = K.chunk_documents(spark.createDataFrame([("d1", md), ("d2", None), ("d3", "  \n")], "doc_id string, text string"), parent_tokens=100, child_tokens=30, overlap=4).collect()
    assert {c.id for c in chunks} == {"d1"}
    parents = [c for c in chunks if c.kind == "PARENT"]
    assert all(c.tokens <= 100 for c in parents) and all(c.tokens <= 30 for c in chunks if c.kind == "CHILD")
    headings = [c.heading for c in parents]
    assert set(headings) == {"A", "A\nB", "C"} and headings == sorted(headings)
    seen = "".join("".join(p.text.split()) for p in parents)
    assert seen == "".join("".join(t.split()) for _, _, t in __import__("lorespan.operators.parsing", fromlist=["x"]).markdown_blocks(md))
    for p in parents:  # children cover their parent, each beginning OVERLAP visible characters before the last one's end
        inside = [c.text for c in chunks if c.kind == "CHILD" and c.parent == p.parent]
        dense = "".join(p.text.split())
        at = 0
        for k, t in enumerate(inside):
            t = "".join(t.split())
            assert dense[at : at + len(t)] == t
            at += len(t) - 4
        assert at + 4 == len(dense)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 60)))
        pieces = K.split_block(text, 7)
        assert "".join("".join(p.split()) for p in pieces) == "".join(text.split()) and all(p == p.strip() for p in pieces)
    forced = list(K.pack([(0, "PARAGRAPH", (), "one"), (1, "PARAGRAPH", (), "two"), (2, "HEADING", ("H",), "H")], breaks=frozenset({1})))
    assert [f[6] for f in forced if f[0] == "PARENT"] == ["one", "two", "H"]
    assert K.heading_paths([("HEADING", 1, "a"), ("HEADING", 2, "b"), ("PARAGRAPH", 0, "p"), ("HEADING", 2, "c"), ("HEADING", 1, "d")])[2:] == [(2, "PARAGRAPH", ("a", "b"), "p"), (3, "HEADING", ("a", "c"), "c"), (4, "HEADING", ("d",), "d")]


def test_choices_within_budgets(spark):
    from lorespan.operators import graph_search as S
    from lorespan.operators import history as H

    paths = spark.createDataFrame([(1, 0, 0, 1, 10, None, "made", "x" * 50), (1, 0, 1, 2, 11, 10, "of", "y" * 50), (1, 1, 0, 2, 12, 99, "of", "z"), (1, 1, 1, 1, 10, None, "made", "again")], "query_id long, candidate int, path int, depth int, relation long, parent_relation long, relation_type string, text string")
    fixed = len("citationId=00000000-0000-0000-0000-000000000000;depth=1;relationshipType=made;evidenceText=")
    got = C.graph_path_budget(paths, 2 * fixed + 60).orderBy("place").collect()
    assert [(r.relation, len(r.text), r.cut) for r in got] == [(10, 50, False), (11, 12, True)]
    claims = spark.createDataFrame([(1, 1, 0, 5, 0, 7, 3, 2, "t" * 130, "c" * 40, "e" * 200), (1, 1, 0, 5, 1, 7, 3, 2, "t", "again", "same"), (1, 2, 0, 6, 0, 8, 3, 2, "t", "c", "e")], "query_id long, report_rank int, candidate int, report_id long, claim_order int, evidence_id long, child_id long, community long, title string, claim string, evidence string")
    got = C.claim_budget(claims, 300).collect()
    assert [(r.evidence_id, len(r.title)) for r in got] == [(7, 120)] and got[0].tokens <= 300 and len(got[0].claim) == 40
    kinds = [("QUESTION", 0), ("MEMORY", 0), ("MEMORY", 1), ("PARENT", 0), ("SUMMARY", 0), ("HISTORY", 0), ("HISTORY", 1), ("HISTORY", 2), ("EVIDENCE", 0), ("EVIDENCE", 1), ("EVIDENCE", 2)]
    parts = spark.createDataFrame([(1, i, k, p, 10, [1] if p == 1 else [2]) for i, (k, p) in enumerate(kinds)], "query_id long, part_id long, kind string, place int, tokens int, slots array<int>")
    gone = lambda cap: {r.part_id for r in C.trim_prompt(parts, cap).collect() if r.trimmed}
    assert gone(110) == set() and gone(95) == {1, 2} and gone(60) == {1, 2, 3, 4, 5} and gone(50) == {1, 2, 3, 4, 5, 10} and gone(0) == {1, 2, 3, 4, 5, 10, 9}
    edges = spark.createDataFrame([(1, 1, 10, None, 5), (1, 2, 11, 10, 6), (1, 3, 12, 99, 7), (1, 4, 13, 11, 8), (1, 5, 10, None, 5), (1, 6, 14, None, 5)], "query_id long, step long, relation long, parent_relation long, target long")
    starts = spark.createDataFrame([(1, 1)], "query_id long, entity long")
    assert [r.relation for r in S.admit_paths(edges, starts, 3, 9).orderBy("place").collect()] == [10, 11, 14]
    assert [r.relation for r in S.admit_paths(edges, starts, 9, 2).orderBy("place").collect()] == [10, 11]
    memory = spark.createDataFrame([(1, 1, "USER_FACT", 1, 0.9, 300), (1, 2, "DOCUMENT_FACT", 1, 0.8, 1), (1, 3, "DOCUMENT_FACT", 2, 0.7, 900), (1, 4, "USER_FACT", 1, 0.6, 300), (1, 5, "USER_FACT", 3, 0.05, 1), (1, 6, "USER_FACT", 1, 0.5, 100)], "query_id long, item_id long, kind string, matches int, score double, tokens int").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.item_id: (r.status, r.reason) for r in H.select_memory(memory).collect()}
    assert got == {1: ("INJECTED", ""), 2: ("TRIMMED", "MEMORY_RELEVANCE_LOW"), 3: ("DOCUMENT_EVIDENCE", ""), 4: ("TRIMMED", "MEMORY_TOKEN_BUDGET"), 5: ("TRIMMED", "MEMORY_RELEVANCE_LOW"), 6: ("INJECTED", "")}
    assert {r.item_id: r.status for r in H.select_memory(memory, personal_allowed=False).collect()}[1] == "REMOTE_BLOCKED"


def test_rules_and_gates(spark):
    from lorespan.operators import evaluation as E
    from lorespan.operators import resolution as N

    entities = spark.createDataFrame([(1, "A|x", ["x", "ex"]), (2, "A|y", ["y"]), (3, "A|x", ["x"])], "entity long, key string, surfaces array<string>")
    rules = spark.createDataFrame([(2, "MERGE", ["A|z"], [], "A|w"), (1, "SPLIT", ["A|x"], ["ex"], "A|z")], "place int, action string, source_keys array<string>, match_aliases array<string>, target_key string")
    assert {r.entity: r.key for r in N.apply_rules(entities, rules).collect()} == {1: "A|w", 2: "A|y", 3: "A|x"}
    assert {r.entity: r.key for r in N.apply_rules(entities, rules.limit(0)).collect()} == {1: "A|x", 2: "A|y", 3: "A|x"}
    assert E.HARD_METRICS["INTENT"] == ("phase12c.hard.intent_route_unique",) and len(E.HARD_METRICS["MULTIFORMAT_RELEASE"]) == 9 and len(E.HARD_METRICS["ANSWER_CITATION"]) == 7
    facts = spark.createDataFrame([(1, 10), (2, 10), (3, 0), (4, 10)], "fact_id long, length long")
    spans = spark.createDataFrame([(1, 0, 4), (1, 4, 10), (2, 0, 4), (2, 5, 10), (3, 0, 5), (1, -1, 3), (4, 0, 12), (4, 20, 30)], "fact_id long, first long, last long")
    assert {r.fact_id: r.covered for r in E.covered_facts(facts, spans).collect()} == {1: True, 2: False, 3: False, 4: True}
