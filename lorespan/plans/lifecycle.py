"""Queries of lifecycle, resolution and graph search operators over inputs derived from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import context as C
from lorespan.operators import graph_search as S
from lorespan.operators import lifecycle as L
from lorespan.operators import relational as X
from lorespan.operators import resolution as N
from lorespan.shared import spread
from lorespan.sources.tables import read

_c = F.col


# lifecycle -------------------------------------------------------------------------------------------------------------------------


def _expected(s, d):
    return read(s, d, "documents").select("doc_id", _c("lang").alias("format"), (1 + _c("n_chars") % 2).alias("revision_id"), F.when(_c("source") == "src1", 2).otherwise(1).alias("acl_version"))


def _projected(s, d):
    """The index lacks every eleventh document; every seventh is of an old revision, every fifth has no place."""
    return _expected(s, d).filter("doc_id % 11 <> 0").select("doc_id", F.when(_c("doc_id") % 7 == 0, 0).otherwise(_c("revision_id")).alias("revision_id"), "acl_version", (_c("doc_id") % 5 != 0).alias("located"))


def e15_coverage(s, d):
    return L.format_coverage(_expected(s, d), _projected(s, d))


_COVER = """cover AS (SELECT lang AS format, count(*) AS expected, count(*) FILTER (doc_id % 11 <> 0) AS projected, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS located, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 7 = 0) AS stale FROM documents GROUP BY lang)"""


def r6_closure_blockers(s, d):
    cover = L.format_coverage(_expected(s, d), _projected(s, d))
    orphaned = read(s, d, "part").join(read(s, d, "lineitem"), _c("p_partkey") == _c("l_partkey"), "left_anti").agg(F.count("*").alias("n"))
    restricted = read(s, d, "labels").agg(F.count_if(_c("toxic") == 1).alias("n"))
    invalid = read(s, d, "labels").agg(F.count_if(_c("toxic") > 1).alias("n"))
    return L.closure_status(cover, orphaned, restricted, invalid, restricted_blocks=True)


def r5_generation(s, d):
    chunks = read(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((_c("n_chars") - 1) / 1000))).alias("i"), "n_chars").select((_c("doc_id") * 1000 + _c("i")).alias("chunk_id"), (1 + _c("n_chars") % 2).alias("revision_id"), F.lit(1).alias("acl_version"))
    indexed = chunks.withColumn("revision_id", F.when(_c("chunk_id") % 977 == 0, 9).otherwise(_c("revision_id"))).withColumn("has_vector", _c("chunk_id") % 13 != 0)
    return L.generation_complete(chunks, indexed)


def r8_rebuild_requests(s, d):
    documents = _expected(s, d).select("doc_id", F.when(_c("doc_id") % 17 != 0, _c("revision_id")).alias("revision_id"), "acl_version", (_c("format") == "fr").alias("deleted"))
    state = F.element_at(F.array(F.lit("REQUESTED"), F.lit("GRAPH_READY"), F.lit("COMPLETED")), (_c("doc_id") % 3 + 1).cast("int"))
    requests = _expected(s, d).filter("doc_id % 2 = 0").select("doc_id", F.when(_c("doc_id") % 8 == 0, 0).otherwise(_c("revision_id")).alias("revision_id"), "acl_version", state.alias("state"))
    return L.rebuild_requests(requests, documents)


_HEADS = "e AS (SELECT doc_id, lang AS format, 1 + n_chars % 2 AS revision_id, CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS acl_version FROM documents)"


def r13_rollup(s, d):
    """Events as jobs of their user's revision."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("SUCCEEDED", "FAILED", "CANCELLED", "SUCCEEDED", "RUNNING", "QUARANTINED", "SUCCEEDED", "PENDING")]), (_c("event_id") % 8 + 1).cast("int"))
    jobs = read(s, d, "events").select(_c("event_id").alias("job_id"), _c("user_id").alias("revision_id"), _c("event_type").alias("stage"), status.alias("status"), F.when(_c("event_id") % 3 != 0, F.concat(F.lit("p"), (_c("event_id") % 2).cast("string"))).alias("parser"), _c("ts").alias("created"), F.date_trunc("day", "ts").alias("updated"))
    return L.revision_rollup(jobs)


def r14_orphans(s, d):
    """Parts as stored objects, changed at their first size; order lines name them."""
    objects = read(s, d, "part").select(_c("p_partkey").alias("object_key"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(p_size)").alias("modified"), "p_size")
    rows = read(s, d, "lineitem").filter("l_quantity > 45").select(_c("l_partkey").alias("object_key"))
    return L.orphaned_objects(objects, rows, F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")).select("object_key", "p_size")


def r17_retention(s, d):
    """Events of users as parents, whose state is their segment's."""
    parents = read(s, d, "customer").select(_c("c_custkey").alias("parent_id"), F.element_at(F.array(F.lit("SUCCEEDED"), F.lit("RUNNING"), F.lit("FAILED")), (_c("c_custkey") % 3 + 1).cast("int")).alias("status"))
    events = read(s, d, "events").select("event_id", _c("user_id").alias("parent_id"), "ts")
    return L.expired_events(events, parents, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("event_id")


def r12_evictions(s, d):
    """Events as cache entries used when they happened, as many bytes as ten times their value; those of purchases are pinned."""
    e = read(s, d, "events").select(_c("event_id").alias("key"), F.unix_micros(_c("ts").cast("timestamp")).alias("used"), F.floor(_c("value") * 10).alias("bytes"), "event_type")
    return L.evict(e, "used", "bytes", 50_000, e.filter("event_type = 'purchase'").select("key"), buckets=64).select("key", "freed")


def a19_projection(s, d):
    docs = read(s, d, "documents")
    cut = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((_c("n_chars") - 1) / 1000))).alias("chunk"))
    chunks = cut.withColumn("revision_id", F.explode(F.array(F.lit(1), F.lit(2))))
    heads = docs.select("doc_id", (1 + _c("n_chars") % 2).alias("revision_id"), F.lit(3).alias("acl_version"), _c("source").alias("owner"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    spans = chunks.filter("revision_id = 1").select("doc_id", "chunk", F.explode(F.sequence(F.lit(0), _c("chunk") % 3)).alias("span")).withColumn("label", F.concat(F.lit("part "), _c("span").cast("string")))
    return L.projection_documents(chunks, heads, spans)


def a21_projection_update(s, d):
    index = _expected(s, d).select("doc_id", "revision_id", "acl_version", _c("format").alias("owner"))
    access = index.filter("doc_id % 4 = 0").select("doc_id", (_c("acl_version") + 1).alias("acl_version"), F.lit("moved").alias("owner"))
    return L.update_projection(index, access, index.filter("doc_id % 6 = 0").select("doc_id"))


# resolution ------------------------------------------------------------------------------------------------------------------------


def _entities(s, d):
    return read(s, d, "part").select(_c("p_partkey").alias("entity"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("type"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))


def _aliases(s, d):
    return read(s, d, "part").select(_c("p_partkey").alias("entity"), F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat("p_brand", F.lit("/"), _c("p_size").cast("string")))).alias("alias"))


def _edges(s, d):
    return read(s, d, "lineitem").select(_c("l_partkey").alias("node"), _c("l_suppkey").alias("other")).distinct()


def _duplicates(s, d):
    similar = read(s, d, "part").select((_c("p_partkey") - 1).alias("a"), _c("p_partkey").alias("b")).filter("a % 50 = 1")
    return N.duplicate_candidates(_entities(s, d), _aliases(s, d), similar, _edges(s, d))


_DUP = """ent AS (SELECT p_partkey AS entity, split_part(p_type, ' ', 1) AS type, split_part(p_name, ' ', 1) AS name FROM part), ali AS (SELECT DISTINCT p_partkey AS entity, unnest([split_part(p_name, ' ', 1), p_brand || '/' || p_size]) AS alias FROM part),
hard AS (SELECT lag(entity) OVER (PARTITION BY name ORDER BY entity) AS a, entity AS b, 'EQUAL_NAME' AS signal FROM ent UNION SELECT lag(entity) OVER (PARTITION BY alias ORDER BY entity), entity, 'SHARED_ALIAS' FROM ali UNION SELECT p_partkey - 1, p_partkey, 'SIMILAR_NAME' FROM part WHERE (p_partkey - 1) % 50 = 1),
prs AS (SELECT a, b, list_sort(list(DISTINCT signal)) AS h FROM hard WHERE a IS NOT NULL GROUP BY a, b), nb AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS other FROM lineitem),
sh AS (SELECT a, b, count(*) AS shared FROM prs JOIN nb x ON x.node = a JOIN nb y ON y.node = b AND y.other = x.other GROUP BY a, b),
dup AS (SELECT prs.a, prs.b, array_to_string(h, '+') AS hard, len(h) AS n_hard, concat_ws('+', CASE WHEN p.type = q.type THEN 'SAME_TYPE' END, CASE WHEN shared > 0 THEN 'SHARED_NEIGHBOUR' END) AS supporting, len(h) + CASE WHEN p.type = q.type THEN 1 ELSE 0 END + CASE WHEN shared > 0 THEN 1 ELSE 0 END AS n_signals, coalesce(shared, 0) AS evidence
  FROM prs LEFT JOIN ent p ON p.entity = prs.a LEFT JOIN ent q ON q.entity = prs.b LEFT JOIN sh ON sh.a = prs.a AND sh.b = prs.b)"""


def n3_candidate_ranking(s, d):
    return N.rank_candidates(_duplicates(s, d).select("a", "b", "n_hard", "n_signals", "evidence"), ["a", "b"], 100)


def n4_preferred_target(s, d):
    profiles = _entities(s, d).join(read(s, d, "lineitem").groupBy(_c("l_partkey").alias("entity")).agg(F.count("*").alias("mentions")), "entity").select("entity", "name", "mentions")
    return N.preferred_target(_duplicates(s, d).select("a", "b"), profiles)


def n2_split_candidates(s, d):
    """Suppliers as entities; their lines' flags are the surfaces, by which they stand in orders as documents (those of one flag each, for some)."""
    mentions = read(s, d, "lineitem").select(_c("l_suppkey").alias("entity"), F.when(_c("l_suppkey") % 3 == 0, F.concat("l_returnflag", F.lit("x"))).otherwise(_c("l_returnflag")).alias("surface"), F.when(_c("l_suppkey") % 2 == 0, F.ascii("l_returnflag")).otherwise(_c("l_orderkey") % 5).alias("doc_id"))
    aliases = read(s, d, "supplier").select(_c("s_suppkey").alias("entity"), (_c("s_nationkey") % 4).cast("string").alias("alias"))
    entities = read(s, d, "supplier").select(_c("s_suppkey").alias("entity"), (_c("s_nationkey") % 2).cast("string").alias("type"), (_c("s_suppkey") % 7).cast("string").alias("name"))
    return N.split_candidates(mentions, aliases, entities)


def n6_impact(s, d):
    """Suppliers of a nation as the entities of a proposal."""
    lines = read(s, d, "lineitem")
    sources = read(s, d, "supplier").select(_c("s_nationkey").alias("proposal"), _c("s_suppkey").alias("entity"))
    dealt = spread(lines.withColumn("relation", _c("l_orderkey") * 10 + _c("l_linenumber")), lines.count(), "relation")
    edges = dealt.groupBy("relation").agg(F.min("l_suppkey").alias("a"), F.min(-1 - _c("l_partkey")).alias("b"))
    evidence = edges.select("relation", (_c("relation") % 97).alias("doc_id"))
    mentions = lines.select(_c("l_suppkey").alias("entity"), (_c("l_orderkey") % 89).alias("doc_id"))
    aliases = read(s, d, "supplier").select(_c("s_suppkey").alias("entity"), F.left("s_name", F.lit(12)).alias("alias"))
    communities = read(s, d, "supplier").select(_c("s_suppkey").alias("entity"), (_c("s_suppkey") % 5).alias("community"))
    return N.impact(sources, mentions, aliases, edges, evidence, communities)


def n7_fact_hashes(s, d):
    return read(s, d, "supplier").select("s_suppkey", N.fact_hash(_c("s_suppkey"), _c("s_name"), F.when(_c("s_nationkey") > 10, _c("s_nationkey"))).alias("fact_hash"))


def n8_proposal_conflicts(s, d):
    """Orders as proposals on their parts and a supplier."""
    lines = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(_c("l_partkey")).alias("sources"), F.min("l_suppkey").alias("s"))
    p = read(s, d, "orders").join(lines, _c("o_orderkey") == _c("l_orderkey"))
    return N.proposal_conflicts(p.select(_c("o_orderkey").alias("proposal"), F.when(_c("o_orderkey") % 2 == 0, "MERGE").otherwise("SPLIT").alias("action"), "sources", (_c("o_custkey") % 50).alias("target_name"), (_c("s") % 2).alias("target_type")))


# graph search ----------------------------------------------------------------------------------------------------------------------


def l1_frozen_sources(s, d):
    docs = _expected(s, d).select("doc_id", "revision_id", F.when(_c("doc_id") % 3 == 0, 0).otherwise(_c("revision_id")).alias("current_revision_id"), "acl_version", F.when(_c("doc_id") % 5 == 0, "FAILED").otherwise("READY").alias("status"), (_c("format") == "fr").alias("deleted"))
    return S.freeze_sources(docs)


def l3_anchors(s, d):
    """The tenth word of each text as a mention, spans of 200 characters."""
    docs = read(s, d, "documents").select(_c("doc_id").alias("child_id"), "text")
    mentions = docs.select(_c("child_id").alias("mention"), "child_id", F.split_part("text", F.lit(" "), F.lit(10)).alias("surface"))
    spans = docs.select("child_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 200))).alias("span")).select("child_id", "span", (_c("span") * 200).alias("a"), ((_c("span") + 1) * 200).alias("b"))
    return S.anchored(mentions, docs, spans).select("mention", _c("first").cast("long").alias("first"), _c("last").cast("long").alias("last"), "span")


def _graph(s, d):
    """Lines as relations, dealt by relation, so that what follows by relation is grouped and joined where it lies."""
    lines = read(s, d, "lineitem")
    dealt = spread(lines.withColumn("relation", _c("l_orderkey") * 10 + _c("l_linenumber")), lines.count(), "relation")
    return dealt.groupBy("relation").agg(F.min("l_partkey").alias("a"), F.min(-1 - _c("l_suppkey")).alias("b"), F.min("l_returnflag").alias("type"))


_GRAPH = "g AS (SELECT l_orderkey * 10 + l_linenumber AS relation, min(l_partkey) AS a, min(-1 - l_suppkey) AS b, min(l_returnflag) AS type FROM lineitem GROUP BY ALL)"


def l9_seeds(s, d):
    """Orders of a customer are the children that a search has found; parts in them are mentioned; parts of the customer's number by 200 match by alias."""
    hits = read(s, d, "orders").select(_c("o_custkey").alias("query_id"), _c("o_orderkey").alias("child_id"))
    mentions = read(s, d, "lineitem").select(_c("l_partkey").alias("entity"), _c("l_orderkey").alias("child_id"))
    matches = read(s, d, "customer").select(_c("c_custkey").alias("query_id"), (1 + _c("c_custkey") % 200).alias("entity"))
    return S.seeds(hits, mentions, matches, 5).select("query_id", "entity", _c("place").cast("long").alias("place"))


def l12_evidence(s, d):
    """Lines of an order as admitted relations, by line number; each proves its order and the one before."""
    lines = _graph(s, d).select(F.floor(_c("relation") / 10).alias("o"), "relation", (_c("relation") % 10).alias("place"))
    admitted = lines.select((_c("o") % 150).alias("query_id"), "relation", "place")
    evidence = lines.select("relation", F.explode(F.array(_c("o") % 40, (_c("o") + 1) % 40)).alias("child_id")).select("relation", "child_id", F.concat(F.lit("r"), _c("relation").cast("string")).alias("text"))
    return S.evidence_candidates(admitted, evidence, 10).select("query_id", "child_id", _c("place").cast("long").alias("place"), _c("relations").cast("long").alias("relations"), F.md5("shown").alias("shown"))


def l15_entities(s, d):
    mentions = read(s, d, "lineitem").select(_c("l_partkey").alias("entity"), _c("l_orderkey").alias("doc_id"))
    return S.browse_entities(_entities(s, d), _aliases(s, d), mentions, _graph(s, d), "", ("ECONOMY", "a", 0), 40)


def l16_members(s, d):
    members = read(s, d, "part").select(_c("p_partkey").alias("node"), _c("p_brand").alias("community"))
    return S.member_degrees(members, _graph(s, d)).select("community", "node", "degree", _c("place").cast("long").alias("place"))


def l19_relations(s, d):
    e = read(s, d, "part").select(_c("p_partkey").alias("entity"), _c("p_name").alias("name")).unionByName(read(s, d, "supplier").select((-1 - _c("s_suppkey")).alias("entity"), _c("s_name").alias("name")))
    evidence = _graph(s, d).select("relation", F.explode(F.array(_c("relation") % 50, (_c("relation") + 3) % 50)).alias("doc_id"), F.concat(F.lit("t"), (_c("relation") % 9).cast("string")).alias("text"))
    docs = read(s, d, "documents").filter("lang = 'en'").select("doc_id", _c("source").alias("title"))
    return S.relation_details(_graph(s, d), e, evidence, docs)


def m1_public_graph(s, d):
    evidence = _graph(s, d).select("relation", F.explode(F.array(_c("relation") % 50, (_c("relation") + 3) % 50)).alias("doc_id"))
    docs = read(s, d, "documents").select("doc_id", F.when(_c("lang") == "en", "ALL_USERS").otherwise("RESTRICTED").alias("visibility"))
    return S.public_subgraph(_graph(s, d), evidence, docs)


def _halves(s, d):
    return read(s, d, "part").select(_c("p_partkey").alias("node"), (_c("p_partkey") % 7).alias("community")).unionByName(read(s, d, "supplier").select((-1 - _c("s_suppkey")).alias("node"), (_c("s_suppkey") % 7).alias("community")))


def m2_top_communities(s, d):
    return S.top_communities(_halves(s, d), _graph(s, d), 5)


def l7_modularity(s, d):
    return S.modularity(_halves(s, d), _graph(s, d).select("a", "b", F.lit(1).alias("weight")))


def l11_admitted_paths(s, d):
    """Lines of a customer's orders as the edges of a walk, each behind the line before it in its order."""
    e = _graph(s, d).join(read(s, d, "orders").select(_c("o_orderkey").alias("o"), _c("o_custkey").alias("query_id")), F.floor(_c("relation") / 10) == _c("o"))
    edges = e.select("query_id", _c("relation").alias("step"), "relation", F.when(_c("relation") % 10 > 1, _c("relation") - 1).alias("parent_relation"), _c("b").alias("target"))
    return S.admit_paths(edges, read(s, d, "customer").select(_c("c_custkey").alias("query_id"), F.lit(-1).cast("long").alias("entity")), 6, 12)


def o2_graph_budget(s, d):
    e = _graph(s, d).select((_c("relation") / 10).cast("long").alias("query_id"), (_c("relation") % 3).cast("int").alias("candidate"), (_c("relation") % 10).cast("int").alias("path"), (1 + _c("relation") % 2).cast("int").alias("depth"), "relation", F.when(_c("relation") % 2 == 1, _c("relation") - 1).alias("parent_relation"), _c("type").alias("relation_type"), F.repeat(F.lit("evidence "), (_c("relation") % 30).cast("int")).alias("text"))
    return C.graph_path_budget(e, 500)


def o5_trimmed_prompts(s, d):
    kinds = ("QUESTION", "MEMORY", "PARENT", "GRAPH", "SUMMARY", "HISTORY", "EVIDENCE", "EVIDENCE")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (_c("relation") % 8 + 1).cast("int"))
    parts = _graph(s, d).select(F.floor(_c("relation") / 40).alias("query_id"), _c("relation").alias("part_id"), kind.alias("kind"), (_c("relation") % 100).cast("int").alias("place"), (20 + _c("relation") % 60).cast("int").alias("tokens"), F.array((_c("relation") % 3).cast("int")).alias("slots"))
    return C.trim_prompt(parts, 200)


QUERIES = {
    "c7_optional_filter": (
        lambda s, d: X.optional_filter(read(s, d, "events"), event_type="purchase", user_id=None).groupBy("user_id").agg(F.count("*").alias("n")),
        "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND (CAST(NULL AS BIGINT) IS NULL OR user_id = NULL) GROUP BY ALL",
    ),
    "e15_coverage": (e15_coverage, f"WITH {_COVER} SELECT * FROM cover"),
    "r6_closure_blockers": (
        r6_closure_blockers,
        f"""WITH {_COVER}, t AS (SELECT sum(expected) AS expected, sum(projected) AS projected, sum(located) AS located, sum(stale) AS stale, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS orphaned, (SELECT count(*) FROM labels WHERE toxic = 1) AS restricted FROM cover),
        b AS (SELECT *, list_filter([CASE WHEN stale > 0 THEN 'STALE_PROJECTION' END, CASE WHEN orphaned > 0 THEN 'ORPHANED_PROJECTION' END, CASE WHEN expected > located THEN 'LOCATOR_CLOSURE_INCOMPLETE' END, CASE WHEN restricted > 0 THEN 'RESTRICTED_SOURCE_PRESENT' END], lambda x: x IS NOT NULL) AS b FROM t)
        SELECT expected, projected, located, stale, orphaned, len(b) = 0 AS closed, array_to_string(b, '+') AS blockers FROM b""",
    ),
    "r5_generation": (
        r5_generation,
        """WITH c AS (SELECT doc_id * 1000 + unnest(range(0, (n_chars - 1) // 1000 + 1)) AS k FROM documents)
        SELECT count(*) AS expected, count(*) AS indexed, count(*) FILTER (k % 13 <> 0) AS vectors, count(*) FILTER (k % 977 = 0 OR k % 13 = 0) = 0 AS ready FROM c""",
    ),
    "r8_rebuild_requests": (
        r8_rebuild_requests,
        f"""WITH {_HEADS}, n AS (SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN revision_id END AS revision_id, acl_version, format = 'fr' AS deleted FROM e),
        q AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE revision_id END AS revision_id, acl_version, CASE doc_id % 3 WHEN 0 THEN 'REQUESTED' WHEN 1 THEN 'GRAPH_READY' ELSE 'COMPLETED' END AS state FROM e WHERE doc_id % 2 = 0)
        SELECT q.doc_id, q.revision_id, q.acl_version, CASE WHEN state <> 'COMPLETED' AND n.revision_id IS DISTINCT FROM q.revision_id THEN 'SUPERSEDED' ELSE state END AS state FROM q JOIN n USING (doc_id)
        UNION ALL SELECT n.doc_id, n.revision_id, n.acl_version, 'REQUESTED' FROM n LEFT JOIN q ON q.doc_id = n.doc_id AND q.revision_id = n.revision_id WHERE NOT deleted AND n.revision_id IS NOT NULL AND q.doc_id IS NULL""",
    ),
    "r12_evictions": (
        r12_evictions,
        """WITH e AS (SELECT event_id AS key, CAST(floor(value * 10) AS BIGINT) AS bytes, ts FROM events WHERE event_type <> 'purchase'), w AS (SELECT key, coalesce(sum(bytes) OVER (ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e) SELECT key, freed FROM w WHERE freed < 50000""",
    ),
    "r13_rollup": (
        r13_rollup,
        """WITH j AS (SELECT *, (['SUCCEEDED', 'FAILED', 'CANCELLED', 'SUCCEEDED', 'RUNNING', 'QUARANTINED', 'SUCCEEDED', 'PENDING'])[event_id % 8 + 1] AS st, CASE WHEN event_id % 3 <> 0 THEN 'p' || (event_id % 2) ELSE '' END AS parser FROM events),
        n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC, ts DESC, event_id) = 1)
        SELECT user_id AS revision_id, CASE WHEN bool_or(st = 'RUNNING') THEN 'RUNNING' WHEN bool_or(st = 'PENDING') THEN 'PENDING' WHEN bool_or(st = 'QUARANTINED') THEN 'QUARANTINED' WHEN bool_or(st = 'FAILED') THEN 'FAILED' WHEN bool_or(st = 'CANCELLED') THEN 'CANCELLED' ELSE 'SUCCEEDED' END AS status, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS stages, string_agg(DISTINCT parser, ',' ORDER BY parser) AS parsers FROM n GROUP BY user_id""",
    ),
    "r14_orphans": (r14_orphans, "SELECT p_partkey AS object_key, p_size FROM part WHERE p_size < 24 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "r17_retention": (r17_retention, "SELECT event_id FROM events JOIN customer ON c_custkey = user_id WHERE ts < TIMESTAMP '2024-01-10' AND c_custkey % 3 <> 1"),
    "a19_projection": (
        a19_projection,
        """WITH c AS (SELECT doc_id, unnest(range(0, (n_chars - 1) // 1000 + 1)) AS chunk, 1 + n_chars % 2 AS r, source, text FROM documents)
        SELECT doc_id || ':' || r || ':3' AS access_key, doc_id, chunk, r AS revision_id, 3 AS acl_version, source AS owner, split_part(text, chr(10), 1) AS title, 'part 0' AS first_label, 'part ' || (chunk % 3) AS last_label, chunk % 3 + 1 AS spans FROM c""",
    ),
    "a21_projection_update": (
        a21_projection_update,
        f"WITH {_HEADS} SELECT doc_id, revision_id, acl_version + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS acl_version, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE format END AS owner FROM e WHERE doc_id % 6 <> 0",
    ),
    "n1_duplicates": (_duplicates, f"WITH {_DUP} SELECT * FROM dup"),
    "n2_split_candidates": (
        n2_split_candidates,
        """WITH m AS (SELECT l_suppkey AS entity, CASE WHEN l_suppkey % 3 = 0 THEN l_returnflag || 'x' ELSE l_returnflag END AS surface, CASE WHEN l_suppkey % 2 = 0 THEN ascii(l_returnflag) ELSE l_orderkey % 5 END AS doc FROM lineitem),
        cnt AS (SELECT entity, surface, count(*) AS n FROM m GROUP BY entity, surface), r AS (SELECT entity, surface, row_number() OVER (PARTITION BY entity ORDER BY n DESC, surface) AS place FROM cnt), f AS (SELECT entity, surface AS l FROM r WHERE place = 1),
        a AS (SELECT r.* FROM r JOIN f USING (entity) WHERE place > 1 AND NOT EXISTS (SELECT 1 FROM m x JOIN m y ON x.entity = y.entity AND x.doc = y.doc WHERE x.entity = r.entity AND x.surface = r.surface AND y.surface = f.l)),
        z AS (SELECT entity, arg_min(surface, place) AS "right" FROM a GROUP BY entity), al AS (SELECT s_suppkey AS entity, CAST(s_nationkey % 4 AS VARCHAR) AS alias, CAST(s_nationkey % 2 AS VARCHAR) AS type, CAST(s_suppkey % 7 AS VARCHAR) AS name FROM supplier),
        k AS (SELECT entity, (SELECT count(DISTINCT y.entity) FROM al y WHERE y.alias = x.alias) > 1 AS ambiguous, EXISTS (SELECT 1 FROM al y WHERE y.name = x.alias AND y.type <> x.type) AS type_conflict FROM al x)
        SELECT f.entity, l AS "left", "right", ambiguous, type_conflict FROM f JOIN z USING (entity) JOIN k USING (entity) WHERE ambiguous OR type_conflict""",
    ),
    "n3_candidate_ranking": (n3_candidate_ranking, f"WITH {_DUP}, r AS (SELECT a, b, n_hard, n_signals, evidence, row_number() OVER (ORDER BY n_hard DESC, n_signals DESC, evidence DESC, a, b) AS rank FROM dup) SELECT * FROM r WHERE rank <= 100"),
    "n4_preferred_target": (
        n4_preferred_target,
        f"WITH {_DUP}, p AS (SELECT entity, name, count(*) AS m FROM ent JOIN lineitem ON l_partkey = entity GROUP BY ALL) SELECT a, b, CASE WHEN (-x.m, x.name, x.entity) < (-y.m, y.name, y.entity) THEN a ELSE b END AS target FROM dup JOIN p x ON x.entity = a JOIN p y ON y.entity = b",
    ),
    "n6_impact": (
        n6_impact,
        """WITH s AS (SELECT s_nationkey AS proposal, s_suppkey AS entity, s_name FROM supplier), g AS (SELECT l_orderkey * 10 + l_linenumber AS relation, min(l_suppkey) AS a FROM lineitem GROUP BY ALL),
        rel AS (SELECT proposal, relation FROM s JOIN g ON a = entity), men AS (SELECT proposal, l_orderkey % 89 AS doc FROM s JOIN lineitem ON l_suppkey = entity),
        doc AS (SELECT proposal, count(*) AS n FROM (SELECT proposal, doc FROM men UNION SELECT proposal, relation % 97 FROM rel) GROUP BY proposal)
        SELECT proposal, (SELECT count(*) FROM men m WHERE m.proposal = s.proposal) AS mentions, count(DISTINCT left(s_name, 12)) AS aliases, (SELECT count(*) FROM rel r WHERE r.proposal = s.proposal) AS relations, coalesce((SELECT n FROM doc d WHERE d.proposal = s.proposal), 0) AS documents, (SELECT count(*) FROM rel r WHERE r.proposal = s.proposal) AS evidence, count(DISTINCT entity % 5) AS communities FROM s GROUP BY proposal""",
    ),
    "n7_fact_hashes": (n7_fact_hashes, "SELECT s_suppkey, sha256(s_suppkey || '|' || s_name || '|' || CASE WHEN s_nationkey > 10 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END) AS fact_hash FROM supplier"),
    "n8_proposal_conflicts": (
        n8_proposal_conflicts,
        """WITH l AS (SELECT l_orderkey AS p, list_sort(list(DISTINCT l_partkey)) AS src, min(l_suppkey) % 2 AS t FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey AS p, o_orderkey % 2 AS act, src, o_custkey % 50 AS name, t FROM orders JOIN l ON l.p = o_orderkey), u AS (SELECT p, unnest(src) AS s FROM p)
        SELECT x.p AS proposal, 'SOURCE_ENTITY_OVERLAP' AS code, count(DISTINCT y.p) AS others FROM u x JOIN u y ON x.s = y.s AND x.p <> y.p GROUP BY x.p
        UNION ALL SELECT * FROM (SELECT p, 'DUPLICATE_RULE', count(*) OVER (PARTITION BY act, src) - 1 AS n FROM p) WHERE n > 0
        UNION ALL SELECT * FROM (SELECT p, 'TARGET_TYPE_CONFLICT', count(*) OVER (PARTITION BY name) - count(*) OVER (PARTITION BY name, t) AS n FROM p) WHERE n > 0""",
    ),
    "l1_frozen_sources": (l1_frozen_sources, f"WITH {_HEADS} SELECT doc_id, revision_id, acl_version FROM e WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND format <> 'fr'"),
    "l3_anchors": (
        l3_anchors,
        """WITH d AS (SELECT doc_id, split_part(text, ' ', 10) AS w, unnest(range(0, (length(text) - 1) // 200 + 1)) AS span, text FROM documents),
        p AS (SELECT doc_id, w, span, instr(substr(text, CAST(span * 200 + 1 AS INT), 200), w) AS found FROM d WHERE w <> ''),
        a AS (SELECT doc_id, min(span * 200 + found) AS i, any_value(w) AS w FROM p WHERE found > 0 GROUP BY doc_id)
        SELECT doc_id AS mention, i - 1 AS first, i - 1 + length(w) AS last, (i - 1) // 200 AS span FROM a""",
    ),
    "l7_modularity": (
        l7_modularity,
        f"""WITH {_GRAPH}, e AS (SELECT a % 7 AS ca, (-1 - b) % 7 AS cb FROM g), k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c)
        SELECT round((SELECT count(*) FILTER (ca = cb) / count(*) FROM e) - (SELECT sum(CAST(k AS DOUBLE) * k) FROM k) / (4.0 * (SELECT count(*) FROM e) * (SELECT count(*) FROM e)), 6) AS modularity""",
    ),
    "l9_seeds": (
        l9_seeds,
        """WITH f AS (SELECT o_custkey AS query_id, l_partkey AS entity, 0 AS p, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL UNION ALL SELECT c_custkey, l_partkey, 1, count(*) FROM customer JOIN lineitem ON l_partkey = 1 + c_custkey % 200 GROUP BY ALL),
        m AS (SELECT query_id, entity, min(p) AS p, sum(n) AS n FROM f GROUP BY ALL), r AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY p, n DESC, entity) AS place FROM m) SELECT * FROM r WHERE place <= 5""",
    ),
    "l11_admitted_paths": (l11_admitted_paths, None),
    "l12_evidence": (
        l12_evidence,
        f"""WITH {_GRAPH}, e AS (SELECT relation // 10 % 150 AS query_id, relation, relation % 10 AS place, unnest([relation // 10 % 40, (relation // 10 + 1) % 40]) AS child_id FROM g),
        p AS (SELECT query_id, child_id, min(place) AS first, count(*) AS relations, md5(string_agg('r' || relation, ' ' ORDER BY place, relation)) AS shown FROM e GROUP BY ALL),
        r AS (SELECT query_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY first, child_id) AS place, relations, shown FROM p) SELECT * FROM r WHERE place <= 10""",
    ),
    "l15_entities": (
        l15_entities,
        f"""WITH {_GRAPH}, e AS (SELECT p_partkey AS entity, split_part(p_type, ' ', 1) AS type, split_part(p_name, ' ', 1) AS name, p_brand || '/' || p_size AS alias FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
        p AS (SELECT * FROM e WHERE (type, name, entity) > ('ECONOMY', 'a', 0) ORDER BY type, name, entity LIMIT 40)
        SELECT entity, type, name, array_to_string(list_sort(list_distinct([name, alias])), '; ') AS aliases, (SELECT count(*) FROM lineitem WHERE l_partkey = entity) AS mentions, (SELECT count(*) FROM g WHERE a = entity) AS relations FROM p""",
    ),
    "l16_members": (
        l16_members,
        f"WITH {_GRAPH}, k AS (SELECT p_brand AS community, p_partkey AS node, (SELECT count(*) FROM g WHERE a = p_partkey) AS degree FROM part) SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS place FROM k",
    ),
    "l19_relations": (
        l19_relations,
        f"""WITH {_GRAPH}, v AS (SELECT relation, unnest([relation % 50, (relation + 3) % 50]) AS doc_id, 't' || (relation % 9) AS text FROM g), x AS (SELECT v.*, source AS title FROM v JOIN documents USING (doc_id) WHERE lang = 'en')
        SELECT g.relation, g.type, p_name AS a_name, s_name AS b_name, count(*) AS pieces, CAST(to_json(list({{'doc_id': x.doc_id, 'title': x.title, 'text': x.text}} ORDER BY x.doc_id, x.text)) AS VARCHAR) AS evidence FROM g JOIN x USING (relation) JOIN part ON p_partkey = a JOIN supplier ON s_suppkey = -1 - b GROUP BY ALL""",
    ),
    "m1_public_graph": (
        m1_public_graph,
        f"WITH {_GRAPH}, v AS (SELECT relation, a, b, unnest([relation % 50, (relation + 3) % 50]) AS doc_id FROM g) SELECT relation, a, b, count(*) AS pieces FROM v JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY ALL",
    ),
    "m2_top_communities": (m2_top_communities, f"WITH {_GRAPH} SELECT a % 7 AS community, count(*) AS relations FROM g WHERE a % 7 = (-1 - b) % 7 GROUP BY ALL ORDER BY relations DESC, community LIMIT 5"),
    "o2_graph_budget": (o2_graph_budget, None),
    "o5_trimmed_prompts": (o5_trimmed_prompts, None),
}
