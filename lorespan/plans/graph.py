"""Queries of graph, context, history, evaluation and lifecycle operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import communities as M
from lorespan.operators import context as C
from lorespan.operators import graph as G
from lorespan.operators import lifecycle as L
from lorespan.operators import relational as X
from lorespan.shared import spread
from lorespan.sources.tables import read

_c = F.col


def _trade(s, d):
    """Edges part - supplier, weighted by lines; suppliers are numbered below zero."""
    lines = read(s, d, "lineitem")
    return spread(lines.select(_c("l_partkey").alias("a"), (-1 - _c("l_suppkey")).alias("b")), lines.count(), "a").groupBy("a", "b").agg(F.count("*").alias("weight"))


_TRADE = "trade AS (SELECT l_partkey AS a, -1 - l_suppkey AS b, count(*) AS weight FROM lineitem GROUP BY ALL)"


def _copies(s, d):
    """Documents of one text are linked by their order."""
    docs = read(s, d, "documents").select(_c("doc_id").alias("b"), F.md5("text").alias("h"), "source")
    by_text = docs.groupBy("h").agg(F.min("b").alias("a"))
    return docs.join(by_text, "h").filter("a <> b").select("a", "b")


def _walk(s, d):
    edges = X.either_endpoint(_trade(s, d), "a", "b")
    return G.bounded_walk(edges, read(s, d, "supplier").select((-1 - _c("s_suppkey")).alias("node")), 2, 3).groupBy("seed", "depth").agg(F.count("*").alias("paths"), F.min("node").alias("least"), F.max("node").alias("most"))


def _sql_walk(s, d):
    pairs = read(s, d, "nation").select((100 + _c("n_regionkey")).alias("a"), _c("n_nationkey").alias("b"))
    return G.sql_walk(s, X.either_endpoint(pairs, "a", "b").select("node", "other"), s.createDataFrame([(0,)], "node int"), 2)


def _members(s, d):
    return read(s, d, "part").select(_c("p_partkey").alias("node"), _c("p_brand").alias("community"), _c("p_name").alias("name"))


def _jobs(s, d):
    e = read(s, d, "events")
    return e.select(_c("event_id").alias("job_id"), F.when(_c("event_type") == "view", "PENDING").when(_c("event_type") == "click", "RUNNING").otherwise("DONE").alias("status"), _c("ts").alias("created"), (_c("ts") + F.expr("INTERVAL 5 MINUTES")).alias("lease_until"), (_c("user_id") % 3).alias("attempt"))


def _slots(s, d):
    """Lines of an order stand in for the ranked candidates of a query."""
    w = "OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber)"
    return read(s, d, "lineitem").select(_c("l_orderkey").alias("query_id"), F.expr(f"row_number() {w}").alias("rank"), F.expr(f"row_number() {w}").alias("child_id"), F.floor(_c("l_quantity")).cast("int").alias("child_tokens"), _c("l_suppkey").alias("parent_id"), (_c("l_partkey") % 900).cast("int").alias("parent_tokens"), (_c("l_suppkey") % 4).alias("doc_id"))


QUERIES = {
    "l2_merge_entities": (
        lambda s, d: G.merge_entities(read(s, d, "part").select(_c("p_partkey").alias("position"), _c("p_type").alias("type"), F.initcap("p_name").alias("name"), _c("p_brand").alias("description"))),
        "WITH m AS (SELECT p_partkey AS position, p_type AS type, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substr(x, 2))), ' ') AS name, p_brand AS description FROM part) SELECT concat_ws('|', type, lower(trim(name))) AS key, any_value(type) AS type, arg_min(name, position) AS name, arg_min(description, position) AS description, string_agg(DISTINCT name, '; ' ORDER BY name) AS aliases, count(*) AS mentions FROM m GROUP BY 1",
    ),
    "l4_merge_relations": (
        lambda s, d: G.merge_relations(read(s, d, "lineitem").select(_c("l_partkey").alias("a"), _c("l_suppkey").alias("b"), _c("l_returnflag").alias("type"))),
        "SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS type, count(*) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL",
    ),
    "l6_adjacency": (lambda s, d: X.either_endpoint(_trade(s, d), "a", "b"), f"WITH {_TRADE} SELECT a AS node, b AS other, 'OUT' AS direction, weight FROM trade UNION ALL SELECT b, a, 'IN', weight FROM trade"),
    "l7_components": (lambda s, d: G.connected_components(_copies(s, d)), "WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS component, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) SELECT doc_id AS node, component FROM m WHERE n > 1"),
    "l7_leiden": (
        lambda s, d: M.leiden_communities(_copies(s, d).select("a", "b", F.lit(1.0).alias("weight"))).select(_c("node").alias("doc_id"), "community"),
        # the copies of a text are a star, and a leaf always gains by joining its centre
        "WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, dense_rank() OVER (ORDER BY first) - 1 AS community FROM g WHERE n > 1",
    ),
    "l7_label_communities": (lambda s, d: G.label_communities(_trade(s, d)), None),
    "l8_community_facts": (
        lambda s, d: G.community_facts(_members(s, d), read(s, d, "lineitem").select(_c("l_partkey").alias("a"), _c("l_suppkey").alias("b"))),
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS n FROM part) SELECT p_brand AS community, count(*) AS members, string_agg(p_name, ' · ' ORDER BY n) FILTER (n <= 3) AS title, (SELECT count(*) FROM lineitem JOIN part p ON l_partkey = p.p_partkey WHERE p.p_brand = r.p_brand) AS relations FROM r GROUP BY p_brand",
    ),
    "l10_bounded_walk": (
        _walk,
        f"""WITH {_TRADE}, e AS (SELECT a AS node, b AS other, weight FROM trade UNION ALL SELECT b, a, weight FROM trade),
        best AS (SELECT node, other FROM e QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) <= 3),
        p0 AS (SELECT -1 - s_suppkey AS seed, 0 AS depth, -1 - s_suppkey AS node, [-1 - s_suppkey] AS path FROM supplier),
        p1 AS (SELECT seed, 1 AS depth, other AS node, list_append(path, other) AS path FROM p0 JOIN best ON best.node = p0.node WHERE NOT list_contains(path, other)),
        p2 AS (SELECT seed, 2 AS depth, other AS node, path FROM p1 JOIN best ON best.node = p1.node WHERE NOT list_contains(path, other))
        SELECT seed, depth, count(*) AS paths, min(node) AS least, max(node) AS most FROM (SELECT seed, depth, node FROM p0 UNION ALL SELECT seed, depth, node FROM p1 UNION ALL SELECT seed, depth, node FROM p2) GROUP BY ALL""",
    ),
    "l14_recursive_view": (
        _sql_walk,
        "WITH r AS (SELECT n_regionkey AS k FROM nation WHERE n_nationkey = 0), t AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT 100 + k, 1 FROM r UNION ALL SELECT n_nationkey, 2 FROM nation WHERE n_regionkey IN (SELECT k FROM r)) SELECT node, min(depth) AS depth FROM t GROUP BY ALL",
    ),
    "m4_valid_reports": (
        lambda s, d: G.valid_reports(read(s, d, "lineitem").select(_c("l_suppkey").alias("report_id"), _c("l_orderkey").alias("claim_id")).distinct(), read(s, d, "orders").select(_c("o_orderkey").alias("claim_id"), _c("o_custkey").alias("evidence_id")), read(s, d, "customer").filter("c_acctbal > -990").select(_c("c_custkey").alias("evidence_id"))),
        "SELECT DISTINCT l_suppkey AS report_id FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -990))",
    ),
    "n5_shared_neighbours": (
        lambda s, d: G.shared_neighbours(read(s, d, "customer").select(_c("c_nationkey").alias("node"), _c("c_mktsegment").alias("other"))),
        "WITH e AS (SELECT DISTINCT c_nationkey AS node, c_mktsegment AS other FROM customer), n AS (SELECT node, count(*) AS n FROM e GROUP BY node) SELECT a.node AS a, b.node AS b, count(*) AS shared, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard FROM e a JOIN e b ON a.other = b.other AND a.node < b.node JOIN n x ON x.node = a.node JOIN n y ON y.node = b.node GROUP BY a.node, b.node",
    ),
    "o1_parent_plan": (lambda s, d: C.plan_parents(_slots(s, d), 4, 2, 800, 1500).groupBy("query_id").agg(F.count_if("included").alias("included"), F.sum("tokens").alias("tokens"), F.max("reason").alias("reason")), None),
    "o4_budget_split": (
        lambda s, d: read(s, d, "part").select("p_partkey", *[x.cast("long").alias(n) for x, n in zip((*C.split_budget(_c("p_size") * 100, 900, 15, 2400), C.input_cap(_c("p_size") * 1000, F.lit(512))), ("graph", "global", "cap"), strict=True)]),
        "SELECT p_partkey, CAST(least(900, floor(p_size * 100 * 15 / 100)) AS BIGINT) AS graph, CAST(least(2400, p_size * 100 - least(900, floor(p_size * 100 * 15 / 100))) AS BIGINT) AS global, CAST(p_size * 1000 - 512 - greatest(256, ceil(p_size * 1000 * 0.05)) AS BIGINT) AS cap FROM part",
    ),
    "o6_prefix_budget": (
        lambda s, d: C.within_budget(read(s, d, "conversations").withColumn("n", F.length("text").cast("long")), "conv_id", [_c("turn")], "n", 800).select("conv_id", "turn", "spent"),
        "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations QUALIFY spent < 800",
    ),
    "p3_recent_history": (
        lambda s, d: C.recent_history(read(s, d, "conversations"), 4, 1500).select("conv_id", "turn", "age", "used"),
        "WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations), b AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM a WHERE age <= 4), c AS (SELECT *, max(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS started FROM b WHERE used <= 1500) SELECT conv_id, turn, age, used FROM c WHERE started = 1",
    ),
    "p4_needs_compression": (lambda s, d: C.needs_compression(read(s, d, "conversations"), 6, 2048), "SELECT conv_id, count(*) AS messages, sum(length(text)) AS tokens, count(*) > 6 OR sum(length(text)) > 2048 AS compress FROM conversations GROUP BY ALL"),
    "q18_next_case": (lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(1).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "r1_claimable_jobs": (
        lambda s, d: L.claimable(_jobs(s, d), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 20).select("job_id", "attempt"),
        "SELECT event_id AS job_id, user_id % 3 + 1 AS attempt FROM events WHERE event_type = 'view' OR (event_type = 'click' AND ts + INTERVAL 5 MINUTES < TIMESTAMP '2024-01-20 00:00:00') ORDER BY ts, event_id LIMIT 20",
    ),
    "r1_claimed_jobs": (
        lambda s, d: L.claim_jobs(_jobs(s, d).withColumn("lease_owner", F.lit(None).cast("string")), read(s, d, "supplier").select(_c("s_name").alias("worker")), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), F.expr("INTERVAL 5 MINUTES"), 2).filter("lease_owner IS NOT NULL OR status = 'FAILED'").select("job_id", "status", "attempt", "lease_owner"),
        """WITH j AS (SELECT event_id AS job_id, ts, user_id % 3 AS attempt, event_type = 'click' AND ts + INTERVAL 5 MINUTES < TIMESTAMP '2024-01-20 00:00:00' AS late, event_type = 'view' AS pending FROM events),
        f AS (SELECT *, row_number() OVER (ORDER BY ts, job_id) AS turn FROM j WHERE (pending OR late) AND attempt < 2), w AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS turn FROM supplier)
        SELECT job_id, 'RUNNING' AS status, attempt + 1 AS attempt, s_name AS lease_owner FROM f JOIN w USING (turn) UNION ALL SELECT job_id, 'FAILED', attempt, NULL FROM j WHERE late AND attempt >= 2""",
    ),
    "r3_retry": (lambda s, d: _jobs(s, d).groupBy(L.after_failure(_c("attempt"), 2).alias("status")).agg(F.count("*").alias("n")), "SELECT CASE WHEN user_id % 3 < 2 THEN 'PENDING' ELSE 'FAILED' END AS status, count(*) AS n FROM events GROUP BY ALL"),
    "r4_projection_sync": (
        lambda s, d: L.stale_projection(read(s, d, "documents").select("doc_id", _c("n_chars").alias("v")), read(s, d, "labels").select("doc_id", (_c("quality") * 2000).cast("long").alias("v")), "doc_id", "v"),
        "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'DELETE' ELSE 'UPSERT' END AS action FROM documents FULL JOIN labels USING (doc_id) WHERE n_chars IS NULL OR quality IS NULL OR quality * 2000 < n_chars",
    ),
    "r9_upsert": (
        lambda s, d: L.upsert(read(s, d, "labels"), read(s, d, "labels").filter("toxic = 1").withColumn("quality", F.lit(9)), ["doc_id"]).groupBy("quality").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN toxic = 1 THEN 9 ELSE quality END AS quality, count(*) AS n FROM labels GROUP BY ALL",
    ),
    "r10_current_revision": (
        lambda s, d: L.current_revisions(read(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn"),
        "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    ),
    "r15_version_chain": (
        lambda s, d: L.next_versions(read(s, d, "orders"), ["o_custkey"], [_c("o_orderdate"), _c("o_orderkey")]).select("o_custkey", "o_orderkey", "version", "superseded"),
        "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) < count(*) OVER (PARTITION BY o_custkey) AS superseded FROM orders",
    ),
    "r16_idempotency": (lambda s, d: L.idempotency_conflicts(read(s, d, "customer"), "c_nationkey", ["c_mktsegment"]), "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS fingerprints FROM customer GROUP BY ALL HAVING count(DISTINCT c_mktsegment) > 1"),
}
