"""Queries of graph views, claims, histories and deltas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import context as C
from lorespan.operators import evaluation as E
from lorespan.operators import graph_views as V
from lorespan.operators import parsing as P
from lorespan.sources.tables import read

_c = F.col


def c16_extraction_bounds(s, d):
    """Suppliers are parents, the parts they deliver entities, lines mentions, part and order pairs relations, orders aliases."""
    lines = read(s, d, "lineitem").select(_c("l_suppkey").alias("parent_id"), _c("l_partkey").alias("entity_id"), "l_orderkey", "l_shipdate")
    pairs = lines.select("parent_id", "entity_id").distinct()
    relations = lines.select("parent_id", "entity_id", "l_orderkey").distinct()
    return V.extraction_bounds(read(s, d, "supplier").select(_c("s_suppkey").alias("parent_id")), pairs, relations, lines.select("parent_id", "entity_id", "l_orderkey").distinct(), lines)


def _claims(s, d):
    """Orders are reports with their lines as claims, parts the evidence; a customer's reader may use parts of some sizes."""
    lines = read(s, d, "lineitem")
    reports = read(s, d, "orders").select(_c("o_orderkey").alias("report_id"), _c("o_orderpriority").alias("title"), F.when(_c("o_orderstatus") != "P", _c("o_orderstatus")).alias("summary"))
    claims = lines.groupBy(_c("l_orderkey").alias("report_id"), _c("l_linenumber").alias("claim")).agg(F.max("l_returnflag").alias("text"))
    evidence = lines.select(_c("l_orderkey").alias("report_id"), _c("l_linenumber").alias("claim"), _c("l_partkey").alias("evidence_id"))
    allowed = lines.join(read(s, d, "part").filter("p_size <= 40").select(_c("p_partkey").alias("l_partkey")), "l_partkey").select(_c("l_orderkey").alias("report_id"), _c("l_partkey").alias("evidence_id"))
    return V.valid_claims(reports, claims, evidence, allowed, 5)


def j13_child_ranks(s, d):
    """Orders are reports ranked for their customers, parts the children that their lines rest on."""
    ranked = read(s, d, "orders").select(_c("o_custkey").alias("query_id"), _c("o_orderkey").alias("report_id"), F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)").alias("rank"))
    return V.child_ranks(ranked, read(s, d, "lineitem").select(_c("l_orderkey").alias("report_id"), _c("l_partkey").alias("doc_id")))


def _trade(s, d):
    return read(s, d, "lineitem").groupBy(_c("l_partkey").alias("a"), (-1 - _c("l_suppkey")).alias("b")).agg(F.count("*").alias("pieces")).withColumn("relation", F.concat_ws("-", _c("a").cast("string"), (-_c("b")).cast("string")))


def l14_subgraph_views(s, d):
    return V.subgraph_views(_trade(s, d), read(s, d, "part").filter("p_partkey % 20 = 0").select(_c("p_partkey").alias("root")))


def l16_community_details(s, d):
    """Brands are communities of parts, parts of one order are related, orders are claims on the parts' suppliers."""
    part, lines = read(s, d, "part"), read(s, d, "lineitem")
    members = part.select(_c("p_partkey").alias("node"), _c("p_brand").alias("community"))
    relations = lines.groupBy(_c("l_orderkey").alias("relation")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    claims = lines.join(part.select(_c("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(_c("p_brand").alias("community"), _c("l_orderkey").alias("claim"), _c("l_suppkey").alias("evidence_id")).distinct()
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), _c(c).cast("long").alias("id"))
    visible = kind(part.filter("p_size < 10"), "NODE", "p_partkey").unionByName(kind(read(s, d, "orders").filter("o_orderstatus = 'O'"), "RELATION", "o_orderkey")).unionByName(kind(read(s, d, "supplier").filter("s_nationkey < 20"), "EVIDENCE", "s_suppkey"))
    return V.community_details(members, relations, claims, visible)


def l20_entity_details(s, d):
    """Parts with their brand and type as aliases, lines as mentions, and relations to suppliers; orders are the documents."""
    part, lines = read(s, d, "part"), read(s, d, "lineitem")
    entities = part.select(_c("p_partkey").alias("entity"), _c("p_name").alias("name"), _c("p_type").alias("type"))
    aliases = part.select(_c("p_partkey").alias("entity"), F.explode(F.array("p_brand", "p_type")).alias("alias"))
    mentions = lines.select(_c("l_partkey").alias("entity"), _c("l_orderkey").alias("doc_id"), (_c("l_linenumber") * 1000 + F.floor("l_quantity")).alias("place"), _c("l_returnflag").alias("text"))
    relations = lines.select(F.concat_ws("-", _c("l_partkey").cast("string"), _c("l_suppkey").cast("string")).alias("relation"), _c("l_partkey").alias("a"), (-1 - _c("l_suppkey")).alias("b"), F.lit("SOLD").alias("type"), _c("l_orderkey").alias("doc_id"))
    out = V.entity_details(entities, aliases, mentions, relations, read(s, d, "orders").filter("o_orderstatus = 'O'").select(_c("o_orderkey").alias("doc_id")), 3)
    return out.select("entity", "aliases", "mention_count", "relation_count", F.size(F.from_json("mentions", "array<struct<doc_id:long>>")).alias("shown"), F.from_json("relations", "array<struct<relation:string>>")[0]["relation"].alias("strongest"))


def p3_history_context(s, d):
    """Every third conversation has a summary of its first turns."""
    said = read(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("tokens"))
    summaries = said.filter("conv_id % 3 = 0").groupBy("conv_id").agg((F.max("turn") - 3 - _c("conv_id") % 4).alias("covered"), (F.sum("tokens") % 300).alias("tokens"))
    return C.history_context(said, summaries, 12, 400)


def q9_slice_deltas(s, d):
    """Two years' orders are runs, priorities languages, and nations' customers case types."""
    orders = read(s, d, "orders").join(read(s, d, "customer").select(_c("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    run = lambda y: orders.filter(F.year("o_orderdate") % 2 == y).select(F.when(_c("o_orderstatus") == "O", "SUCCEEDED").when(_c("o_orderstatus") == "F", "FAILED").otherwise("BLOCKED").alias("status"), _c("o_orderpriority").alias("language"), _c("c_mktsegment").alias("case_type"))
    return E.slice_deltas(run(0), run(1))


def q9_metric_deltas(s, d):
    e = read(s, d, "events")
    run = lambda p: e.filter(_c("user_id") % 2 == p).select(_c("event_type").alias("metric"), "value", F.when(_c("event_id") % 5 != 0, "MEASURED").otherwise("SKIPPED").alias("status"))
    return E.metric_deltas(run(0), run(1))


QUERIES = {
    "a6_external_references": (lambda s, d: P.external_references(read(s, d, "pages")).select(_c("id").alias("page_id"), "external", (_c("blocks") > 0).alias("has_text")), None),
    "c16_extraction_bounds": (
        c16_extraction_bounds,
        """WITH l AS (SELECT l_suppkey AS p, l_partkey AS e, l_orderkey AS o FROM lineitem), u AS (SELECT DISTINCT * FROM l),
        e AS (SELECT p, count(DISTINCT e) AS entities FROM l GROUP BY p), r AS (SELECT p, count(*) AS relations FROM u GROUP BY p),
        a AS (SELECT p, max(n) AS aliases FROM (SELECT p, e, count(*) AS n FROM u GROUP BY ALL) GROUP BY p), m AS (SELECT p, max(n) AS mentions FROM (SELECT p, e, count(*) AS n FROM l GROUP BY ALL) GROUP BY p)
        SELECT s_suppkey AS parent_id, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, coalesce(aliases, 0) AS aliases, coalesce(mentions, 0) AS mentions,
        coalesce(entities, 0) <= 200 AND coalesce(relations, 0) <= 400 AND coalesce(aliases, 0) <= 50 AND coalesce(mentions, 0) <= 100 AS accepted
        FROM supplier LEFT JOIN e ON e.p = s_suppkey LEFT JOIN r ON r.p = s_suppkey LEFT JOIN a ON a.p = s_suppkey LEFT JOIN m ON m.p = s_suppkey""",
    ),
    "m3_valid_claims": (
        _claims,
        """WITH c AS (SELECT l_orderkey AS report_id, l_linenumber AS claim, max(l_returnflag) AS text FROM lineitem GROUP BY ALL),
        t AS (SELECT o_orderkey AS report_id FROM orders WHERE o_orderstatus <> 'P'), f AS (SELECT report_id FROM c GROUP BY report_id HAVING count(*) <= 5),
        g AS (SELECT DISTINCT l_orderkey AS report_id, l_linenumber AS claim, l_partkey, p_size <= 40 AS fine FROM lineitem JOIN part ON p_partkey = l_partkey),
        v AS (SELECT report_id, claim, count(*) AS pieces FROM g GROUP BY ALL HAVING bool_and(fine))
        SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY claim) - 1 AS place, claim, text, pieces FROM c JOIN v USING (report_id, claim) WHERE report_id IN (SELECT report_id FROM t) AND report_id IN (SELECT report_id FROM f)""",
    ),
    "j13_child_ranks": (
        j13_child_ranks,
        "WITH r AS (SELECT o_custkey AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT query_id, l_partkey AS doc_id, min(rank) AS rank FROM r JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    ),
    "l14_subgraph_views": (l14_subgraph_views, None),
    "l16_community_details": (
        l16_community_details,
        """WITH s AS (SELECT p_brand AS community, count(*) AS members, count(*) FILTER (p_size < 10) AS seen FROM part GROUP BY 1 HAVING seen > 0),
        r AS (SELECT l_orderkey AS relation, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1),
        i AS (SELECT x.p_brand AS community, count(*) AS relations FROM r JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b WHERE x.p_brand = y.p_brand GROUP BY 1),
        c AS (SELECT p_brand AS community, l_orderkey, bool_and(s_nationkey < 20) AS whole FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
        n AS (SELECT community, count(*) AS claims FROM c WHERE whole GROUP BY 1)
        SELECT community, members, seen, coalesce(relations, 0) AS relations, coalesce(claims, 0) AS claims FROM s LEFT JOIN i USING (community) LEFT JOIN n USING (community)""",
    ),
    "l20_entity_details": (
        l20_entity_details,
        """WITH v AS (SELECT l_partkey AS entity, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')),
        m AS (SELECT entity, count(*) AS mention_count FROM v GROUP BY 1), r AS (SELECT entity, l_suppkey, count(*) AS n FROM v GROUP BY ALL),
        t AS (SELECT entity, count(*) AS relation_count, arg_min(entity || '-' || l_suppkey, (-n, entity || '-' || l_suppkey)) AS strongest FROM r GROUP BY entity),
        a AS (SELECT p_partkey AS entity, '[' || string_agg('{"alias":"' || x || '"}', ',' ORDER BY x) || ']' AS aliases FROM (SELECT DISTINCT p_partkey, unnest([p_brand, p_type]) AS x FROM part) GROUP BY 1)
        SELECT entity, aliases, mention_count, relation_count, least(3, mention_count) AS shown, strongest FROM m JOIN t USING (entity) JOIN a USING (entity)""",
    ),
    "p3_history_context": (p3_history_context, None),
    "q9_metric_deltas": (
        q9_metric_deltas,
        """WITH f AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 5 <> 0) AS first, count(*) FILTER (event_id % 5 <> 0) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), s AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 5 <> 0) AS second, count(*) FILTER (event_id % 5 <> 0) AS m FROM events WHERE user_id % 2 = 1 GROUP BY 1)
        SELECT metric, round(first, 9) AS first, round(second, 9) AS second, round(second - first, 9) AS delta, coalesce(n, 0) AS first_measured, coalesce(m, 0) AS second_measured FROM f FULL JOIN s USING (metric)""",
    ),
    "q9_slice_deltas": (
        q9_slice_deltas,
        """WITH o AS (SELECT year(o_orderdate) % 2 AS y, CASE o_orderstatus WHEN 'O' THEN 'S' WHEN 'F' THEN 'F' ELSE 'B' END AS status, o_orderpriority, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey),
        x AS (SELECT y, status, 'language' AS dimension, o_orderpriority AS value FROM o UNION ALL SELECT y, status, 'case_type', c_mktsegment FROM o)
        SELECT dimension, value, count(*) FILTER (y = 0 AND status = 'S') AS first_succeeded, count(*) FILTER (y = 0 AND status = 'F') AS first_failed, count(*) FILTER (y = 0 AND status = 'B') AS first_blocked,
        count(*) FILTER (y = 1 AND status = 'S') AS second_succeeded, count(*) FILTER (y = 1 AND status = 'F') AS second_failed, count(*) FILTER (y = 1 AND status = 'B') AS second_blocked FROM x GROUP BY ALL""",
    ),
}
