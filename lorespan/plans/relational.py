"""Queries of joins, aggregates, windows, paging and set operations (D to H), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import relational as X
from lorespan.sources.tables import read

_c = F.col

QUERIES = {
    "d1_inner_join": (
        lambda s, d: read(s, d, "orders").join(read(s, d, "customer"), _c("o_custkey") == _c("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
        "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    ),
    "d2_left_join": (
        lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled")),
        "SELECT lang, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    ),
    "d3_semi_join": (lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), _c("o_custkey") == _c("c_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "d4_anti_join": (lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "d5_broken_closure": (
        lambda s, d: read(s, d, "lineitem").join(read(s, d, "part").select("p_partkey"), _c("l_partkey") == _c("p_partkey"), "left").join(read(s, d, "supplier").select("s_suppkey"), _c("l_suppkey") == _c("s_suppkey"), "left").groupBy("l_orderkey").agg(F.count_if(_c("p_partkey").isNull() | _c("s_suppkey").isNull()).alias("broken")).filter("broken = 0").select("l_orderkey"),
        "SELECT l_orderkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey HAVING count(*) FILTER (p_partkey IS NULL OR s_suppkey IS NULL) = 0",
    ),
    "d6_ordered_first_last": (
        lambda s, d: X.first_last(read(s, d, "lineitem"), ["l_orderkey"], "l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey"), ("first_part", "last_part")),
        "SELECT l_orderkey, (array_agg(l_partkey ORDER BY l_shipdate, l_linenumber, l_partkey))[1] AS first_part, (array_agg(l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC))[1] AS last_part FROM lineitem GROUP BY ALL",
    ),
    "d7_lateral_top3": (
        lambda s, d: X.first_by(read(s, d, "lineitem"), ["l_partkey"], [_c("l_extendedprice").desc(), _c("l_orderkey"), _c("l_linenumber")], 3, "rank").select("l_partkey", "l_orderkey", "l_linenumber", "rank"),
        "SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3",
    ),
    "d9_array_unnest_join": (
        lambda s, d: read(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total")),
        "SELECT 'k' AS key, count(*) AS n, sum(CAST(props->>'k' AS INT)) AS total FROM events",
    ),
    "d10_either_endpoint": (
        lambda s, d: X.either_endpoint(read(s, d, "lineitem").select(_c("l_partkey").alias("a"), _c("l_suppkey").alias("b")).distinct(), "a", "b").groupBy("node", "direction").agg(F.count("*").alias("degree")),
        "WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT node, direction, count(*) AS degree FROM (SELECT a AS node, 'OUT' AS direction FROM e UNION ALL SELECT b, 'IN' FROM e) GROUP BY ALL",
    ),
    "d15_merge_maps": (
        lambda s, d: X.merge_maps(*[read(s, d, "events").filter(_c("event_type") == t).groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("v")) for t in ("click", "purchase")], "user_id", "v"),
        "WITH x AS (SELECT user_id, round(sum(value), 4) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), y AS (SELECT user_id, round(sum(value), 4) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT user_id, coalesce(x.v, 0.0) AS a, coalesce(y.v, 0.0) AS b, round(coalesce(y.v, 0.0) - coalesce(x.v, 0.0), 6) AS delta FROM x FULL JOIN y USING (user_id)",
    ),
    "d17_first_anchor": (
        lambda s, d: X.first_by(read(s, d, "documents").withColumn("key", F.md5(F.trim("text"))), ["key"], [_c("doc_id")]).select("key", "doc_id"),
        "SELECT md5(trim(text)) AS key, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
    ),
    "e1_grouped_aggregates": (
        lambda s, d: read(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("most"), F.min("l_extendedprice").alias("least"), F.round(F.avg("l_discount"), 6).alias("discount")),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS most, min(l_extendedprice) AS least, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL",
    ),
    "e2_filtered_aggregates": (
        lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.count_if(_c("event_type") == "error").alias("errors"), F.round(F.avg(F.when(_c("event_type") == "purchase", _c("value"))), 6).alias("mean_purchase")),
        "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, round(avg(value) FILTER (event_type = 'purchase'), 6) AS mean_purchase FROM events GROUP BY ALL",
    ),
    "e3_count_distinct": (lambda s, d: read(s, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts")), "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL"),
    "e5_sorted_distinct": (lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types")), "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY ALL"),
    "e7_status_ladder": (
        lambda s, d: read(s, d, "orders").groupBy("o_custkey").agg(F.when(F.bool_or(_c("o_orderstatus") == "F"), "FAILED").when(F.bool_or(_c("o_orderstatus") == "P"), "PENDING").otherwise("OPEN").alias("status")),
        "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'FAILED' WHEN bool_or(o_orderstatus = 'P') THEN 'PENDING' ELSE 'OPEN' END AS status FROM orders GROUP BY ALL",
    ),
    "e9_percentile_cont": (
        lambda s, d: X.percentiles_cont(read(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")),
        "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL",
    ),
    "e10_nearest_rank": (
        lambda s, d: X.percentiles_by_counts(read(s, d, "events"), ["event_type"], "value", 0.95, "p95"),
        "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) AS p95 FROM r WHERE i >= ceil(0.95 * n) GROUP BY ALL",
    ),
    "e11_floor_rank": (
        lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(X.floor_rank("turn", 0.95).alias("p95")),
        "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn AS p95 FROM r WHERE i = floor((n - 1) * 0.95) + 1",
    ),
    "e12_safe_ratio": (
        lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.round(X.ratio(F.count_if(_c("event_type") == "error"), F.count_if(_c("event_type") == "click")), 6).alias("rate")),
        "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') = 0 THEN 0.0 ELSE round(count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type = 'click'), 6) END AS rate FROM events GROUP BY ALL",
    ),
    "e13_slice_counts": (
        lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id").groupingSets([["lang", "quality"], ["source", "quality"]], "lang", "source", "quality").agg(F.count("*").alias("n")),
        "SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (source, quality))",
    ),
    "e14_json_sums": (lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k")), "SELECT event_type, sum(CAST(props->>'k' AS INT)) AS k FROM events GROUP BY ALL"),
    "e16_set_hash": (
        lambda s, d: X.set_hash(read(s, d, "documents"), ["lang"], F.concat_ws("|", "doc_id", "source", F.lit("\n")), "digest"),
        "SELECT lang, sha256(string_agg(concat_ws('|', doc_id, source, chr(10)), '' ORDER BY concat_ws('|', doc_id, source, chr(10)))) AS digest FROM documents GROUP BY ALL",
    ),
    "e17_edge_merge": (
        lambda s, d: read(s, d, "orders").select(F.least("o_orderkey", "o_custkey").alias("a"), F.greatest("o_orderkey", "o_custkey").alias("b"), "o_totalprice").groupBy("a", "b").agg(F.round(F.sum("o_totalprice"), 2).alias("weight")),
        "SELECT least(o_orderkey, o_custkey) AS a, greatest(o_orderkey, o_custkey) AS b, round(sum(o_totalprice), 2) AS weight FROM orders GROUP BY ALL",
    ),
    "e20_access_summary": (
        lambda s, d: read(s, d, "customer").select("c_custkey", "c_mktsegment").join(read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("owned")), _c("c_custkey") == _c("o_custkey"), "left").select("c_custkey", F.coalesce("owned", F.lit(0)).alias("owned"), (_c("c_mktsegment") == "BUILDING").alias("admin")),
        "SELECT c_custkey, coalesce(owned, 0) AS owned, c_mktsegment = 'BUILDING' AS admin FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS owned FROM orders GROUP BY ALL) ON c_custkey = o_custkey",
    ),
    "e21_derived_key": (lambda s, d: read(s, d, "part").groupBy(F.coalesce(F.nullif(_c("p_type"), F.lit("ECONOMY")), _c("p_brand")).alias("key")).agg(F.count("*").alias("n")), "SELECT coalesce(nullif(p_type, 'ECONOMY'), p_brand) AS key, count(*) AS n FROM part GROUP BY ALL"),
    "e22_dashboard": (
        lambda s, d: read(s, d, "documents").filter("lang = 'de'").agg(F.count("*").alias("n")).select(F.lit("german").alias("item"), "n").unionByName(read(s, d, "events").filter("event_type = 'error'").agg(F.count("*").alias("n")).select(F.lit("errors").alias("item"), "n")).unionByName(read(s, d, "orders").filter("o_totalprice < 0").agg(F.count("*").alias("n")).select(F.lit("negative").alias("item"), "n")).filter("n > 0"),
        "SELECT * FROM (SELECT 'german' AS item, count(*) AS n FROM documents WHERE lang = 'de' UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'negative', count(*) FROM orders WHERE o_totalprice < 0) WHERE n > 0",
    ),
    "f1_latest_per_group": (lambda s, d: X.first_by(read(s, d, "events"), ["user_id", "event_type"], [_c("ts").desc(), _c("event_id")]).select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1"),
    "f2_running_before": (
        lambda s, d: X.running_before(read(s, d, "conversations").withColumn("n", F.length("text").cast("long")), ["conv_id"], [_c("turn")], "n", "before").select("conv_id", "turn", "before"),
        "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations",
    ),
    "f4_hash_sample": (
        lambda s, d: X.first_by(read(s, d, "documents").withColumn("h", F.sha2(_c("doc_id").cast("string"), 256)), ["lang"], [_c("h")], 10).select("lang", "doc_id"),
        "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 10",
    ),
    "f5_lag_default": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.expr("lag(length(text), 1, 0) OVER (PARTITION BY conv_id ORDER BY turn)").cast("long").alias("previous")),
        "SELECT conv_id, turn, lag(length(text), 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations",
    ),
    "f6_islands": (
        lambda s, d: X.islands(read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")), ["doc_id"], "i", (_c("i") == 0) | (F.length("line") < 40), "block").groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")),
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), b AS (SELECT *, sum(CASE WHEN i = 1 OR length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l) SELECT doc_id, block, count(*) AS lines, sum(length(line)) AS chars FROM b GROUP BY ALL",
    ),
    "g1_top_k": (lambda s, d: read(s, d, "orders").orderBy(_c("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "g2_page": (lambda s, d: X.page(read(s, d, "orders").select("o_orderkey", "o_orderdate"), [_c("o_orderdate").desc(), _c("o_orderkey")], 3, 20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 60"),
    "g4_keyset_page": (lambda s, d: X.page_after(read(s, d, "part").select("p_type", "p_name", "p_partkey"), ["p_type", "p_name", "p_partkey"], ("PROMO", "green gear", 0), 25), "SELECT p_type, p_name, p_partkey FROM part WHERE (p_type, p_name, p_partkey) > ('PROMO', 'green gear', 0) ORDER BY ALL LIMIT 26"),
    "h1_union_all": (lambda s, d: read(s, d, "documents").select(F.lit("doc").alias("kind"), _c("doc_id").alias("id")).unionByName(read(s, d, "pages").select(F.lit("page").alias("kind"), _c("page_id").alias("id"))).groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last")), "SELECT kind, count(*) AS n, max(id) AS last FROM (SELECT 'doc' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'page', page_id FROM pages) GROUP BY ALL"),
    "h3_union_distinct": (lambda s, d: read(s, d, "customer").select(_c("c_nationkey").alias("n")).union(read(s, d, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "h4_set_sizes": (
        lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"), F.array_distinct(F.flatten(F.collect_list(F.split(F.lower("text"), " ")))).alias("w")).select("conv_id", F.size("r").alias("roles"), F.size(F.array_intersect("w", F.array(F.lit("the"), F.lit("la"), F.lit("der")))).alias("common")),
        "SELECT conv_id, count(DISTINCT role) AS roles, count(DISTINCT w) FILTER (w IN ('the', 'la', 'der')) AS common FROM (SELECT conv_id, role, unnest(string_split(lower(text), ' ')) AS w FROM conversations) GROUP BY ALL",
    ),
    "h5_set_difference": (lambda s, d: read(s, d, "documents").select("doc_id").exceptAll(read(s, d, "labels").select("doc_id")), "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
    "h6_first_wins": (lambda s, d: read(s, d, "documents").groupBy(F.lower(F.substring("text", 1, 20)).alias("head")).agg(F.min("doc_id").alias("doc_id")), "SELECT lower(left(text, 20)) AS head, min(doc_id) AS doc_id FROM documents GROUP BY ALL"),
}
