"""Queries of evidence, access, resolution, history and release operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import evidence as E
from lorespan.operators import relational as X
from lorespan.sources.tables import read

_c = F.col
_W = r"list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+'))"


def _turns(s, d):
    """Each assistant turn with the user turn before it."""
    t = read(s, d, "conversations")
    return t.filter("role = 'assistant'").select("conv_id", "turn", _c("text").alias("answer")).join(t.filter("role = 'user'").select("conv_id", (_c("turn") + 1).alias("turn"), _c("text").alias("question")), ["conv_id", "turn"])


_TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user')"


def _spans(s, d):
    return _turns(s, d).select((_c("conv_id") * 1000 + _c("turn")).alias("id"), "answer", "question", F.posexplode(F.split("answer", "\n")).alias("span_order", "span"))


def _chunks(s, d):
    return read(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((_c("n_chars") - 1) / 300))).alias("chunk"), "n_chars").select("doc_id", "chunk", (_c("chunk") * 300).alias("first"), F.least((_c("chunk") + 1) * 300, _c("n_chars")).alias("last"))


def _marks(s, d):
    return read(s, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((_c("n_chars") - 1) / 700))).alias("span"), "n_chars").select("doc_id", "span", (_c("span") * 700).alias("a"), F.least((_c("span") + 1) * 700, _c("n_chars")).alias("b"))


QUERIES = {
    "c11_terms_filter": (lambda s, d: read(s, d, "documents").join(read(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "e6_distinct_string": (lambda s, d: read(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities")), "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY ALL"),
    "e8_json_build": (lambda s, d: read(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names")), "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY ALL"),
    "e18_metric_summary": (lambda s, d: read(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n")), "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY ALL"),
    "e19_overlapping_slices": (
        lambda s, d: read(s, d, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.lit("all"))).alias("slice")).join(read(s, d, "labels"), "doc_id").groupBy("slice").agg(F.round(F.avg("quality"), 6).alias("quality")),
        "SELECT slice, round(avg(quality), 6) AS quality FROM (SELECT doc_id, unnest(['lang:' || lang, 'source:' || source, 'all']) AS slice FROM documents) JOIN labels USING (doc_id) GROUP BY ALL",
    ),
    "f3_priority_pick": (
        lambda s, d: X.first_by(read(s, d, "orders"), ["o_custkey"], [F.when(_c("o_orderstatus") == "F", 0).when(_c("o_orderstatus") == "O", 1).otherwise(2), _c("o_orderdate").desc(), _c("o_orderkey")]).select("o_custkey", "o_orderkey"),
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1",
    ),
    "f9_distinct_on": (lambda s, d: X.first_by(read(s, d, "part"), ["p_brand"], [_c("p_retailprice").desc(), _c("p_partkey")]).select("p_brand", "p_partkey"), "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey"),
    "g5_mixed_sort": (lambda s, d: read(s, d, "supplier").orderBy(_c("s_nationkey").asc(), _c("s_acctbal").desc(), "s_suppkey").limit(40).select("s_suppkey"), "SELECT s_suppkey FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 40"),
    "h2_event_union": (
        lambda s, d: read(s, d, "events").select(F.lit("event").alias("origin"), _c("user_id").alias("actor"), _c("event_type").alias("action"), F.lit(None).cast("double").alias("amount")).unionByName(read(s, d, "orders").select(F.lit("order").alias("origin"), _c("o_custkey").alias("actor"), _c("o_orderstatus").alias("action"), _c("o_totalprice").alias("amount"))).groupBy("origin", "action").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")),
        "SELECT origin, action, count(*) AS n, round(sum(amount), 2) AS amount FROM (SELECT 'event' AS origin, event_type AS action, NULL::DOUBLE AS amount FROM events UNION ALL SELECT 'order', o_orderstatus, o_totalprice FROM orders) GROUP BY ALL",
    ),
    "i9_bridge_terms": (
        lambda s, d: E.bridge_terms(read(s, d, "documents").select(_c("doc_id").alias("id"), "text"), 5),
        "WITH f AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}')) AS term, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}'), 1) - 1 AS i FROM documents), s AS (SELECT id, term, max(150 - i) AS score FROM f GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5",
    ),
    "i21_duration_ms": (lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.expr("(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP))) div 1000").alias("ms")), "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS ms FROM events GROUP BY ALL"),
    "i23_csv_membership": (lambda s, d: read(s, d, "part").select("p_partkey", F.array_contains(F.split("p_name", " "), "red").alias("red")), "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS red FROM part"),
    "i25_truncate_around": (
        lambda s, d: read(s, d, "documents").select("doc_id", F.md5(E.truncate_around(_c("text"), F.lit("icense"), 120)).alias("digest")),
        "WITH a AS (SELECT doc_id, text, greatest(instr(text, 'icense'), 1) AS pos FROM documents), b AS (SELECT *, CAST(greatest(1, least(pos - 57, length(text) - 119)) AS INT) AS start FROM a) SELECT doc_id, md5(CASE WHEN length(text) <= 120 THEN text ELSE (CASE WHEN start > 1 THEN '…' ELSE '' END) || substr(text, start, 120) || (CASE WHEN start + 120 <= length(text) THEN '…' ELSE '' END) END) AS digest FROM b",
    ),
    "i26_bounded_path": (lambda s, d: read(s, d, "pages").select("page_id", E.bounded_path(F.concat("url", F.lit("#"), "html")).alias("path")), "SELECT page_id, CASE WHEN length(url || '#' || html) > 450 THEN left(url || '#' || html, 380) || '/…/' || left(sha256(url || '#' || html), 32) ELSE url || '#' || html END AS path FROM pages"),
    "j6_retrieval_score": (
        lambda s, d: read(s, d, "part").select("p_partkey", F.round(E.retrieval_score(_c("p_retailprice"), 1 / (60.0 + _c("p_size")), _c("p_size") % 3, F.when(_c("p_size") > 25, _c("p_size"))), 6).alias("score")),
        "SELECT p_partkey, round(CASE WHEN p_size % 3 = 1 AND p_size <= 25 THEN p_retailprice ELSE 1 / (60.0 + p_size) END, 6) AS score FROM part",
    ),
    "j16_rerank_text": (lambda s, d: read(s, d, "documents").select("doc_id", F.md5(F.array_join(F.array_distinct(F.filter(F.array("source", "lang", F.trim("text")), lambda x: F.trim(x) != "")), "\n")).alias("digest")), "SELECT doc_id, md5(source || chr(10) || lang || chr(10) || trim(text)) AS digest FROM documents"),
    "j20_degradation": (lambda s, d: read(s, d, "events").groupBy("user_id").agg(E.degradation(F.when(F.count_if(F.expr("event_type = 'error'")) > 15, F.lit("ERRORS")), F.when(F.max("value") > 60, F.lit("SLOW"))).alias("codes")), "SELECT user_id, concat_ws('+', CASE WHEN count(*) FILTER (event_type = 'error') > 15 THEN 'ERRORS' END, CASE WHEN max(value) > 60 THEN 'SLOW' END) AS codes FROM events GROUP BY ALL"),
    "k4_span_projection": (
        lambda s, d: E.overlapping_spans(_chunks(s, d), _marks(s, d)),
        "WITH c AS (SELECT doc_id, unnest(range(0, (n_chars - 1) // 300 + 1)) AS chunk, n_chars FROM documents), m AS (SELECT doc_id, unnest(range(0, (n_chars - 1) // 700 + 1)) AS span, n_chars FROM documents), x AS (SELECT doc_id, chunk, chunk * 300 AS first, least((chunk + 1) * 300, n_chars) AS last FROM c), y AS (SELECT doc_id, span, span * 700 AS a, least((span + 1) * 700, n_chars) AS b FROM m) SELECT doc_id, chunk, span, greatest(a, first) - first AS start, least(b, last) - first AS stop FROM x JOIN y USING (doc_id) WHERE a < last AND first < b",
    ),
    "p6_memory_relevance": (
        lambda s, d: _turns(s, d).select("conv_id", "turn", F.round(E.overlap_ratio(F.array_distinct(E.words(_c("question"))), F.array_distinct(E.words(_c("answer")))), 6).alias("relevance")),
        f"WITH {_TURNS}, w AS (SELECT conv_id, turn, {_W.format('question')} AS q, {_W.format('answer')} AS a FROM t) SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, a)) / len(q), 6) END AS relevance FROM w",
    ),
    "p8_citation_spans": (
        lambda s, d: E.best_span(_spans(s, d)),
        f"WITH {_TURNS}, x AS (SELECT conv_id * 1000 + turn AS id, answer, question, unnest(string_split(answer, chr(10))) AS span, generate_subscripts(string_split(answer, chr(10)), 1) - 1 AS span_order FROM t), c AS (SELECT id, span_order, 4 * len(list_intersect({_W.format('span')}, {_W.format('answer')})) + len(list_intersect({_W.format('span')}, {_W.format('question')})) AS score FROM x) SELECT id, span_order, score FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, span_order) = 1",
    ),
}
