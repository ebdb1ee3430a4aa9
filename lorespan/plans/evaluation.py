"""Queries of evaluation, history and memory operators over inputs derived from the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorespan.functions.text import answer_text
from lorespan.operators import evaluation as E
from lorespan.operators import history as H
from lorespan.operators import search as Q
from lorespan.sources.tables import read

_c = F.col


def _candidates(s, d):
    """Documents as candidates of the case of their remainder by 40; stages miss some by their length."""
    n = _c("n_chars")
    return read(s, d, "documents").select(
        (_c("doc_id") % 40).alias("case_id"), _c("doc_id").alias("revision_id"), F.when(n % 3 != 0, n).alias("bm25_rank"), F.when(n % 4 != 0, n).alias("vector_rank"), F.when(n % 5 < 3, n).alias("rerank_rank"), (n % 5 == 0).alias("accepted")
    ).filter("revision_id % 7 <> 0")


def _good(s, d):
    return read(s, d, "labels").filter("quality = 1").select((_c("doc_id") % 40).alias("case_id"), _c("doc_id").alias("revision_id"))


_GOOD = "good AS (SELECT doc_id % 40 AS case_id, doc_id AS revision_id FROM labels WHERE quality = 1)"


def q1_stage_recall(s, d):
    return E.stage_recall(_candidates(s, d), _good(s, d))


def _facts(s, d):
    """A fact an order, as long as its lines' quantities; spans follow one another, and every fourth line begins a little late."""
    lines = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(_c("l_quantity").cast("long")).alias("q"), F.max("l_partkey").alias("p"))
    upto = F.sum("q").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    spans = lines.select(_c("l_orderkey").alias("fact_id"), (upto - _c("q") + F.when(_c("p") % 4 == 0, 2).otherwise(0)).alias("first"), (upto + F.when(_c("p") % 3 == 0, 2).otherwise(0)).alias("last"))
    return lines.groupBy(_c("l_orderkey").alias("fact_id")).agg(F.sum("q").alias("length")), spans


def q2_span_coverage(s, d):
    return E.covered_facts(*_facts(s, d))


def q3_graph_recall(s, d):
    docs = read(s, d, "documents").select((_c("doc_id") % 40).alias("case_id"), "doc_id", "n_chars")
    return E.graph_recall(_good(s, d).withColumnRenamed("revision_id", "doc_id"), docs.filter("n_chars % 4 = 0"), docs.filter("n_chars % 3 = 0"))


def q4_exact_match(s, d):
    t = read(s, d, "conversations")
    return E.exact_match(t.select((_c("conv_id") * 100 + _c("turn")).alias("case_id"), _c("text").alias("answer"), F.upper("text").alias("reference")).unionByName(t.select((-_c("conv_id") * 100 - _c("turn") - 1).alias("case_id"), _c("text").alias("answer"), F.concat("text", F.lit(" more")).alias("reference"))), answer_text)


def q7_context_quality(s, d):
    docs = read(s, d, "documents").select((_c("doc_id") % 40).alias("query_id"), (1 + F.floor(_c("doc_id") / 40)).alias("rank"), "doc_id")
    return E.context_quality(docs, _good(s, d).select(_c("case_id").alias("query_id"), _c("revision_id").alias("doc_id")))


_TYPES = ("RETRIEVAL", "LOCAL_GRAPH", "GLOBAL_GRAPH", "ANSWER_CITATION", "MULTI_TURN", "INTENT", "MULTIFORMAT_RELEASE", "MULTIFORMAT_SECURITY")


def _results(s, d):
    """A result an order: its type by its key; the metrics of its type are measured, but for a missing or a failed one now and then."""
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (_c("o_orderkey") % 8 + 1).cast("int"))
    results = read(s, d, "orders").select(_c("o_orderkey").alias("result_id"), kind.alias("case_type"), _c("o_custkey").alias("run_id"))
    keys = results.join(F.broadcast(E.hard_metric_sets(s)), "case_type").select("result_id", F.posexplode("required").alias("i", "metric_key"))
    metrics = keys.filter("NOT (result_id % 11 = 0 AND i = 0)").select("result_id", "metric_key", F.lit("MEASURED").alias("status"), F.when((_c("result_id") % 7 == 0) & (_c("i") == 0), 0.5).otherwise(1.0).alias("value"))
    return results, metrics


def q19_required_metrics(s, d):
    results, metrics = _results(s, d)
    return E.hard_gates(results, metrics, E.hard_metric_sets(s))


def q8_hard_gate(s, d):
    results, metrics = _results(s, d)
    gates = E.hard_gates(results, metrics, E.hard_metric_sets(s)).join(results.select("result_id", "run_id"), "result_id")
    runs = read(s, d, "customer").join(read(s, d, "orders").groupBy(_c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left")
    n = F.coalesce("n", F.lit(0))
    runs = runs.select(_c("c_custkey").alias("run_id"), F.when(_c("c_custkey") % 9 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"), (n + (_c("c_custkey") % 5 == 0).cast("int")).alias("total_cases"), F.when(_c("c_custkey") % 6 == 0, 1).otherwise(0).alias("failed_cases"))
    return E.gate_summary(runs, gates)


def q10_release_stats(s, d):
    e = read(s, d, "events")
    failures = e.groupBy(_c("event_type").alias("key")).agg(F.count_if(_c("value") < 5).alias("failed"), F.count("*").alias("total"))
    stats = E.release_stats(e.select(_c("event_type").alias("key"), F.round("value").cast("long").alias("value")), failures)
    return stats


def q11_retrieval_report(s, d):
    """Orders as cases."""
    o = read(s, d, "orders").select(_c("o_orderkey").alias("case_id"), (_c("o_orderkey") % 2).cast("double").alias("quality"), (_c("o_custkey") % 5 / 4).alias("recall"), F.floor(_c("o_totalprice") / 1000).alias("duration"), (_c("o_orderkey") % 13 == 0).alias("degraded"), "o_custkey")
    return E.retrieval_report(o, {"all": F.lit(True), "even": _c("o_custkey") % 2 == 0, "few": _c("o_custkey") < 10, "none": F.lit(False)})


def q12_route_accuracy(s, d):
    e = read(s, d, "events")
    return E.intent_routes(e.select(_c("event_type").alias("case_type"), F.when(_c("user_id") % 2 == 0, "HYBRID").otherwise("LOCAL_GRAPH").alias("expected"), F.when(_c("user_id") % 3 == 0, "LOCAL_GRAPH").when(_c("user_id") % 3 == 1, "HYBRID").alias("selected"), (_c("event_id") % 3).alias("planner_calls"), (_c("event_id") % 2).alias("rewrite_calls")))


def q13_observability(s, d):
    e = read(s, d, "events").select(_c("event_type").alias("kind"), "ts", F.when(_c("value") < 10, "FAILED").when(_c("value") > 95, "RUNNING").otherwise("SUCCEEDED").alias("status"), F.floor("value").alias("duration"), (_c("user_id") % 4 == 0).alias("cached"))
    return E.observability(e, F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"))


def q14_multi_turn(s, d):
    t = read(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.struct("turn", "text"))["text"].alias("last"))
    cases = t.select(_c("conv_id").alias("case_id"), (_c("n") > 2).alias("history_required"), (_c("n") % 4).alias("history_messages"), _c("last").alias("rewritten"), (_c("n") % 6).alias("query_budget"), F.array(_c("conv_id") % 3).alias("cited"), F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("offered"))
    return E.multi_turn_gates(cases)


def q15_release_gates(s, d):
    docs = read(s, d, "documents")
    return E.release_gates(docs.select(_c("doc_id").alias("case_id"), F.md5("text").alias("expected_hash"), F.md5(F.when(_c("lang") == "fr", F.upper("text")).otherwise(_c("text"))).alias("actual_hash"), (_c("source") != "src1").alias("authorised"), _c("lang").alias("parser"), F.when(_c("n_chars") % 3 == 0, "en").otherwise(_c("lang")).alias("required_parser"), F.when(_c("n_chars") > 300, 1).alias("unit"), (_c("n_chars") % 12).alias("retrieved_rank"), F.when(_c("n_chars") % 2 == 0, _c("n_chars") % 4 == 0).alias("cited")))


def q17_fact_import(s, d):
    """The sentences of each document as its corpus; facts quote every second one, some past the end, changed, or twice."""
    docs = read(s, d, "documents")
    corpus = docs.filter("n_chars % 17 <> 0").select(_c("doc_id").alias("evidence_key"), F.split("text", r"\. ").alias("sentences"))
    quoted = docs.select("doc_id", "n_chars", F.posexplode(F.split("text", r"\. ")).alias("i", "t")).filter("i % 2 = 0")
    number = F.when(_c("n_chars") % 5 == 0, _c("i") - 1).when((_c("n_chars") % 5 == 1) & (_c("i") == 2), 0).otherwise(_c("i"))
    sentence = F.when((_c("n_chars") % 5 == 1) & (_c("i") == 2), F.lit(None).cast("string")).otherwise(_c("t"))
    facts = quoted.select(_c("doc_id").alias("case_id"), F.floor(_c("i") / 2).alias("ordinal"), _c("doc_id").alias("evidence_key"), number.alias("sentence_id"), F.coalesce(sentence, F.lit("changed")).alias("sentence"))
    gapped = facts.filter("NOT (case_id % 6 = 0 AND ordinal = 1)")
    return E.fact_contract(gapped, corpus, lambda c: F.regexp_replace(c, "\r\n?", "\n")).select("case_id", _c("ordinal").cast("long").alias("ordinal"), "fault")


def d16_changed_cases(s, d):
    l = read(s, d, "labels")  # noqa: E741
    return E.changed_cases(l.select(_c("doc_id").alias("case_key"), _c("quality").alias("status")), l.select(_c("doc_id").alias("case_key"), (1 - _c("toxic")).alias("status")))


def c13_coverage(s, d):
    n = read(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", Q.coverage_sufficient(_c("n"), 4).alias("sufficient"), Q.coverage_sufficient(_c("n") - 3, 0).alias("with_none_wanted"))


def _runs(s, d):
    """Each turn's run: refused or failed now and then, citations by its words' number, memory in some."""
    t = read(s, d, "conversations").withColumn("run_id", F.when(_c("turn") % 5 != 4, _c("conv_id") * 100 + _c("turn"))).withColumn("run_status", F.when(_c("turn") % 7 == 3, "REFUSED").when(_c("turn") % 7 == 5, "FAILED").otherwise("COMPLETED"))
    citations = t.filter("run_id IS NOT NULL AND length(text) % 4 <> 0").select("run_id", (F.length("text") % 3 != 0).alias("available"))
    memories = t.filter("run_id IS NOT NULL AND length(text) % 5 = 0").select("run_id", F.when(F.length("text") % 2 == 0, "USED").otherwise("TRIMMED").alias("usage"), (_c("conv_id") % 2 == 0).alias("available"))
    return t, citations, memories


_RUNS = """t AS (SELECT *, CASE WHEN turn % 5 <> 4 THEN conv_id * 100 + turn END AS run_id, CASE WHEN turn % 7 = 3 THEN 'REFUSED' WHEN turn % 7 = 5 THEN 'FAILED' ELSE 'COMPLETED' END AS run_status FROM conversations),
src AS (SELECT run_id, bool_and(ok) AS current, bool_or(m) AS used_memory FROM (SELECT run_id, length(text) % 3 <> 0 AS ok, false AS m FROM t WHERE run_id IS NOT NULL AND length(text) % 4 <> 0 UNION ALL SELECT run_id, conv_id % 2 = 0, true FROM t WHERE run_id IS NOT NULL AND length(text) % 5 = 0 AND length(text) % 2 = 0) GROUP BY run_id)"""


def p11_answer_sources(s, d):
    _, citations, memories = _runs(s, d)
    return H.answer_sources(citations, memories)


def p1_eligible_history(s, d):
    t, citations, memories = _runs(s, d)
    return H.eligible_history(t, H.answer_sources(citations, memories)).select("conv_id", "turn", "role")


def _items(s, d):
    """Orders as memory items of customers, with their lines as sources."""
    o = read(s, d, "orders").select(_c("o_orderkey").alias("item_id"), _c("o_custkey").alias("owner"), F.element_at(F.array(F.lit("USER_FACT"), F.lit("DOCUMENT_FACT"), F.lit("USER_PREFERENCE"), F.lit("OTHER")), (_c("o_orderkey") % 4 + 1).cast("int")).alias("kind"), F.when(_c("o_orderkey") % 9 == 0, "DELETED").otherwise("ACTIVE").alias("status"), F.when(_c("o_orderkey") % 5 == 0, _c("o_orderdate").cast("timestamp_ntz")).alias("expires_at"), _c("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    sources = read(s, d, "lineitem").filter("l_linenumber <= 2").select(_c("l_orderkey").alias("item_id"), _c("l_partkey").alias("doc_id"), (_c("l_partkey") % 2).alias("revision_id")).filter("item_id % 3 <> 0")
    return o, sources


def p5_memory_candidates(s, d):
    items, sources = _items(s, d)
    # what an owner may see is asked for the documents of their items only
    asked = sources.join(items.select("item_id", "owner"), "item_id").select("owner", "doc_id").distinct()
    visible = asked.join(read(s, d, "part").filter("p_partkey % 10 < 7").select(_c("p_partkey").alias("doc_id"), (_c("p_partkey") % 2).alias("revision_id")), "doc_id")
    return H.memory_candidates(items, sources, visible, F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'"), 5).select("owner", "item_id", _c("place").cast("long").alias("place"))


def c12_relevant_memory(s, d):
    items, _ = _items(s, d)
    return items.select("item_id", H.relevant_memory(_c("kind"), _c("item_id") % 4, _c("item_id") % 30 / 100).alias("relevant"))


def p9_segments(s, d):
    t = read(s, d, "conversations")
    segments = t.select(_c("conv_id").alias("run_id"), _c("turn").alias("segment"), "text", F.when(_c("turn") % 4 != 3, F.array((_c("turn") % 3).cast("long"), F.lit(0).cast("long"))).alias("citation_ids"), F.when(_c("turn") % 2 == 0, F.array((_c("conv_id") % 2).cast("long"))).alias("memory_ids"))
    ids = t.select(_c("conv_id").alias("run_id")).distinct()
    citations = ids.select("run_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("id"))
    return H.eligible_segments(segments, citations, ids.select("run_id", F.lit(0).cast("long").alias("id")), 300).select("run_id", "segment", F.md5("text").alias("digest"), F.array_join("citation_ids", ",").alias("ids"))


def p10_summaries(s, d):
    t = read(s, d, "conversations").select("conv_id", _c("turn").alias("message_id"), _c("turn").alias("sequence"), "text")
    old = t.filter("message_id < 3").select("conv_id", "message_id", "sequence", F.sha2(F.when((_c("conv_id") % 3 == 0) & (_c("message_id") == 1), F.lit("changed since")).otherwise(_c("text")), 256).alias("content_hash"))
    new = t.filter("message_id >= 1 AND conv_id % 2 = 0").select("conv_id", "message_id", "sequence", F.sha2("text", 256).alias("content_hash"))
    summaries = t.groupBy("conv_id").agg(F.count("*").alias("source_count"))
    return H.current_summaries(summaries, H.merge_sources(old, new), t)


def p12_attached_context(s, d):
    lines = read(s, d, "lineitem")
    paths = lines.select(_c("l_orderkey").alias("doc_id"), (_c("l_partkey") % 9).alias("span_id"), _c("l_returnflag").alias("shown"))
    claims = lines.filter("l_quantity > 40").select(_c("l_orderkey").alias("doc_id"), (_c("l_suppkey") % 9).alias("span_id"), _c("l_linestatus").alias("shown"))
    contexts = read(s, d, "orders").select(_c("o_orderkey").alias("doc_id"), F.explode(F.array(_c("o_custkey") % 9, (_c("o_custkey") + 1) % 9)).alias("span_id"))
    return H.attach_context(paths, claims, contexts)


_HARD = " UNION ALL ".join(f"SELECT '{t}' AS case_type, {i} AS k, {sorted(keys)!r} AS required" for i, (t, keys) in enumerate((t, E.HARD_METRICS[t]) for t in _TYPES))
_GATES = f"""sets AS ({_HARD}), r AS (SELECT o_orderkey AS result_id, o_custkey AS run_id, required FROM orders JOIN sets ON k = o_orderkey % 8),
g AS (SELECT result_id, run_id, result_id % 11 <> 0 AS complete, result_id % 11 <> 0 AND result_id % 7 <> 0 AS passed, result_id % 11 = 0 AND len(required) = 1 AS none FROM r)"""
_NEAREST = "(list_sort(list({0})))[CAST(greatest(1, ceil({1} * count({0}))) AS INT)]"

QUERIES = {
    "q1_stage_recall": (
        q1_stage_recall,
        f"""WITH {_GOOD}, c AS (SELECT doc_id AS revision_id, n_chars AS n FROM documents WHERE doc_id % 7 <> 0)
        SELECT case_id, count(*) AS expected, round(count(*) FILTER (n % 3 <> 0) / count(*), 6) AS bm25, round(count(*) FILTER (n % 4 <> 0) / count(*), 6) AS vector, round(count(n) / count(*), 6) AS merged, round(count(*) FILTER (n % 5 < 3) / count(*), 6) AS reranked, round(count(*) FILTER (n % 5 = 0) / count(*), 6) AS accepted FROM good LEFT JOIN c USING (revision_id) GROUP BY case_id""",
    ),
    "q2_span_coverage": (
        q2_span_coverage,
        """WITH l AS (SELECT l_orderkey AS f, l_linenumber AS k, max(CAST(l_quantity AS BIGINT)) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL), u AS (SELECT *, sum(q) OVER (PARTITION BY f ORDER BY k) AS upto FROM l),
        s AS (SELECT f, upto - q + CASE WHEN p % 4 = 0 THEN 2 ELSE 0 END AS a, upto + CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END AS b FROM u), v AS (SELECT * FROM s WHERE a >= 0 AND b > a), t AS (SELECT f, sum(q) AS n FROM l GROUP BY f),
        gaps AS (SELECT t.f, bool_or(x.b IS NULL) AS open FROM t JOIN v ON v.f = t.f AND v.a < t.n LEFT JOIN v x ON x.f = v.f AND x.a < v.a AND x.b >= v.a WHERE v.a > 0 GROUP BY t.f)
        SELECT t.f AS fact_id, coalesce((SELECT max(b) FROM v WHERE v.f = t.f AND v.a < n) >= n AND (SELECT min(a) FROM v WHERE v.f = t.f) = 0 AND NOT coalesce((SELECT open FROM gaps WHERE gaps.f = t.f), false), false) AS covered FROM t""",
    ),
    "q3_graph_recall": (
        q3_graph_recall,
        f"WITH {_GOOD} SELECT case_id, count(*) AS expected, round(count(*) FILTER (n_chars % 4 = 0) / count(*), 6) AS seed_recall, round(count(*) FILTER (n_chars % 4 = 0 OR n_chars % 3 = 0) / count(*), 6) AS path_coverage FROM good LEFT JOIN documents ON doc_id = revision_id GROUP BY case_id",
    ),
    "q4_exact_match": (
        q4_exact_match,
        r"""WITH n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(regexp_replace(lower(upper(text)), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS b, trim(regexp_replace(regexp_replace(regexp_replace(lower(text || ' more'), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM conversations)
        SELECT conv_id * 100 + turn AS case_id, a = b AS exact FROM n UNION ALL SELECT -conv_id * 100 - turn - 1, a = c FROM n""",
    ),
    "q7_context_quality": (
        q7_context_quality,
        f"""WITH {_GOOD}, c AS (SELECT doc_id % 40 AS query_id, doc_id FROM documents WHERE 1 + doc_id // 40 <= 8), s AS (SELECT query_id, count(*) AS shown, count(revision_id) AS hits FROM c LEFT JOIN good ON case_id = query_id AND revision_id = doc_id GROUP BY query_id), w AS (SELECT case_id AS query_id, count(*) AS wanted FROM good GROUP BY ALL)
        SELECT coalesce(s.query_id, w.query_id) AS query_id, round(coalesce(hits / shown, 0), 6) AS precision, round(coalesce(coalesce(hits, 0) / wanted, 0), 6) AS recall FROM s FULL JOIN w USING (query_id)""",
    ),
    "q8_hard_gate": (
        q8_hard_gate,
        f"""WITH {_GATES}, p AS (SELECT run_id, count(*) AS n, bool_and(complete) AS complete, bool_and(NOT complete OR passed) AS good FROM g GROUP BY run_id),
        u AS (SELECT c_custkey AS run_id, coalesce(n, 0) AS n, coalesce(n, 0) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS total, complete, good FROM customer LEFT JOIN p ON p.run_id = c_custkey),
        b AS (SELECT run_id, list_filter([CASE WHEN run_id % 9 = 0 THEN 'RUN_NOT_SUCCEEDED' END, CASE WHEN run_id % 6 = 0 THEN 'CASE_FAILURE_OR_BLOCK' END, CASE WHEN n <> total OR NOT coalesce(complete, true) THEN 'HARD_METRIC_SET_INCOMPLETE' END, CASE WHEN NOT coalesce(good, true) THEN 'HARD_METRIC_FAILED' END, CASE WHEN n <> total THEN 'RESULT_SET_INCOMPLETE' END], lambda x: x IS NOT NULL) AS b FROM u)
        SELECT run_id, len(b) = 0 AS passed, array_to_string(b, '+') AS blockers FROM b""",
    ),
    "q10_release_stats": (
        q10_release_stats,
        f"""WITH e AS (SELECT event_type AS key, CAST(CASE WHEN value >= 0 THEN floor(value + 0.5) ELSE ceil(value - 0.5) END AS BIGINT) AS v, value FROM events)
        SELECT key, count(v) AS n, {_NEAREST.format('v', '0.5')} AS p50, {_NEAREST.format('v', '0.95')} AS p95, max(v) AS most, round(count(*) FILTER (value < 5) / count(*), 6) AS error_rate FROM e GROUP BY key""",
    ),
    "q11_retrieval_report": (
        q11_retrieval_report,
        """WITH o AS (SELECT o_orderkey % 2 AS quality, o_custkey % 5 / 4 AS recall, CAST(floor(o_totalprice / 1000) AS BIGINT) AS d, o_orderkey % 13 = 0 AS bad, o_custkey AS c FROM orders), f AS (SELECT 'all' AS slice, * FROM o UNION ALL SELECT 'even', * FROM o WHERE c % 2 = 0 UNION ALL SELECT 'few', * FROM o WHERE c < 10)
        SELECT slice, count(*) AS cases, round(avg(quality), 6) AS pass_rate, round(avg(recall), 6) AS recall, count(*) FILTER (bad) AS degraded, median(d) AS p50, (list_sort(list(d)))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1] AS p95, max(d) AS most FROM f GROUP BY slice""",
    ),
    "q12_route_accuracy": (
        q12_route_accuracy,
        "SELECT event_type AS case_type, round(avg(CASE WHEN ((user_id % 2 = 0 AND user_id % 3 = 1) OR (user_id % 2 <> 0 AND user_id % 3 = 0)) AND event_id % 3 <= 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events GROUP BY event_type",
    ),
    "q13_observability": (
        q13_observability,
        f"""WITH e AS (SELECT event_type AS kind, value, user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-03 00:00:00')
        SELECT kind, count(*) AS total, count(*) FILTER (value < 10) AS failed, count(*) FILTER (value > 95) AS running, round(count(*) FILTER (value < 10) / count(*), 6) AS failure_rate, round(count(*) FILTER (user_id % 4 = 0) / count(*), 6) AS cache_rate, {_NEAREST.format('v', '0.5')} AS p50, {_NEAREST.format('v', '0.95')} AS p95 FROM e GROUP BY kind""",
    ),
    "q14_multi_turn": (
        q14_multi_turn,
        """WITH t AS (SELECT conv_id, count(*) AS n, arg_max(text, turn) AS last FROM conversations GROUP BY conv_id), g AS (SELECT conv_id AS case_id, NOT n > 2 OR n % 4 > 0 AS history, length(last) BETWEEN 1 AND 500 AND n % 6 <= 4 AS budget, conv_id % 3 < 2 AS citation FROM t)
        SELECT *, history AND budget AND citation AS passed FROM g""",
    ),
    "q15_release_gates": (
        q15_release_gates,
        """WITH g AS (SELECT doc_id AS case_id, lang <> 'fr' OR upper(text) = text AS fact, source <> 'src1' AS access, n_chars % 3 <> 0 OR lang = 'en' AS parser, n_chars > 300 AS place, n_chars % 12 <= 8 AS retrieval, coalesce(CASE WHEN n_chars % 2 = 0 THEN n_chars % 4 = 0 END, false) AS citation FROM documents)
        SELECT *, fact AND access AND parser AND place AND retrieval AND citation AS passed FROM g""",
    ),
    "q17_fact_import": (
        q17_fact_import,
        """WITH q AS (SELECT doc_id, n_chars, string_split(text, '. ') AS s, unnest(string_split(text, '. ')) AS t, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM documents),
        f AS (SELECT doc_id AS case_id, i // 2 AS ordinal, n_chars % 17 = 0 AS absent, s, CASE WHEN n_chars % 5 = 0 THEN i - 1 WHEN n_chars % 5 = 1 AND i = 2 THEN 0 ELSE i END AS id, CASE WHEN n_chars % 5 = 1 AND i = 2 THEN 'changed' ELSE t END AS t FROM q WHERE i % 2 = 0 AND NOT (doc_id % 6 = 0 AND i // 2 = 1)),
        w AS (SELECT *, row_number() OVER (PARTITION BY case_id, id ORDER BY ordinal) AS same, row_number() OVER (PARTITION BY case_id ORDER BY ordinal) AS place FROM f),
        r AS (SELECT case_id, ordinal, CASE WHEN absent THEN 'ABSENT' WHEN id < 0 OR id >= len(s) THEN 'OUTSIDE' WHEN t = '' OR s[id + 1] <> t THEN 'DIFFERS' WHEN same > 1 THEN 'DUPLICATE' WHEN ordinal <> place - 1 THEN 'GAP' END AS fault FROM w)
        SELECT * FROM r WHERE fault IS NOT NULL""",
    ),
    "q19_required_metrics": (q19_required_metrics, f"WITH {_GATES} SELECT result_id, complete, passed FROM g"),
    "d16_changed_cases": (d16_changed_cases, "SELECT doc_id AS case_key, quality AS was, 1 - toxic AS now FROM labels WHERE quality <> 1 - toxic ORDER BY doc_id LIMIT 200"),
    "c12_relevant_memory": (c12_relevant_memory, "SELECT o_orderkey AS item_id, o_orderkey % 4 > 0 AND CASE WHEN o_orderkey % 4 = 1 THEN false ELSE o_orderkey % 30 / 100 >= 0.1 END AS relevant FROM orders"),
    "c13_coverage": (c13_coverage, "SELECT conv_id, count(*) >= 4 AS sufficient, count(*) - 3 >= 1 AS with_none_wanted FROM conversations GROUP BY conv_id"),
    "p1_eligible_history": (p1_eligible_history, f"WITH {_RUNS} SELECT conv_id, turn, role FROM t LEFT JOIN src USING (run_id) WHERE role = 'user' OR (role = 'assistant' AND run_id IS NOT NULL AND (run_status = 'REFUSED' OR (run_status = 'COMPLETED' AND coalesce(current AND NOT used_memory, false))))"),
    "p5_memory_candidates": (
        p5_memory_candidates,
        """WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS owner, o_orderkey % 4 AS k, o_orderdate AS u FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 9 <> 0 AND NOT (o_orderkey % 5 = 0 AND o_orderdate <= TIMESTAMP '1996-01-01')),
        s AS (SELECT l_orderkey AS item_id, bool_and(l_partkey % 10 < 7) AS seen FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 <> 0 GROUP BY ALL),
        r AS (SELECT owner, item_id, row_number() OVER (PARTITION BY owner ORDER BY u DESC, item_id) AS place FROM i LEFT JOIN s USING (item_id) WHERE coalesce(seen, k <> 1)) SELECT * FROM r WHERE place <= 5""",
    ),
    "p9_segments": (
        p9_segments,
        "SELECT conv_id AS run_id, turn AS segment, md5(trim(text)) AS digest, CASE WHEN turn % 3 = 0 THEN '0' ELSE (turn % 3) || ',0' END AS ids FROM conversations WHERE turn % 4 <> 3 AND length(trim(text)) BETWEEN 1 AND 300 AND turn % 3 < 2 AND (turn % 2 <> 0 OR conv_id % 2 = 0)",
    ),
    "p10_summaries": (
        p10_summaries,
        """WITH m AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT conv_id, turn, n, conv_id % 2 = 0 AND turn >= 1 AS fresh FROM m WHERE turn < 3 OR (conv_id % 2 = 0 AND turn >= 1))
        SELECT c.conv_id, coalesce(count(s.turn) = any_value(s.n) AND bool_and(s.fresh OR NOT (s.conv_id % 3 = 0 AND s.turn = 1)), false) AS current FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) GROUP BY c.conv_id""",
    ),
    "p11_answer_sources": (p11_answer_sources, f"WITH {_RUNS} SELECT run_id, current, used_memory FROM src"),
    "p12_attached_context": (
        p12_attached_context,
        """WITH b AS (SELECT l_orderkey AS doc_id, l_partkey % 9 AS span_id, 'PATH' AS kind, l_returnflag AS shown FROM lineitem UNION SELECT l_orderkey, l_suppkey % 9, 'CLAIM', l_linestatus FROM lineitem WHERE l_quantity > 40)
        SELECT b.*, left(sha256(doc_id || '|' || span_id), 8) AS citation FROM b JOIN orders ON o_orderkey = doc_id WHERE span_id IN (o_custkey % 9, (o_custkey + 1) % 9)""",
    ),
}
