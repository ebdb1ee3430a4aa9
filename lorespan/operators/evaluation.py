"""Evaluation: recall by stage, coverage of facts, gates, release statistics, and reports over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The hard metrics that a case of each type must have measured, all at 1.0; other types have none that passes.
_ANSWERED = ("phase11b.hard.authorization_recheck", "phase11b.hard.revision_recheck", "phase11b.hard.budget_respected", "phase11b.hard.degradation_recorded", "phase11b.hard.request_limit")
HARD_METRICS = {
    "RETRIEVAL": (*_ANSWERED, "phase11b.hard.evidence_mapping"),
    "LOCAL_GRAPH": (*_ANSWERED, "phase11b.hard.graph_path_resolved"),
    "GLOBAL_GRAPH": (*_ANSWERED, "phase11b.hard.global_claim_resolved"),
    "ANSWER_CITATION": (*_ANSWERED, "phase11b.hard.citation_resolved", "phase11b.hard.refusal_contract"),
    "MULTI_TURN": ("phase12c.hard.multi_turn_history", "phase12c.hard.query_budget", "phase12c.hard.multi_turn_citation"),
    "INTENT": ("phase12c.hard.intent_route_unique",),
    "MULTIFORMAT_RELEASE": (
        "phase18d.hard.fact_integrity", "phase18d.hard.current_revision_acl", "phase18d.hard.parser_contract", "phase18d.hard.locator_resolved", "phase18d.hard.retrieval_resolved",
        "phase18d.hard.citation_resolved", "phase18d.hard.budget_respected", "phase18d.hard.degradation_recorded", "phase18d.hard.query_budget",
    ),
    "MULTIFORMAT_SECURITY": ("phase18d.hard.security_attack_executed", "phase18d.hard.security_attack_passed"),
}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def stage_recall(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Q-1: of each case the share of its expected revisions that each stage holds.

    ``candidates``: (case_id, revision_id, bm25_rank, vector_rank, rerank_rank, accepted), ranks null where a stage has not found it;
    ``expected``: (case_id, revision_id). A case without expectations has recall 0.
    """
    found = expected.select("case_id", "revision_id").distinct().join(candidates, ["case_id", "revision_id"], "left")
    here = F.col("accepted").isNotNull()
    hit = lambda c: F.count_distinct(F.when(c, F.col("revision_id")))
    stages = {"bm25": F.col("bm25_rank").isNotNull(), "vector": F.col("vector_rank").isNotNull(), "merged": here, "reranked": F.col("rerank_rank").isNotNull(), "accepted": F.col("accepted")}
    n = F.count_distinct("revision_id")
    return found.groupBy("case_id").agg(n.alias("expected"), *[F.round(_ratio(hit(c), n), 6).alias(name) for name, c in stages.items()])


def covered_facts(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """Q-2: (fact_id, covered): whether the spans (fact_id, first, last) cover [0, length) of each fact (fact_id, length) without a gap."""
    sound = spans.filter("first >= 0 AND last > first")
    before = F.coalesce(F.max("last").over(Window.partitionBy("fact_id").orderBy("first", F.col("last").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # up to the first gap everything is covered
    reach = sound.withColumn("reached", before).withColumn("gap", F.col("first") > F.col("reached"))
    ends = reach.groupBy("fact_id").agg(F.max("last").alias("last"), F.min(F.when(F.col("gap"), F.col("reached"))).alias("stopped"))
    joined = facts.join(ends, "fact_id", "left")
    covered = (F.col("length") > 0) & (F.coalesce("stopped", "last", F.lit(0)) >= F.col("length"))
    return joined.select("fact_id", F.coalesce(covered, F.lit(False)).alias("covered"))


def graph_recall(expected: DataFrame, seeds: DataFrame, paths: DataFrame) -> DataFrame:
    """Q-3: of each case the share of its expected documents that seeds hold, and that seeds or paths hold; all inputs (case_id, doc_id)."""
    want = expected.select("case_id", "doc_id").distinct()
    seeded = seeds.select("case_id", "doc_id", F.lit(True).alias("seed")).distinct()
    walked = paths.select("case_id", "doc_id", F.lit(True).alias("walked")).distinct()
    both = want.join(seeded, ["case_id", "doc_id"], "left").join(walked, ["case_id", "doc_id"], "left")
    n = F.count("*")
    met = F.coalesce("seed", F.lit(False)) | F.coalesce("walked", F.lit(False))
    return both.groupBy("case_id").agg(n.alias("expected"), F.round(_ratio(F.count_if("seed"), n), 6).alias("seed_recall"), F.round(_ratio(F.count_if(met), n), 6).alias("path_coverage"))


def exact_match(answers: DataFrame, normal) -> DataFrame:
    """Q-4: (case_id, exact): whether answer and reference are equal once ``normal`` has been applied to both."""
    return answers.select("case_id", (normal(F.col("answer")) == normal(F.col("reference"))).alias("exact"))


def context_quality(context: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """Q-7: (query_id, precision, recall) of the first k materials: relevant ones among them, and among all relevant ones.

    ``context``: (query_id, rank, doc_id); ``relevant``: (query_id, doc_id).
    """
    want = relevant.select("query_id", "doc_id").distinct()
    shown = context.filter(F.col("rank") <= k).join(want.withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    per = shown.groupBy("query_id").agg(F.count("*").alias("shown"), F.count_if("hit").alias("hits"))
    sizes = want.groupBy("query_id").agg(F.count("*").alias("wanted"))
    full = sizes.join(per, "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return full.select("query_id", F.round(_ratio(zero("hits"), zero("shown")), 6).alias("precision"), F.round(_ratio(zero("hits"), zero("wanted")), 6).alias("recall"))


def hard_metric_sets(spark) -> DataFrame:
    """Q-19: (case_type, required array of metric keys)."""
    return spark.createDataFrame([(t, sorted(keys)) for t, keys in HARD_METRICS.items()], "case_type string, required array<string>")


def hard_gates(results: DataFrame, metrics: DataFrame, required: DataFrame) -> DataFrame:
    """Q-8, Q-19: (result_id, complete, passed): whether a result's hard metrics are just those that its type requires, all measured at 1.0.

    ``results``: (result_id, case_type); ``metrics``: (result_id, metric_key, status, value); keys with .hard. count; ``required``: of ``hard_metric_sets``.
    """
    hard = metrics.filter(F.contains("metric_key", F.lit(".hard.")))
    good = (F.col("status") == "MEASURED") & (F.coalesce("value", F.lit(0.0)) == 1.0)
    per = hard.groupBy("result_id").agg(F.array_sort(F.collect_set("metric_key")).alias("actual"), F.bool_and(good).alias("good"))
    joined = results.join(F.broadcast(required), "case_type", "left").join(per, "result_id", "left")  # one row a case type
    complete = F.coalesce(F.col("actual") == F.col("required"), F.lit(False))
    return joined.select("result_id", complete.alias("complete"), (complete & F.coalesce("good", F.lit(False))).alias("passed"))


def gate_summary(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """Q-8: (run_id, passed, blockers): what keeps a run from release, joined by plus signs.

    ``runs``: (run_id, status, total_cases, failed_cases); ``gates``: (run_id, result_id, complete, passed) of its results.
    """
    per = gates.groupBy("run_id").agg(F.count("*").alias("results"), F.bool_and("complete").alias("complete"), F.bool_and(~F.col("complete") | F.col("passed")).alias("good"))
    j = runs.join(per, "run_id", "left")
    n = F.coalesce("results", F.lit(0))
    blockers = F.array_compact(
        F.array(
            F.when(F.col("status") != "SUCCEEDED", F.lit("RUN_NOT_SUCCEEDED")),
            F.when(F.col("failed_cases") > 0, F.lit("CASE_FAILURE_OR_BLOCK")),
            F.when((n != F.col("total_cases")) | ~F.coalesce("complete", F.lit(True)), F.lit("HARD_METRIC_SET_INCOMPLETE")),
            F.when(~F.coalesce("good", F.lit(True)), F.lit("HARD_METRIC_FAILED")),
            F.when(n != F.col("total_cases"), F.lit("RESULT_SET_INCOMPLETE")),
        )
    )
    return j.select("run_id", (F.size(blockers) == 0).alias("passed"), F.array_join(blockers, "+").alias("blockers"))


def nearest_ranks(values: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles p<share> of each group, from counts of equal values: no group is gathered in one buffer."""
    counted = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(group))
    ranked = counted.withColumn("upto", upto).withColumn("total", total)
    least = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * p)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy(group).agg(F.sum("n").alias("n"), *least, F.max(value).alias("most"))


def release_stats(durations: DataFrame, failures: DataFrame) -> DataFrame:
    """Q-10: (key, n, p50, p95, most, error_rate) of measured durations (key, value), with failures (key, failed, total)."""
    stats = nearest_ranks(durations, "key", "value", (0.5, 0.95))
    joined = failures.join(stats, "key", "left")
    return joined.select("key", F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95", "most", F.round(_ratio(F.col("failed"), F.col("total")), 6).alias("error_rate"))


def retrieval_report(cases: DataFrame, selectors: dict[str, Column]) -> DataFrame:
    """Q-11, E19: of each slice of cases (a case may be in several) the means, durations and degradations.

    ``cases``: (case_id, quality, recall, duration, degraded); slices without cases are left out. p95 is the value at floor((n - 1) * 0.95).
    """
    named = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in selectors.items()]))
    flat = cases.withColumn("slice", F.explode(named))
    sums = flat.groupBy("slice").agg(F.count("*").alias("cases"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg("recall"), 6).alias("recall"), F.count_if("degraded").alias("degraded"))
    counted = flat.groupBy("slice", "duration").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(Window.partitionBy("slice").orderBy("duration")), F.sum("n").over(Window.partitionBy("slice"))
    at = counted.withColumn("upto", upto).withColumn("total", total)
    place = lambda p: F.min(F.when(F.col("upto") >= F.floor((F.col("total") - 1) * p) + 1, F.col("duration")))
    upper = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("duration")))
    times = at.groupBy("slice").agg(((place(0.5) + upper) / 2).alias("p50"), place(0.95).alias("p95"), F.max("duration").alias("most"))
    return sums.join(times, "slice")


def intent_routes(cases: DataFrame) -> DataFrame:
    """Q-12: (case_type, accuracy): share of cases whose selected route is the expected one within the budgets of calls.

    ``cases``: (case_type, expected, selected, planner_calls, rewrite_calls).
    """
    right = F.col("selected").eqNullSafe(F.col("expected")) & (F.col("planner_calls") <= 1) & (F.col("rewrite_calls") <= 1)
    return cases.groupBy("case_type").agg(F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def multi_turn_gates(cases: DataFrame) -> DataFrame:
    """Q-14: of each case whether history was used where it is required, the rewritten query is within its budget, and every citation is one that was offered.

    ``cases``: (case_id, history_required, history_messages, rewritten, query_budget, cited array, offered array).
    """
    history = ~F.col("history_required") | (F.col("history_messages") > 0)
    budget = F.coalesce(F.length("rewritten").between(1, 500) & (F.col("query_budget") <= 4), F.lit(False))
    citation = (F.size("cited") > 0) & (F.size(F.array_except("cited", "offered")) == 0)
    return cases.select("case_id", history.alias("history"), budget.alias("budget"), citation.alias("citation"), (history & budget & citation).alias("passed"))


def release_gates(facts: DataFrame) -> DataFrame:
    """Q-15: of each case of a multi-format release whether fact, access, parser, place, retrieval and citation hold, and whether all do.

    ``facts``: (case_id, expected_hash, actual_hash, authorised, parser, required_parser, unit, retrieved_rank, cited).
    """
    gates = {
        "fact": F.col("expected_hash").eqNullSafe(F.col("actual_hash")),
        "access": F.coalesce("authorised", F.lit(False)),
        "parser": F.col("parser").eqNullSafe(F.col("required_parser")),
        "place": F.col("unit").isNotNull(),
        "retrieval": F.coalesce(F.col("retrieved_rank") <= 8, F.lit(False)),
        "citation": F.coalesce("cited", F.lit(False)),
    }
    whole = F.lit(True)
    for g in gates.values():
        whole = whole & g
    return facts.select("case_id", *[g.alias(n) for n, g in gates.items()], whole.alias("passed"))


def fact_contract(facts: DataFrame, corpus: DataFrame, canonical) -> DataFrame:
    """Q-17: (case_id, ordinal, fault) of supporting facts that break the contract: ABSENT, OUTSIDE, DIFFERS, DUPLICATE or GAP.

    ``facts``: (case_id, ordinal, evidence_key, sentence_id, sentence); ``corpus``: (evidence_key, sentences). A sentence must equal, once
    canonical, the one of its number; each comes once a case; ordinals run from 0 without a gap.
    """
    j = facts.join(corpus, "evidence_key", "left")
    own = canonical(F.get("sentences", F.col("sentence_id")))
    alone = (
        F.when(F.col("sentences").isNull(), F.lit("ABSENT"))
        .when((F.col("sentence_id") < 0) | (F.col("sentence_id") >= F.size("sentences")), F.lit("OUTSIDE"))
        .when((canonical(F.col("sentence")) == "") | ~own.eqNullSafe(canonical(F.col("sentence"))), F.lit("DIFFERS"))
    )
    # a fact is held against its corpus before facts are placed, so that no text and no corpus is shuffled again with each fact
    judged = j.select("case_id", "ordinal", "evidence_key", "sentence_id", alone.alias("alone"))
    same = Window.partitionBy("case_id", "evidence_key", "sentence_id").orderBy("ordinal")
    # dealt by case alone, both windows find their rows where they lie
    placed = judged.repartition("case_id").withColumn("same", F.row_number().over(same)).withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("ordinal")))
    fault = F.coalesce("alone", F.when(F.col("same") > 1, F.lit("DUPLICATE")).when(F.col("ordinal") != F.col("place") - 1, F.lit("GAP")))
    return placed.select("case_id", "ordinal", fault.alias("fault")).filter("fault IS NOT NULL")


def metric_deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """Q-9: (metric, first, second, delta, first_measured, second_measured) of two runs (metric, value, status): means of what was measured; null where one run has none."""
    mean = lambda df, n: df.groupBy("metric").agg(F.avg(F.when(F.col("status") == "MEASURED", F.col("value"))).alias(n), F.count_if(F.col("status") == "MEASURED").alias(f"{n}_measured"))
    both = mean(first, "first").join(mean(second, "second"), "metric", "full")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("metric", F.round("first", 9).alias("first"), F.round("second", 9).alias("second"), F.round(F.col("second") - F.col("first"), 9).alias("delta"), none("first_measured"), none("second_measured"))


def slice_deltas(first: DataFrame, second: DataFrame, dimensions: tuple[str, ...] = ("language", "case_type")) -> DataFrame:
    """Q-9: (dimension, value, and SUCCEEDED, FAILED and BLOCKED cases of either run) for each value of each dimension.

    Runs: (status, and a column for each dimension). Both runs and all dimensions are counted in one pass.
    """
    runs = [df.select(F.lit(n).alias("run"), "status", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("slice")) for n, df in (("first", first), ("second", second))]
    counts = [F.count_if((F.col("run") == n) & (F.col("status") == status)).alias(f"{n}_{status.lower()}") for n in ("first", "second") for status in ("SUCCEEDED", "FAILED", "BLOCKED")]
    return runs[0].unionByName(runs[1]).groupBy("slice.dimension", "slice.value").agg(*counts)


def changed_cases(first: DataFrame, second: DataFrame, limit: int = 200) -> DataFrame:
    """Cases (case_key, status) of two runs whose status differs, the first ``limit`` by key."""
    both = first.select("case_key", F.col("status").alias("was")).join(second.select("case_key", F.col("status").alias("now")), "case_key")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).orderBy("case_key").limit(limit)


def observability(events: DataFrame, at: Column, hours: int = 24) -> DataFrame:
    """Q-13: one row a kind of the last hours before ``at``: how many, failed, failure rate, running, nearest-rank p50 and p95 of duration, and cache hits.

    ``events``: (kind, ts, status, duration, cached).
    """
    recent = events.filter((F.col("ts") >= at - F.make_interval(hours=F.lit(hours))) & (F.col("ts") < at))
    sums = recent.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if("cached").alias("hits"))
    times = nearest_ranks(recent, "kind", "duration", (0.5, 0.95)).select("kind", "p50", "p95")
    return sums.join(times, "kind", "left").select("kind", "total", "failed", "running", F.round(_ratio(F.col("failed"), F.col("total")), 6).alias("failure_rate"), F.round(_ratio(F.col("hits"), F.col("total")), 6).alias("cache_rate"), "p50", "p95")
