"""A whole search: recall, a second round where evidence is thin, fusion, reranking, diverse evidence, and the parents that come along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.operators import search as Q
from lorespan.operators.context import plan_parents
from lorespan.operators.retrieval import rank
from lorespan.shared import discard, materialize


def answer_search(
    queries: DataFrame,
    docs: DataFrame,
    rerank: Callable[[DataFrame], DataFrame],
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    paths: DataFrame | None = None,
    reports: DataFrame | None = None,
    candidates: int = 50,
    reranked: int = 20,
    evidence: int = 8,
    rounds: int = 2,
) -> DataFrame:
    """(query_id, rank, doc_id, rounds, rerank_rank, included, parent_tokens, reason): the evidence of each query, best first.

    ``queries``: (query_id, text), a stated set; ``docs``: (doc_id, document, title, text, tokens, parent_id, parent_tokens), what the reader may see;
    ``vectors``: (vec_id, embedding) of documents, ``query_vectors``: (query_id, embedding); ``paths`` (query_id, doc_id, place, depth, relation,
    parent_relation, shown) and ``reports`` (query_id, doc_id, rank) of a graph. ``rerank`` gets (query_id, index, doc_id, query, text) of
    the first ``reranked`` candidates and returns (query_id, index, score).

    J8 recall by words and vectors; C13 and J10: where fewer than ``evidence`` candidates were found a second round asks for names they bring in
    (J9), unless ``rounds`` is 1; J11-J13 graph and reports join the fusion; J15 the reranker's order; J18 and J17 the pair that answers together, then a candidate for every slot;
    O1 parents within their budget. Whatever is not in ``docs`` is left out before it is ranked. A query that finds nothing has no row.
    """
    seen = docs.select("doc_id").distinct()
    vectors = vectors.join(seen.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi") if vectors is not None else None
    first = queries.select("query_id", F.lit(1).alias("round"), F.lit(1).alias("slot"), "text")
    points = query_vectors.select("query_id", F.lit(1).alias("round"), F.lit(1).alias("slot"), "embedding") if query_vectors is not None else None
    hits = materialize(Q.recall(docs.select("doc_id", "text"), first, candidates, vectors, points), "hits")
    early = Q.rank_candidates(hits)
    counted = queries.join(early.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    thin = counted.filter(Q.second_round_allowed(F.lit(1), Q.coverage_sufficient(F.coalesce("n", F.lit(0)), evidence), F.lit(False), F.lit(0), rounds=rounds)).select("query_id", "text")
    shown = early.filter(F.col("rank") <= evidence).join(docs.select("doc_id", "title", "text"), "doc_id").join(thin.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "title", "text")
    second = materialize(Q.second_hop_queries(thin, shown, thin, 1).select("query_id", F.lit(2).alias("round"), (F.col("position") + 1).cast("int").alias("slot"), "text"), "second-slots")
    every = hits if second.isEmpty() else materialize(hits.unionByName(Q.recall(docs.select("doc_id", "text"), second, candidates)), "hits")
    graph = Q.graph_relevance(queries, paths.join(seen, "doc_id", "left_semi")).filter(F.col("rank") <= candidates) if paths is not None else None
    known = reports.join(seen, "doc_id", "left_semi") if reports is not None else None
    top = Q.rank_candidates(every, graph=graph, reports=known).filter(F.col("rank") <= reranked)
    top = materialize(top.join(docs.select("doc_id", "document", "text", "tokens", "parent_id", F.col("parent_tokens").alias("whole")), "doc_id"), "candidates")
    asked = top.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", (F.col("rank") - 1).alias("index"), "doc_id", "query", "text")
    placed = rank(rerank(asked).select("query_id", "index", "score"), tie="index").select("query_id", "index", F.col("rank").alias("place"), F.col("score").alias("rerank_score"))
    ordered = Q.apply_rerank(top, placed).withColumn("rank", F.col("rerank_rank").cast("int"))
    by_slot = every.groupBy("query_id", "doc_id").agg(F.collect_set("slot").alias("slots"))
    ordered = materialize(ordered.join(by_slot, ["query_id", "doc_id"], "left"), "reranked")
    pairs = Q.best_pair(queries, ordered.select("query_id", "doc_id", "document", "rank", "text"), paths.join(seen, "doc_id", "left_semi")) if paths is not None else None
    chosen = Q.diversified_evidence(ordered.select("query_id", "rank", "doc_id", "document", "slots"), second.select("query_id", "slot"), pairs, evidence)
    chosen = materialize(chosen.join(ordered.select("query_id", "doc_id", "tokens", "parent_id", "whole", "document", "rerank_rank"), ["query_id", "doc_id"]), "evidence")
    plan = plan_parents(chosen.select("query_id", "rank", F.col("doc_id").alias("child_id"), F.col("tokens").cast("int").alias("child_tokens"), "parent_id", F.col("whole").cast("int").alias("parent_tokens"), F.col("document").alias("doc_id")))
    made = second.select("query_id", F.lit(2).alias("rounds")).distinct()
    out = plan.select("query_id", "rank", F.col("child_id").alias("doc_id"), "included", F.col("tokens").alias("parent_tokens"), "reason").join(made, "query_id", "left")
    out = materialize(out.join(chosen.select("query_id", "doc_id", "rerank_rank"), ["query_id", "doc_id"]).select("query_id", "rank", "doc_id", F.coalesce("rounds", F.lit(1)).alias("rounds"), "rerank_rank", "included", "parent_tokens", "reason"), "answers")
    discard(hits, second, top, ordered, chosen, *([every] if every is not hits else []))
    return out
