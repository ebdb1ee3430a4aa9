"""A search of several query slots: recall, ranking, second rounds, graph and report branches, reranking, and the evidence that is kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from lorespan.functions.text import query_terms
from lorespan.operators.greedy import by_group
from lorespan.operators.retrieval import bm25, knn, rank
from lorespan.shared import materialize

#: Weight of the slots of later rounds in rank fusion, and the longest query.
LATER_ROUNDS, LONGEST_QUERY = 0.25, 500

# Names that lead to no second hop.
BRIDGE_STOPS = ("article", "document", "evidence", "introduction", "references", "source", "summary")
# Fixed value: a name of two to five capitalised words.
BRIDGE_ENTITY = r"(?U)\b(?:[A-Z][\p{L}\p{M}'’.-]{1,}|[A-Z]{2,})(?:\s+(?:[A-Z][\p{L}\p{M}'’.-]{1,}|[A-Z]{2,}|&)){1,4}\b"


def normalize_queries(requested: DataFrame, limit: int = 4) -> DataFrame:
    """The queries of a plan (query_id, position, text), trimmed, short enough, once each, ``limit`` of each query_id; position renumbered."""
    clean = requested.withColumn("text", F.trim("text")).filter((F.col("text") != "") & (F.length("text") <= LONGEST_QUERY))
    once = clean.groupBy("query_id", "text").agg(F.min("position").alias("position"))
    order = Window.partitionBy("query_id").orderBy("position")
    return once.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def route(requested: Column, degraded: Column, planned: Column, global_ready: Column, local_ready: Column) -> tuple[Column, Column]:
    """Mode and reason of a search: an explicit mode stands; AUTO follows the plan where what it needs is there, else HYBRID."""
    auto = requested == "AUTO"
    wanted = F.coalesce(planned, F.lit("HYBRID"))
    lacking = ((wanted == "GLOBAL_GRAPH") & ~global_ready) | ((wanted == "LOCAL_GRAPH") & ~local_ready)
    mode = F.when(~auto, requested).when(degraded | lacking, F.lit("HYBRID")).otherwise(wanted)
    return mode, F.when(~auto, F.lit("EXPLICIT")).when(degraded | lacking, F.lit("SAFE_FALLBACK")).otherwise(F.lit("PLANNED"))


def coverage_sufficient(authorized: Column, evidence_top_k: int) -> Column:
    """As many authorised candidates as evidence is wanted, one at least."""
    return authorized >= max(1, evidence_top_k)


def second_round_allowed(slots: Column, sufficient: Column, degraded: Column, planner_calls: Column, most_slots: int = 4, sub_queries: int = 3, rounds: int = 2, call_limit: int = 2, milliseconds_left: Column | None = None, reserve: int = 1500) -> Column:
    """Slots and planner calls are left, coverage is not sufficient, the plan is sound, and time for what follows remains."""
    left = F.least(F.lit(sub_queries), F.lit(most_slots) - slots)
    timely = F.lit(True) if milliseconds_left is None else milliseconds_left > reserve
    return (left > 0) & timely & ~sufficient & ~degraded & F.lit(rounds > 1) & (planner_calls < call_limit)


def page_total(total: Column, window: int = 10_000) -> tuple[Column, Column]:
    """A total as far as pages reach, and whether it is EXACT or CAPPED."""
    return F.least(total, F.lit(window)), F.when(total > window, F.lit("CAPPED")).otherwise(F.lit("EXACT"))


def recall(docs: DataFrame, slots: DataFrame, k: int = 50, vectors: DataFrame | None = None, slot_vectors: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, round, slot, branch, doc_id, score, rank) of all slots in one plan: BM25, and nearest vectors where slots have one.

    ``slots``: (query_id, round, slot, text); ``vectors``: (vec_id, embedding) of the documents; ``slot_vectors``: (query_id, round, slot, embedding).
    Access rules apply to ``docs`` and ``vectors`` before they come here.
    """
    named = ["query_id", "round", "slot"]
    # slots are numbered, as searches know a query by one whole number
    texts = materialize(slots.select(*named, "text").withColumn("key", F.monotonically_increasing_id()), "slots")
    lexical = rank(bm25(docs, texts.select(F.col("key").alias("query_id"), "text")), k).withColumnRenamed("query_id", "key")
    lexical = lexical.join(texts.select("key", *named), "key").select(*named, F.lit("BM25").alias("branch"), "doc_id", "score", "rank")
    if vectors is None or slot_vectors is None:
        return lexical
    points = materialize(slot_vectors.select(*named, "embedding").withColumn("key", F.monotonically_increasing_id()), "slots")
    near = knn(vectors, points.select(F.col("key").alias("query_id"), "embedding"), k).withColumnRenamed("query_id", "key")
    near = near.join(points.select("key", *named), "key").select(*named, F.lit("VECTOR").alias("branch"), F.col("vec_id").alias("doc_id"), "score", "rank")
    return lexical.unionByName(near)


def slot_status(slots: DataFrame, hits: DataFrame, branches: tuple[str, ...] = ("BM25", "VECTOR")) -> DataFrame:
    """(query_id, round, slot, status): SUCCESS if all branches answered, DEGRADED if some did, FAILED if none."""
    answered = hits.filter(F.col("branch").isin(*branches)).groupBy("query_id", "round", "slot").agg(F.count_distinct("branch").alias("n"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == len(branches), F.lit("SUCCESS")).when(n > 0, F.lit("DEGRADED")).otherwise(F.lit("FAILED"))
    return slots.join(answered, ["query_id", "round", "slot"], "left").select("query_id", "round", "slot", status.alias("status"))


def rank_candidates(hits: DataFrame, memory: DataFrame | None = None, graph: DataFrame | None = None, reports: DataFrame | None = None, constant: int = 60, graph_weight: float = 1.0, mode: str = "reference") -> DataFrame:
    """(query_id, doc_id, rrf, score, rank) of all candidates.

    Slots of the first round count whole, later ones a quarter; ``memory`` (query_id, doc_id, rank) counts like a slot. With ``graph`` or
    ``reports`` (query_id, doc_id, rank) the score is the sum of all parts; without, a candidate that one lexical slot alone
    has found keeps its own score (``mode="rrf"`` never does that).
    """
    weight = F.when(F.col("round") == 1, 1.0).otherwise(LATER_ROUNDS)
    parts = [hits.select("query_id", "doc_id", (weight / (constant + F.col("rank"))).alias("part"), F.lit(0.0).alias("more"), F.when(F.col("branch") == "BM25", F.col("score")).alias("own"), (F.col("branch") != "BM25").alias("other"))]
    for extra, share in ((memory, None), (graph, graph_weight), (reports, 1.0)):
        if extra is not None:
            part = F.lit(1.0 if share is None else share) / (constant + F.col("rank"))
            zero = F.lit(0.0)
            parts.append(extra.select("query_id", "doc_id", (part if share is None else zero).alias("part"), (zero if share is None else part).alias("more"), F.lit(None).cast("double").alias("own"), F.lit(True).alias("other")))
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(
        F.round(F.sum("part"), 9).alias("rrf"), F.round(F.sum("part") + F.sum("more"), 9).alias("sum"), F.count("own").alias("lexical"), F.max("own").alias("own"), F.bool_or("other").alias("other")
    )
    fused = graph is not None or reports is not None
    alone = (F.col("lexical") == 1) & ~F.col("other")
    score = F.col("sum") if fused else F.when(alone & F.lit(mode == "reference"), F.col("own")).otherwise(F.col("rrf"))
    return rank(merged.select("query_id", "doc_id", "rrf", score.alias("score")))


def bridge_names(text: Column) -> Column:
    """Names of two to five capitalised words that begin and end where words do."""
    return F.regexp_extract_all(text, F.lit(BRIDGE_ENTITY), F.lit(0))


def second_hop_queries(queries: DataFrame, candidates: DataFrame, existing: DataFrame, limit: int = 1, first: int = 8, names: Callable[[Column], Column] = bridge_names) -> DataFrame:
    """(query_id, position, text): the query with a name that its first candidates bring in, the best names first.

    ``queries``: (query_id, text); ``candidates``: (query_id, rank, title, text); ``existing``: (query_id, text) of the slots there are.
    ``names`` finds the names of a text. Titles score 120 and names in the first 1,500 characters of a text 150, less the candidate's place; a name of stop values, of three
    characters or less, or without a new term leads nowhere.
    """
    top = candidates.filter(F.col("rank") <= first)
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"^\[[^\]]+\][\s·:_-]*", ""))
    found = top.select("query_id", title.alias("name"), (F.lit(121) - F.col("rank")).alias("score")).unionByName(
        top.select("query_id", F.explode(names(F.substring(F.coalesce("text", F.lit("")), 1, 1500))).alias("name"), (F.lit(151) - F.col("rank")).alias("score"))
    )
    named = found.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).withColumn("norm", F.lower("name"))
    named = named.filter(F.length("name").between(3, 80) & ~F.col("norm").isin(*BRIDGE_STOPS))
    best = named.groupBy("query_id", "norm").agg(F.max("score").alias("score"), F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"))
    asked = queries.select("query_id", F.trim("text").alias("asked"), query_terms(F.col("text")).alias("old"))
    novel = best.join(asked, "query_id").filter(F.size(F.array_except(query_terms(F.col("name")), "old")) > 0)
    room = F.lit(LONGEST_QUERY - 1) - F.length("asked")
    made = novel.filter(room > 0).withColumn("text", F.trim(F.concat("asked", F.lit(" "), F.trim(F.left("name", room)))))
    seen = existing.select("query_id", F.lower(F.trim("text")).alias("low")).unionByName(queries.select("query_id", F.lower(F.trim("text")).alias("low"))).distinct()
    fresh = made.withColumn("low", F.lower("text")).join(seen, ["query_id", "low"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "norm")
    return fresh.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("query_id", "position", "text")


def graph_relevance(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance, rank) of graph candidates: four times the best share of query terms that a path shows, and a little for short paths and early places.

    ``queries``: (query_id, text); ``paths``: (query_id, doc_id, place, depth, shown), ``shown`` being relation, title and evidence of the path.
    """
    asked = queries.select("query_id", query_terms(F.col("text")).alias("terms"))
    low = F.lower("shown")
    matched = F.size(F.filter("terms", lambda t: F.contains(low, t)))
    lexical = F.when(F.size("terms") == 0, 0.0).otherwise(matched / F.size("terms"))
    scored = paths.join(asked, "query_id").groupBy("query_id", "doc_id", "place").agg(F.max(lexical).alias("lexical"), F.min("depth").alias("depth"))
    relevance = F.round(F.col("lexical") * 4 + 0.1 / F.greatest(F.lit(1), F.col("depth")) + 1.0 / (60.0 + F.col("place")), 9)
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "place", "doc_id")
    return scored.withColumn("relevance", relevance).select("query_id", "doc_id", "relevance", F.row_number().over(order).alias("rank"))


def apply_rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates in the order of a reranker's answer; ``scores``: (query_id, place, index, rerank_score), index counting candidates by rank from 0."""
    indexed = candidates.withColumn("index", F.col("rank") - 1)
    return indexed.join(scores, ["query_id", "index"]).drop("index").withColumn("rerank_rank", F.col("place")).drop("place")


def best_pair(queries: DataFrame, candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, parent, child): the two candidates that together answer a question of two hops, at most one pair a query.

    ``candidates``: (query_id, doc_id, document, rank, text), tens a query; ``paths``: (query_id, doc_id, relation, parent_relation, depth, shown).
    Pairs are those of a path beyond depth 1 with the first candidate that shows its parent relation, and those of a graph
    candidate with a candidate of another document that shares a term with its paths. Wins: most query terms covered, most shared terms, a
    pair of a path, the least later and summed rank, ids.
    """
    terms = lambda c: query_terms(F.col(c))
    c = candidates.select("query_id", "doc_id", "document", "rank", "text")
    shows = paths.join(c.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"])
    first = shows.groupBy("query_id", "relation").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("parent"))
    explicit = shows.filter((F.col("depth") > 1) & F.col("parent_relation").isNotNull()).select("query_id", F.col("doc_id").alias("child"), F.col("parent_relation").alias("relation"), "shown").join(first, ["query_id", "relation"])
    joined = shows.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "relation", "shown"))), lambda x: x["shown"]), " ").alias("shown"))
    graph = joined.join(c.select("query_id", "doc_id", "document"), ["query_id", "doc_id"]).withColumn("term", F.explode(terms("shown")))
    others = c.select("query_id", F.col("doc_id").alias("parent"), F.col("document").alias("other"), F.explode(terms("text")).alias("term"))
    # a query has tens of candidates; pairs meet through a shared term
    bridge = graph.join(others, ["query_id", "term"]).filter("doc_id <> parent AND document <> other").groupBy("query_id", "doc_id", "parent").agg(F.first("shown").alias("shown"))
    pairs = explicit.select("query_id", "parent", "child", "shown", F.lit(1).alias("explicit")).unionByName(bridge.select("query_id", "parent", F.col("doc_id").alias("child"), "shown", F.lit(0).alias("explicit")))
    left = c.select("query_id", F.col("doc_id").alias("parent"), F.col("rank").alias("pr"), F.col("text").alias("pt"))
    right = c.select("query_id", F.col("doc_id").alias("child"), F.col("rank").alias("cr"), F.col("text").alias("ct"))
    full = pairs.join(left, ["query_id", "parent"]).join(right, ["query_id", "child"]).join(queries.select("query_id", query_terms(F.col("text")).alias("asked")), "query_id")
    covered = F.size(F.array_intersect(query_terms(F.concat_ws(" ", "pt", "ct", "shown")), "asked"))
    shared = F.size(F.array_intersect(terms("shown"), terms("pt")))
    order = Window.partitionBy("query_id").orderBy(covered.desc(), shared.desc(), F.col("explicit").desc(), F.greatest("pr", "cr"), F.col("pr") + F.col("cr"), "parent", "child")
    return full.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "parent", "child")


def diversified_evidence(candidates: DataFrame, slots: DataFrame, pairs: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """The evidence of each query (query_id, doc_id, rank), in rank order.

    First the best pair, then for every further slot its first candidate of a document not yet shown (else its first one), then by
    rank. ``candidates``: (query_id, rank, doc_id, document, slots array of slot numbers that found it), tens a query; ``slots``: (query_id,
    slot) besides the first one.
    """
    numbers = slots.groupBy("query_id").agg(F.array_sort(F.collect_set("slot")).alias("asked"))
    rows = candidates.join(numbers, "query_id", "left")
    if pairs is not None:
        rows = rows.join(pairs, "query_id", "left")
    else:
        rows = rows.withColumn("parent", F.lit(None).cast("long")).withColumn("child", F.lit(None).cast("long"))

    def choose(group: list[tuple]):
        query, _, _, _, _, asked, parent, child = group[0]
        by_id = {r[2]: r for r in group}
        taken: dict = {}
        if limit >= 2 and parent in by_id and child in by_id:
            taken = {parent: 1, child: 1}
        shown = {by_id[t][3] for t in taken}
        for slot in asked if asked is not None else ():
            found = [r for r in group if r[4] is not None and slot in r[4]] if len(taken) < limit else []
            pick = next((r for r in found if r[3] not in shown), found[0] if found else None)
            if pick:
                taken[pick[2]] = 1
                shown.add(pick[3])
        for r in group:
            if len(taken) < limit:
                taken[r[2]] = 1
        return [(query, r[2], r[1]) for r in group if r[2] in taken][:limit]

    columns = ["query_id", "rank", "doc_id", "document", "slots", "asked", "parent", "child"]
    return by_group(rows, "query_id", ["rank", "doc_id"], columns, choose, "query_id long, doc_id long, rank int")


def read_through(inputs: DataFrame, cache: DataFrame, provide, namespace: str = "default") -> tuple[DataFrame, DataFrame]:
    """(vectors of all inputs, rows to add to the cache): each distinct input is asked for once, and only if the cache lacks a sound row.

    ``inputs``: (id, text); ``cache``: (key, bytes, checksum). A cached row whose checksum does not fit its bytes counts as lacking.
    ``provide`` makes (key, bytes, checksum) of (key, text).
    """
    keyed = inputs.withColumn("key", F.sha2(F.concat_ws("|", F.lit(namespace), F.coalesce("text", F.lit(""))), 256))
    sound = cache.filter(F.sha2("bytes", 256) == F.col("checksum")).dropDuplicates(["key"])
    lacking = keyed.select("key", "text").dropDuplicates(["key"]).join(sound.select("key"), "key", "left_anti")
    made = provide(lacking).select("key", "bytes", "checksum")
    return keyed.select("id", "key").join(sound.select("key", "bytes", "checksum").unionByName(made), "key").select("id", "key", "bytes"), made


@F.pandas_udf(BinaryType())
def encode_vector(vectors):
    """I32: 32-bit floats, little endian; null for vectors that are null, empty, not finite or all zero."""

    def one(v):
        if v is None or not len(v):
            return None
        a = np.array(v, dtype=np.float64)
        with np.errstate(over="ignore"):
            short = a.astype("<f4")
        return short.tobytes() if np.isfinite(short).all() and short.any() else None

    return vectors.map(one)


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(data, checksums):
    """I32: the floats of a vector whose SHA-256 fits; null for others and for vectors that are not finite or all zero."""
    import hashlib

    def one(b, c):
        if b is None or c != hashlib.sha256(b).hexdigest() or len(b) % 4:
            return None
        a = np.frombuffer(b, dtype="<f4")
        return a if len(a) and np.isfinite(a).all() and a.any() else None

    return pd.Series([one(b, c) for b, c in zip(data, checksums, strict=True)])
