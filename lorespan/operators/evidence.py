"""Evidence: features of texts, selection of spans, scores of candidates, and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions.text import words


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the features of ``a`` that ``b`` has, 0 without features."""
    n = F.size(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / n))


def best_span(spans: DataFrame) -> DataFrame:
    """Of each citation (id) the span that shares most words with the answer, counted four times, and the question.

    ``spans``: (id, span_order, span, answer, question). Ties go to the first span; without any overlap the first.
    """
    feature = lambda c: F.array_distinct(words(F.col(c)))
    score = 4 * F.size(F.array_intersect(feature("span"), feature("answer"))) + F.size(F.array_intersect(feature("span"), feature("question")))
    return spans.withColumn("score", score).groupBy("id").agg(F.min_by(F.struct("span_order", "score"), F.struct(-F.col("score"), F.col("span_order"))).alias("best")).select("id", "best.*")


def bridge_terms(texts: DataFrame, most: int = 20) -> DataFrame:
    """Names of two to five capitalised words in each text (id, text), best first; earlier ones score more."""
    found = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,4}"), F.lit(0))).alias("i", "term"))
    scored = found.groupBy("id", "term").agg(F.max(150 - F.col("i")).alias("score"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def truncate_around(text: Column, needle: Column, budget: int) -> Column:
    """A window of ``budget`` characters that holds the needle about its middle, with an ellipsis at each cut."""
    at = F.greatest(F.instr(text, needle), F.lit(1))
    start = F.greatest(F.lit(1), F.least(at - F.floor((F.lit(budget) - F.length(needle)) / 2), F.length(text) - budget + 1)).cast("int")
    cut = F.concat(F.when(start > 1, "…").otherwise(""), text.substr(start, F.lit(budget)), F.when(start + budget <= F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= budget, text).otherwise(cut)


def bounded_path(path: Column, most: int = 450, head: int = 380) -> Column:
    """Long paths as their head and a hash."""
    return F.when(F.length(path) > most, F.concat(F.substring(path, 1, head), F.lit("/…/"), F.substring(F.sha2(path, 256), 1, 32))).otherwise(path)


def overlapping_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """K4-K6: parts of spans (doc_id, span, a, b) inside chunks (doc_id, chunk, first, last), relative to the chunk.

    Both sides are cut into cells of 512 characters, so that the join is on (doc_id, cell) and no document is
    compared whole with itself; a pair is kept in the cell where its overlap begins.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 512), F.floor((F.col(b) - 1) / 512)))
    left = chunks.filter("first < last").withColumn("cell", cells("first", "last"))
    right = spans.filter("a < b").withColumn("cell", cells("a", "b"))
    met = left.join(right, ["doc_id", "cell"]).filter("a < last AND first < b AND floor(greatest(a, first) / 512) = cell")
    return met.select("doc_id", "chunk", "span", (F.greatest("a", "first") - F.col("first")).alias("start"), (F.least("b", "last") - F.col("first")).alias("stop"))


def retrieval_score(bm25: Column, rrf: Column, slots: Column, vector_rank: Column, mode: str = "reference") -> Column:
    """Fused score, except that a hit of one lexical slot and no vector keeps its own score; ``mode="rrf"`` never does."""
    return rrf if mode == "rrf" else F.when((slots == 1) & vector_rank.isNull(), bm25).otherwise(rrf)


def degradation(*codes: Column) -> Column:
    """Distinct codes that are set, joined by plus signs."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*codes))), "+")
