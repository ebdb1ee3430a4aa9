"""Queries of the retrieval operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.operators import ann
from lorespan.operators import retrieval as R
from lorespan.operators.answering import answer_search
from lorespan.shared import shared_dir
from lorespan.sources.tables import read

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_STOP = "('a','an','and','are','as','at','be','by','did','do','does','for','from','had','has','have','how','in','is','of','on','or','that','the','to','was','were','what','when','where','which','who','with')"
_BM25 = rf"""
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark) WHERE (length(term) >= 3 OR regexp_matches(term, '^[0-9]+$')) AND term NOT IN {_STOP}),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), stats GROUP BY query_id, doc_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25)
"""
_KNN = """
qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT query_id, vec_id, round(list_dot_product(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS score FROM qv, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.rank(R.bm25(read(spark, d, "documents"), _queries(spark, d)), k)


def _near(spark: SparkSession, d: str, k: int, seen: DataFrame | None = None) -> DataFrame:
    v = read(spark, d, "embeddings")
    allowed = v if seen is None else v.join(seen.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return R.knn(allowed, v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), k)


def j1_bm25_top50(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 50)


def j3_knn_top10(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, 10)


def j3_ann_top10(spark: SparkSession, d: str) -> DataFrame:
    """Ten neighbours by an index of cells, of which as many are probed as a sample needs for a recall of 0.95."""
    v = read(spark, d, "embeddings")
    path = f"{shared_dir(spark)}/lorespan-cells-{uuid.uuid4().hex}"
    ann.write_cells(v, path, max(4, round(v.count() ** 0.5)))
    asked = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return ann.probe_cells(spark, path, asked, 10, ann.probes_needed(spark, path, v, 10, 0.95))


def j5_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Lexical ranks fused with those of a vector branch that stands in by id."""
    near = _near(spark, d, 50).withColumnRenamed("vec_id", "doc_id")
    return R.rank(R.fuse([(_lexical(spark, d, 50), 1.0), (near, 1.0)]), 8)


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Access, BM25, vectors, fusion, first eight with ties by id: the whole of a hybrid search."""
    docs = R.visible(read(spark, d, "documents"), "src1", F.col("lang") == "en")
    lexical = R.rank(R.bm25(docs, _queries(spark, d)), 50)
    near = _near(spark, d, 50, docs).withColumnRenamed("vec_id", "doc_id")
    return R.rank(R.fuse([(lexical, 1.0), (near, 1.0)]), 8).select("query_id", "doc_id", F.col("score").alias("rrf"), "rank")


def search_answers(spark: SparkSession, d: str, rounds: int = 2) -> DataFrame:
    """A whole search, with a reranker that prefers short texts; groups of four documents share a parent."""
    docs = R.visible(read(spark, d, "documents"), "src1", F.col("lang") == "en")
    docs = docs.select("doc_id", F.col("doc_id").alias("document"), F.col("source").alias("title"), "text", F.floor(F.col("n_chars") / 4).cast("int").alias("tokens"), F.floor(F.col("doc_id") / 4).alias("parent_id"), (F.col("doc_id") % 900).cast("int").alias("parent_tokens"))
    v = read(spark, d, "embeddings")
    asked = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = answer_search(_queries(spark, d), docs, lambda c: c.select("query_id", "index", F.round(1.0 / (1 + F.length("text")), 6).alias("score")), v, asked.join(_queries(spark, d).select("query_id"), "query_id", "left_semi"), rounds=rounds)
    return found.select("query_id", "rank", "doc_id", "rounds")


def search_one_round(spark: SparkSession, d: str) -> DataFrame:
    return search_answers(spark, d, 1)


def c1_visible_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = R.visible(read(spark, d, "documents"), "src1", F.col("lang") == "en")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"))


def q6_ndcg10(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the query's label are of grade 2, those of the next label of grade 1."""
    v = read(spark, d, "embeddings")
    label = v.select("vec_id", F.col("label").cast("long").alias("label"))
    want = label.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    grade = F.when(F.col("label") == F.col("want"), 2).when(F.col("label") == F.col("want") + 1, 1).otherwise(0)
    ranked = _near(spark, d, 10).join(label, "vec_id").join(want, "query_id").select("query_id", "rank", grade.alias("grade"))
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    grades = want.select("query_id", F.explode(F.array(F.struct(F.col("want").alias("label"), F.lit(2).alias("grade")), F.struct((F.col("want") + 1).alias("label"), F.lit(1).alias("grade")))).alias("g")).select("query_id", "g.*").join(sizes, "label").drop("label")
    return R.ndcg(ranked, grades)


def q5_hit_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    near = _near(spark, d, 10)
    lab = v.select("vec_id", "label")
    hit = near.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").withColumn("rel", (F.col("label") == F.col("want")) & (F.col("vec_id") != F.col("query_id")))
    per = hit.groupBy("query_id").agg(F.max("rel").alias("hit"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.count_if("rel").alias("n"))
    return per.select("query_id", F.col("hit").cast("int").alias("hit_at_10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_10"), F.round(F.col("n") / 10, 6).alias("precision_at_10"))


QUERIES = {
    "j1_bm25_top50": (j1_bm25_top50, f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lexical WHERE rank <= 50"),
    "j3_ann_top10": (j3_ann_top10, None),
    "j3_knn_top10": (j3_knn_top10, f"WITH {_KNN} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 10"),
    "j5_rrf": (
        j5_rrf,
        f"""WITH {_BM25}, {_KNN}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank FROM near WHERE rank <= 50) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 8""",
    ),
    "search_hybrid": (
        search_hybrid,
        f"""WITH seen AS (SELECT * FROM documents WHERE lang = 'en' OR source = 'src1'), {_BM25.replace("FROM documents", "FROM seen")}, {_KNN.replace("FROM qv, embeddings", "FROM qv, embeddings WHERE vec_id IN (SELECT doc_id FROM seen)")},
        f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank FROM near WHERE rank <= 50) GROUP BY ALL),
        r AS (SELECT query_id, doc_id, score AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 8""",
    ),
    "search_answers": (search_answers, None),
    "search_one_round": (
        search_one_round,
        f"""WITH seen AS (SELECT * FROM documents WHERE lang = 'en' OR source = 'src1'), {_BM25.replace("FROM documents", "FROM seen")}, {_KNN.replace("FROM qv, embeddings", "FROM qv, embeddings WHERE query_id IN (SELECT item_id FROM benchmark) AND vec_id IN (SELECT doc_id FROM seen)")},
        h AS (SELECT query_id, doc_id, rank, score, 0 AS v FROM lexical WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank, NULL, 1 FROM near WHERE rank <= 50),
        f AS (SELECT query_id, doc_id, CASE WHEN max(v) = 0 THEN max(score) ELSE round(sum(1.0 / (60 + rank)), 9) END AS score FROM h GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM f),
        t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (1 + length(text)), 6) DESC, place) AS rank FROM r JOIN documents USING (doc_id) WHERE place <= 20)
        SELECT query_id, rank, doc_id, 1 AS rounds FROM t WHERE rank <= 8""",
    ),
    "c1_visible_counts": (c1_visible_counts, "SELECT lang, source, count(*) AS n_docs FROM documents WHERE lang = 'en' OR source = 'src1' GROUP BY ALL"),
    "q6_ndcg10": (
        q6_ndcg10,
        f"""WITH {_KNN}, g AS (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN v.label = q.label THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings v ON v.label = q.label OR v.label = q.label + 1 WHERE q.vec_id % 20 = 0),
        o AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM g),
        i AS (SELECT query_id, sum((2 ** grade - 1) / log2(i + 1.0)) AS ideal FROM o WHERE i <= 10 GROUP BY query_id),
        c AS (SELECT n.query_id, sum((2 ** grade - 1) / log2(rank + 1.0)) AS dcg FROM near n JOIN g ON g.query_id = n.query_id AND g.vec_id = n.vec_id WHERE rank <= 10 GROUP BY n.query_id)
        SELECT query_id, round(coalesce(dcg, 0.0) / ideal, 6) AS ndcg FROM i LEFT JOIN c USING (query_id)""",
    ),
    "q5_hit_recall_mrr": (
        q5_hit_recall_mrr,
        f"""WITH {_KNN}, h AS (SELECT n.query_id, rank, (a.label = b.label AND a.vec_id <> b.vec_id) AS rel FROM near n JOIN embeddings a ON a.vec_id = n.vec_id JOIN embeddings b ON b.vec_id = n.query_id WHERE rank <= 10)
        SELECT query_id, CAST(max(rel) AS INT) AS hit_at_10, round(coalesce(1.0 / min(CASE WHEN rel THEN rank END), 0.0), 6) AS mrr_at_10, round(count(*) FILTER (rel) / 10.0, 6) AS precision_at_10 FROM h GROUP BY query_id""",
    ),
}
