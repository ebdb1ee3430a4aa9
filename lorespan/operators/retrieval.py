"""Retrieval: access, BM25, exact nearest neighbours, rank fusion, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions.text import han_bigrams, query_terms, words
from lorespan.shared import materialize, spread

#: A stated set of query terms, or of packed query vectors, of at most so many bytes is broadcast; beyond that joins are the planner's.
BROADCAST_BYTES = 64 << 20
#: Vectors of a packed block, and slices of the vectors where queries are too many to be broadcast.
BLOCK, SLICES = 512, 64


def visible(docs: DataFrame, user: str, public: Column, owner: str = "source", grants: DataFrame | None = None) -> DataFrame:
    """Documents that are public, owned by the user, or granted to the user (doc_id, user_id)."""
    allowed = public | (F.col(owner) == user)
    if grants is None:
        return docs.filter(allowed)
    own = grants.filter(F.col("user_id") == user).select(F.col("doc_id"), F.lit(True).alias("granted")).distinct()
    return docs.join(own, "doc_id", "left").filter(allowed | F.col("granted")).drop("granted")


def current(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of (doc_id, revision_id, ...) whose revision is the ready, current one of a document that is not deleted.

    ``heads``: (doc_id, current_revision_id, deleted, status).
    """
    live = heads.filter(~F.col("deleted") & (F.col("status") == "READY")).select("doc_id", F.col("current_revision_id").alias("revision_id"))
    return docs.join(live, ["doc_id", "revision_id"], "left_semi")


def reauthorized(candidates: DataFrame, authorizations: DataFrame) -> DataFrame:
    """Candidates whose document, revision and access version are those that the user is authorised for now."""
    return candidates.join(authorizations.select("doc_id", "revision_id", "acl_version").distinct(), ["doc_id", "revision_id", "acl_version"], "left_semi")


# Words that an English index leaves out, and endings that it drops.
ENGLISH_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def analyze(text: Column, analyzer: str = "plain") -> Column:
    """Terms of a text. ``plain``: lower-case words; ``cjk``: Han words as pairs of characters besides; ``english``: without
    stop words, and plural endings dropped (ies to y, es behind s, x, z, ch or sh, s but behind s, u or i)."""
    found = words(text)
    if analyzer == "cjk":
        return F.flatten(F.transform(found, lambda w: F.when(w.rlike(r"\p{IsHan}"), han_bigrams(w)).otherwise(F.array(w))))
    if analyzer == "english":
        kept = F.filter(found, lambda w: ~w.isin(*ENGLISH_STOPS))

        def stem(w: Column) -> Column:
            singular = F.when(w.rlike("^[a-z]{2,}ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("^[a-z]+([sxz]|[cs]h)es$"), F.regexp_replace(w, "es$", ""))
            return singular.when(w.rlike("^[a-z]+[^sui]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)

        return F.transform(kept, stem)
    return found


def postings(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "plain") -> DataFrame:
    """(term, doc_id, tf, dl): the inverted index, of the given terms only; each document also has a row with a null term, for its length.

    Texts are cut once; what the terms don't ask for leaves in the task that cut it, before anything is shuffled.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), analyze(F.col(text_col), analyzer).alias("w"))
    flat = cut.select("doc_id", F.size("w").alias("dl"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    if terms is not None:
        asked = terms.select("term", F.lit(True).alias("asked")).distinct()
        size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
        flat = flat.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "term", "left").filter("asked OR term IS NULL")
    return flat.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, analyzer: str = "plain", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score) for every document that holds a query term.

    ``queries``: (query_id, text), a stated set. The postings of the query terms are written once; lengths, document
    frequencies and scores come from them.
    """
    hits, weights = _weighed(docs, queries, 0, analyzer, text_col)
    return _scored(hits, weights, k1, b).select("query_id", "doc_id", "score")


def _weighed(docs: DataFrame, queries: DataFrame, field: int, analyzer: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Postings (field, term, doc_id, tf, dl) of a field, and weights (field, query_id, term, df, idf, avgdl); both are written."""
    cut = query_terms(F.col("text")) if analyzer == "plain" else F.array_distinct(analyze(F.col("text"), analyzer))
    terms = queries.select("query_id", F.explode(cut).alias("term"))
    found = materialize(postings(docs, terms, text_col=text_col, analyzer=analyzer).withColumn("field", F.lit(field)), "postings")
    stats = found.filter("term IS NULL").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = found.filter("term IS NOT NULL")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats)).select(F.lit(field).alias("field"), "query_id", "term", "df", idf.alias("idf"), "avgdl")  # one row of totals
    return hits, materialize(weights, "weights")


def _scored(hits: DataFrame, weights: DataFrame, k1: float, b: float) -> DataFrame:
    """(field, query_id, doc_id, score) of postings under the weights of their terms, dealt by document: what follows by document needs no shuffle."""
    made = weights.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("bytes")).first()
    if made["bytes"] <= BROADCAST_BYTES:
        met = spread(hits, made["rows"], "doc_id").join(F.broadcast(weights), ["field", "term"])
    else:
        met = spread(hits.join(weights, ["field", "term"]), made["rows"], "doc_id")
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("field", "query_id", "doc_id").agg(F.round(F.sum(F.col("idf") * saturation), 6).alias("score"))


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: list[tuple[str, str, float]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): the best of the fields' scores, each (column, analyzer, boost)."""
    parts = [_weighed(docs, queries, i, analyzer, column) for i, (column, analyzer, _) in enumerate(fields)]
    hits, weights = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    boost = F.element_at(F.array(*[F.lit(float(x)) for _, _, x in fields]), F.col("field") + 1)
    scored = _scored(hits, weights, k1, b).withColumn("score", F.col("score") * boost)
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))


def rank(scored: DataFrame, k: int | None = None, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "doc_id") -> DataFrame:
    """1-based ranks by falling score and rising tie column; the first k of each group if k is given."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


def packed(vectors: DataFrame, id_col: str, n_blocks: int | None = None) -> DataFrame:
    """(block, ids, vecs): vectors as blocks of binary rows; of ``n_blocks`` by hash of the id, or as they come (block 0). Null vectors are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).dropna()
    kind = "block int, ids binary, vecs binary"

    def pack(ids: list[int], vecs: list, block: int) -> pa.RecordBatch:
        data = [np.array(ids, "<i8").tobytes(), np.array(vecs, "<f8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([d]) for d in data]], names=["block", "ids", "vecs"])

    if n_blocks is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 8 * BLOCK):
                    part = batch.slice(at, 8 * BLOCK)
                    yield pack(part.column(0).to_pylist(), part.column(1).to_pylist(), 0)

        return rows.mapInArrow(run, kind)
    by_block = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(lambda t: pa.Table.from_batches([pack(t.column("id").to_pylist(), t.column("v").to_pylist(), t.column("block")[0].as_py())]), kind)
    return by_block


def nearest_in(metric: str, k: int) -> Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]:
    """From (q_ids, q_vecs, ids, vecs), blocks of queries beside blocks of vectors, the best k of each query among what one task sees."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(metric)

    def nearest(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, ...]] = {}  # of each block of queries: place of the query, vector, score
        rows = 0
        for q_ids, q_vecs, ids, vecs in blocks:
            q_id, v_id = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
            q, v = np.frombuffer(q_vecs, "<f8").reshape(len(q_id), -1), np.frombuffer(vecs, "<f8").reshape(len(v_id), -1)
            if metric == "l2":
                s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0))
            else:
                s = q @ v.T
                if metric == "cosine":
                    norm = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1))[None]
                    s = np.divide(s, norm, out=np.full_like(s, -2.0), where=norm > 0)
            s = np.round(s, 6)
            few = np.ones(s.shape, dtype=bool) if len(v_id) <= k else s >= np.partition(s, -k, axis=1)[:, [-k]]
            at, col = np.nonzero(few)
            found = at, v_id[col], s[at, col]
            before = held.get(q_ids)
            if before is not None:
                found = tuple(np.concatenate(p) for p in zip(before, found, strict=True))
                rows -= len(before[0])
            held[q_ids] = best = _best(*found, k)
            rows += len(best[0])
            if rows > 500_000:  # more queries than a task should hold
                yield from (_found(*item) for item in held.items())
                held, rows = {}, 0
        yield from (_found(*item) for item in held.items())

    return nearest


def _found(q_ids: bytes, best: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, "<i8")[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])


def _best(at: np.ndarray, v_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each place by falling score, then by rising id."""
    order = np.lexsort((v_id, -score, at))
    at = at[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], v_id[order][first], score[order][first]


def block_rows(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True)


FOUND = "query_id long, vec_id long, score double"


def ranked_found(found: DataFrame, k: int, metric: str) -> DataFrame:
    return rank(found.filter("score > -2") if metric == "cosine" else found, k, tie="vec_id")


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest vectors of each query, exactly.

    ``queries``: (query_id, embedding), a stated set, is packed into blocks of about BLOCK by hash; so are the vectors, as
    they are read, in one scan. Up to ``broadcast_bytes`` of queries go to every task, which holds each block of vectors against them; beyond, blocks
    of queries meet blocks of vectors by a shuffle, whose keys are a block of queries and a slice of the vectors. Each task keeps its own best k of each
    query; the best of those are ranked. Zero and null vectors have no neighbours under cosine. Access rules apply to ``vectors`` before they come here.
    """
    nearest, spark = nearest_in(metric, k), vectors.sparkSession
    n = queries.count()
    if not n:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    n_blocks = -(-n // BLOCK)
    asked = materialize(packed(queries, "query_id", n_blocks).select("block", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("q_vecs") + F.octet_length("q_ids")), F.lit(0))).first()[0]
    blocks = packed(vectors, "vec_id").select("ids", "vecs")
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([(bytes(r["q_ids"]), bytes(r["q_vecs"])) for r in asked.select("q_ids", "q_vecs").collect()])

        def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from nearest((*q, *v) for v in block_rows(batches, 2) for q in shared.value)

        found = blocks.mapInArrow(against_all, FOUND)
    else:
        sliced = blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(SLICES))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        everywhere = asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))
        met = sliced.join(everywhere, ["block", "slice"]).select("q_ids", "q_vecs", "ids", "vecs")
        found = met.mapInArrow(lambda batches: nearest(block_rows(batches, 4)), FOUND)
    return ranked_found(found, k, metric)


def fuse(branches: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked branches (query_id, doc_id, rank), each with its weight."""
    parts = [b.select("query_id", "doc_id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for b, w in branches]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))


def ndcg(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """Q-6: normalised gain of the first k ranks.

    ``ranked``: (query_id, rank, grade), grade 0 for what is of no use; ``grades``: (query_id, grade, n): how many documents have
    each grade for a query, which tells the best order, so no group is ranked whole.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    found = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = grades.withColumn("before", before).filter(F.col("before") < k).withColumn("place", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k)))))
    best = places.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("ideal"))
    return best.join(found, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))
