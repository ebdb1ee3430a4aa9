"""Approximate nearest neighbours over a written index of cells.

Centres are learnt on a bounded sample; every vector is written to the cell of its nearest centre, cut into blocks. A
query looks into the cells of its nearest centres only, and there at the vectors that its reader may see.
``retrieval.knn`` is the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.operators.retrieval import BLOCK, FOUND, block_rows, knn, nearest_in, ranked_found

#: Vectors that centres are learnt on at most (those of least hash of their ids), and rounds of learning.
SAMPLE, ROUNDS = 20_000, 10


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by rounds of assignment and mean; the first is the first vector, each further one the vector that is farthest from all before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(cells, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        cell = (2 * sample @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)
        for c in range(len(centres)):
            if (cell == c).any():
                centres[c] = sample[cell == c].mean(axis=0)
    return centres


def _in_cells(rows: pa.RecordBatch, centres: np.ndarray, metric: str, probes: int) -> np.ndarray:
    """The nearest cells of the vectors in the last column, nearest first."""
    v = np.array(rows.column(rows.num_columns - 1).to_pylist(), dtype="<f8").reshape(rows.num_rows, -1)
    v = _unit(v) if metric == "cosine" else v
    return np.argsort(-(2 * v @ centres.T - (centres * centres).sum(axis=1)), axis=1, kind="stable")[:, :probes]


def write_cells(vectors: DataFrame, path: str, cells: int, metric: str = "cosine", id_col: str = "vec_id") -> None:
    """Write an index of (vec_id, embedding) under a new path: centres, and every vector that is not null in its cell.

    About the square root of the number of vectors is a good number of cells; there are as many as the sample has vectors at most. Vectors are of one length.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropna()
    least = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    sample = np.array([r["embedding"] for r in least], dtype="<f8")
    centres = _centres(_unit(sample) if metric == "cosine" else sample, cells) if len(least) else np.zeros((0, 1))
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _in_cells(batch, shared.value, metric, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", "vec_id", "embedding"])

    placed = rows.mapInArrow(run, "cell int, vec_id long, embedding array<double>")
    # a cell's vectors lie in few files, those of a hot cell in several
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/vectors")


def probe_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, allowed: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest vectors of each query in its ``probes`` nearest cells.

    ``queries``: (query_id, embedding); ``allowed``: (vec_id) that may be found: others are left out before anything is ranked, so they take no
    place from those that may. Fewer than k come back where the cells hold fewer.
    """
    nearest = nearest_in(metric, k)
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], dtype="<f8")
    if not len(centres):
        return spark.createDataFrame([], f"{FOUND}, rank int")
    shared = spark.sparkContext.broadcast(centres)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropna()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _in_cells(batch, shared.value, metric, probes)
                at = np.repeat(np.arange(batch.num_rows), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), *(c.take(pa.array(at)) for c in batch.columns)], names=["cell", "query_id", "embedding"])

    def packed(rows: DataFrame, id_col: str, names: tuple[str, str]) -> DataFrame:
        """Blocks of BLOCK rows of one cell at most, packed where the rows are; rows lie in the order of cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                    for at in range(a, b, BLOCK):
                        part = batch.slice(at, min(BLOCK, b - at))
                        data = [np.array(part.column(i).to_pylist(), kind).tobytes() for i, kind in ((1, "<i8"), (2, "<f8"))]
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), *[pa.array([d]) for d in data]], names=["cell", *names])

        return rows.select("cell", id_col, "embedding").sortWithinPartitions("cell").mapInArrow(run, f"cell int, {names[0]} binary, {names[1]} binary")

    chosen = asked.mapInArrow(choose, "cell int, query_id long, embedding array<double>")
    there = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("int"))
    if allowed is not None:
        there = there.join(allowed.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    met = packed(chosen, "query_id", ("q_ids", "q_vecs")).join(packed(there, "vec_id", ("ids", "vecs")), "cell").select("q_ids", "q_vecs", "ids", "vecs")
    return ranked_found(met.mapInArrow(lambda batches: nearest(block_rows(batches, 4)), FOUND), k, metric)


def probes_needed(spark: SparkSession, path: str, vectors: DataFrame, k: int, target: float = 0.9, sample: int = 200, metric: str = "cosine") -> int:
    """The fewest probes with which ``sample`` of the vectors (those of least hash of their ids) find at least ``target`` of their k exact neighbours.

    Every neighbour lies in one cell, and that cell has a place in its query's order of cells: the answer is the least place
    below which enough of them lie. ``vectors``: (vec_id, embedding), those of the index.
    """
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], dtype="<f8")
    asked = vectors.dropna(subset=["embedding"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select(F.col("vec_id").alias("query_id"), "embedding")
    exact = knn(vectors, asked, k, metric).select("query_id", "vec_id")
    cell_of = spark.read.parquet(f"{path}/vectors").select("vec_id", F.col("cell").cast("int").alias("cell"))
    shared = spark.sparkContext.broadcast(centres)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_in_cells(batch, shared.value, metric, len(shared.value)).tolist(), pa.list_(pa.int32()))], names=["query_id", "cells"])

    orders = asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(order, "query_id long, cells array<int>")
    placed = exact.join(cell_of, "vec_id").join(orders, "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    counts = sorted((r["place"], r["n"]) for r in placed.collect())  # a row a cell at most
    total, found = sum(n for _, n in counts), 0
    for place, n in counts:
        found += n
        if found >= target * total:
            return int(place)
    return max(1, len(centres))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact pairs (query_id, vec_id) that were found; null without exact ones."""
    hit = exact.select("query_id", "vec_id").distinct().join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return hit.agg((F.count("hit") / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)))).alias("recall"))
