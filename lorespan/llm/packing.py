"""Best-fit decreasing packing of token sequences, planned on lengths and carried out by Spark.

Pieces of one length are interchangeable, so best-fit decreasing needs their number per
length only: at most ``capacity`` numbers, whatever the size of the corpus. The driver packs
these runs of equal pieces with a segment tree over remaining capacities that names the
tightest open bins in logarithmic time; a run goes to as many bins of that capacity as there
are at once. The plan has rows (length, first rank, number, first bin, offset), and Spark
gives each piece its rank within its length and looks its bin up. Hot lengths are salted:
ranks are counted within (length, salt) and shifted by the sizes of earlier salts.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.llm.common import BATCH_BYTES, map_texts, materialize, read_bytes, table
from lorespan.llm.encoding import CACHE_ENTRIES, encoder

CAPACITY = 2048
#: Pieces that one rank-counting group should have; sets the number of salts.
GROUP_ROWS = 20_000


class CapacityTree:
    """Numbers of open bins by remaining capacity, with the least capacity >= x that has any in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.counts = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = self.size + remaining
        while i:
            self.counts[i] += bins
            i >>= 1

    def tightest(self, need: int) -> int:
        """Least remaining capacity >= need with an open bin, or -1."""
        i = self.size + need
        if self.counts[i]:
            return need
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan_bins(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (length, number of pieces): rows (length, first_rank, number, first_bin, offset).

    Pieces first_rank .. first_rank + number - 1 of that length go to bins first_bin ..., each at ``offset``.
    """
    tree, free = CapacityTree(capacity), [[] for _ in range(capacity + 1)]  # free: runs (first bin, number) by remaining capacity
    plan, bins = [], 0
    for length, number in sorted(lengths, reverse=True):
        rank = 0
        while rank < number:
            left, remaining = number - rank, tree.tightest(length)
            if remaining < 0:  # nothing fits: new bins, as many as the pieces left need
                remaining = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = free[remaining].pop()
                tree.add(remaining, -n)
            # the tightest bin stays the tightest until it is full, so each takes all that fit before the next gets any
            each = remaining // length
            full = min(n, left // each)
            if not full:
                each, full = left, 1
            for k in range(each):
                plan.append((length, rank, full, first, capacity - remaining + k * length))
                rank += full
            for at, run, rest in ((first, full, remaining - each * length), (first + full, n - full, remaining)):
                if run and rest < capacity:
                    free[rest].append((at, run))
                    tree.add(rest, run)
                elif run:  # opened, but not needed after whole bins: the odd pieces come next
                    bins -= run
    return plan


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def document_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", entries: int = CACHE_ENTRIES, most: int = 2 * BATCH_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces (ids, then ``end_id``)."""
    model = read_bytes(tokenizer_path)
    end = np.array([end_id], dtype="<u4").tobytes()

    def compute(texts: list[str]) -> list:
        encode, out = encoder(model, entries).encode, []
        for text in texts:
            data = encode(text) + end
            out.append([x for s, n in cut(len(data) // 4, capacity) for x in (s, n, zlib.crc32(data[4 * s : 4 * (s + n)]))])
        return [out]

    flat = map_texts(docs, compute, [("pieces", "array<long>")], id_col, text_col, most=most)
    pieces = F.transform(F.sequence(F.lit(0), (F.size("pieces") / 3 - 1).cast("int")), lambda i: F.struct(i.alias("piece"), *[F.get("pieces", i * 3 + k).alias(n) for k, n in enumerate(("start", "length", "ids_crc32"))]))
    return flat.select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", entries: int = CACHE_ENTRIES, most: int = 2 * BATCH_BYTES) -> DataFrame:
    """Pack all documents into as few sequences as best-fit decreasing finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are the end id alone; only documents longer than ``capacity`` are cut. Repeated rows are
    packed one by one; null ids are kept; an empty table gives no rows. ``entries`` and ``most`` trade a worker's
    memory for time: words remembered, bytes of an Arrow batch.
    """
    spark = docs.sparkSession
    pieces = materialize(document_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, entries, most), "pieces")
    counts = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most ``capacity`` rows
    salts = max(1, -(-max((n for _, n in counts), default=0) // GROUP_ROWS))
    plan = spark.createDataFrame(plan_bins(counts, capacity), "length long, first_rank long, number long, first_bin long, offset long")
    plan = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "number", "first_bin", "offset"))).alias("runs"))
    # equal rows may swap places without changing the result, so these hashes are a full order
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    shift = shift.withColumn("shift", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = ranked.join(shift, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("shift")).join(F.broadcast(plan), "length")
    run = F.get(F.filter("runs", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["first_rank"] + r["number"])), F.lit(0))
    placed = placed.withColumn("run", run)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.first_bin") + F.col("rank") - F.col("run.first_rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
