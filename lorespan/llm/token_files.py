"""Token ids of a corpus as wavelet-matrix shards, in ascending id order.

A range shuffle brings documents into order without a global sort in one task; each task
encodes its range, closes a shard whenever it holds enough ids, and writes shard rows
(ids of documents, lengths, one wavelet-matrix blob) through Spark's writer into the shared
folder. Reading takes the blobs back apart. Ids before a document are the sums of whole
ranges, of earlier shards of its range, and of earlier documents of its shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorespan.llm.common import bounded_batches, read_bytes, shared_dir, slices, table
from lorespan.llm.encoding import encoder
from lorespan.llm.wavelet import WaveletMatrix

SHARD_TOKENS = 1 << 20
_SHARD = "part int, shard int, before long, doc_ids array<{0}>, lengths array<int>, blob binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending order of id.

    Null and empty texts are the end id alone. Null ids come first; rows of one id lie next to
    one another, ordered by a hash of their texts. A shard holds whole documents and closes once
    it has ``shard_tokens`` ids, so memory is bounded by that and the longest document. Nothing is
    written for an empty table but the schema.
    """
    bounded_batches(docs.sparkSession)
    model = read_bytes(tokenizer_path)
    id_type = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = picked.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(id_arrow)), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(model).encode, TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, lengths, held, size, before, shard = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), dtype="<u4")
            levels = max(1, int(values.max()).bit_length())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([part], [shard], [before], [ids], [lengths], [WaveletMatrix.build(values, levels).to_bytes()]), schema.types, strict=True)], schema=schema)

        for rows, texts in slices(batches):
            for doc_id, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                data = encode(text) + end
                ids.append(doc_id)
                lengths.append(len(data) // 4)
                held.append(data)
                size += len(data) // 4
                if size >= shard_tokens:
                    yield close()
                    before, shard = before + size, shard + 1
                    ids, lengths, held, size = [], [], [], 0
        if ids:
            yield close()

    ordered.mapInArrow(run, _SHARD.format(id_type)).write.parquet(path)


def part_offsets(shards: DataFrame) -> DataFrame:
    """(part, offset): ids in the ranges before each range; one row a range, so small enough for one task at any size."""
    ends = shards.select("part", (F.col("before") + _ids_of_shard()).alias("total"))
    parts = ends.groupBy("part").agg(F.max("total").alias("total"))
    return parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def _ids_of_shard() -> Column:
    return F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)


def token_at(spark: SparkSession, path: str, positions: DataFrame, bucket: int = SHARD_TOKENS) -> DataFrame:
    """(position, token) of every row of ``positions`` (position long): the id at that place of the whole corpus.

    Places are met with the extents of shards in buckets, and only shards that are asked for are opened. A null
    place, or one outside the corpus, gets a null token; repeated places get a row each.
    """
    shards = spark.read.parquet(path)
    start = F.col("before") + F.col("offset")
    extents = shards.join(F.broadcast(part_offsets(shards)), "part").select("part", "shard", start.alias("first"), (start + _ids_of_shard()).alias("last"))
    first, last = F.floor(F.col("first") / bucket), F.floor((F.col("last") - 1) / bucket)
    extents = extents.filter("last > first").withColumn("bucket", F.explode(F.sequence(first, last)))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bucket", F.floor(F.col("position") / bucket))
    placed = asked.join(extents, "bucket").filter("position >= first AND position < last").select("part", "shard", "position", (F.col("position") - F.col("first")).alias("inner"))
    per_shard = placed.distinct().groupBy("part", "shard").agg(F.collect_list("position").alias("positions"), F.collect_list("inner").alias("inner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob, places, inner in _rows(batches):
            matrix = WaveletMatrix.from_bytes(blob)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([matrix.access(i) for i in inner], pa.int64())], names=["position", "token"])

    got = shards.select("part", "shard", "blob").join(per_shard, ["part", "shard"]).select("blob", "positions", "inner").mapInArrow(run, "position long, token long")
    return asked.select("position").join(got, "position", "left")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the given ids stands in the corpus, by rank in every shard. ``tokens`` is a short list of the caller."""
    asked = sorted({int(t) for t in tokens})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (blob,) in _rows(batches):
            matrix = WaveletMatrix.from_bytes(blob)
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([matrix.count(t) for t in asked], pa.int64())], names=["token", "n"])

    counted = spark.read.parquet(path).select("blob").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return spark.createDataFrame([(t,) for t in asked], "token long").join(counted, "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, position): every place of the given ids in the corpus, by select in every shard. ``tokens`` is a short list of the caller."""
    asked = sorted({int(t) for t in tokens})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, before, blob in _rows(batches):
            matrix = WaveletMatrix.from_bytes(blob)
            for t in asked:
                places = [before + matrix.occurrence(t, j) for j in range(matrix.count(t))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), pa.array([t] * len(places), pa.int64()), pa.array(places, pa.int64())], names=["part", "token", "inner"])

    shards = spark.read.parquet(path)
    found = shards.select("part", "before", "blob").mapInArrow(run, "part int, token long, inner long")
    return found.join(F.broadcast(part_offsets(shards)), "part").select("token", (F.col("inner") + F.col("offset")).alias("position"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(batch.num_columns))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    offsets = part_offsets(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths = np.array(row.column(3)[0].values, dtype=np.int64)
                ids = WaveletMatrix.from_bytes(row.column(4)[0].as_py()).decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [row.column(2)[0].values, pa.array(np.full(n, row.column(0)[0].as_py()), pa.int32()), pa.array(starts + row.column(1)[0].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "part", "inner_start", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "before", "doc_ids", "lengths", "blob").mapInArrow(run, f"doc_id {id_type}, part int, inner_start long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "part").select("doc_id", (F.col("inner_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/lorespan-token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_token_files(spark, path)
