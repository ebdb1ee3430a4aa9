"""Structured Streaming: keeping an index in step, deduplicating events, and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.shared import shared_dir
from lorespan.sources.tables import newest_pointer, point_to, read_pointer, whole_folders


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lorespan-{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{name}.parquet*")


def drain(changes: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, once, and read the result back.

    In complete mode each batch is a folder of its own and the newest whole one is read, so a batch that is cut off leaves the one before.
    """
    spark = changes.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    if mode == "append":
        query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        query = changes.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode != "append":
        whole = whole_folders(spark, out)
        return spark.read.schema(changes.schema).parquet(whole[-1][1]) if whole else spark.createDataFrame([], changes.schema)
    return spark.read.schema(changes.schema).parquet(out)


def first_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One row of each key, as long as duplicates come within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def event_windows(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """An addition of this engine: counts and sums by event-time window and type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sync_index(changes: DataFrame, index_path: str, key: str, version: str, slices: int = 16):
    """A streaming query that keeps the newest version of each key, tombstones included, in ``index_path``.

    The index is cut into ``slices`` by the key's hash; a batch rewrites the slices that it touches and names the folder
    of every slice in a pointer of its own. Pointers are never overwritten and the newest one counts, so whenever a
    batch is cut off, the last whole one stays in force and the restarted batch gives the same index.
    """
    spark = changes.sparkSession
    cut = F.pmod(F.xxhash64(key), F.lit(slices))

    def merge(batch: DataFrame, number: int) -> None:
        at, places = newest_pointer(spark, f"{index_path}/pointers") or (-1, {})
        if at >= number:
            return
        row = F.struct(*batch.columns)
        newest = batch.groupBy(key).agg(F.max_by(row, version).alias("r")).select("r.*").withColumn("slice", cut)
        newest = newest.persist()
        touched = [r[0] for r in newest.select("slice").distinct().collect()]  # ``slices`` numbers at most
        held = [places[str(t)] for t in touched if str(t) in places]
        merged = newest
        if held:
            old = spark.read.schema(batch.schema).parquet(*held).withColumn("slice", cut)
            both = newest.unionByName(old.select(newest.columns))
            merged = both.groupBy("slice", key).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*", "slice")
        folder = f"{index_path}/batch={number}"
        merged.write.partitionBy("slice").mode("overwrite").parquet(folder)
        newest.unpersist()
        point_to(spark, f"{index_path}/pointers", number, places | {str(t): f"{folder}/slice={t}" for t in touched})

    return changes.writeStream.foreachBatch(merge)


def read_index(spark: SparkSession, index_path: str, schema) -> DataFrame:
    """The index as the newest pointer names it; empty before the first batch."""
    found = newest_pointer(spark, f"{index_path}/pointers")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(found[1].values()))


def sweep_index(spark: SparkSession, index_path: str, keep: int = 2) -> int:
    """Delete the slices that none of the ``keep`` newest pointers names, and older pointers; how many slices went.

    Slices of batches beyond the newest pointer stay: their batch may be at work. Readers of one of the kept pointers lose nothing.
    """
    pointers = whole_folders(spark, f"{index_path}/pointers")
    if not pointers:
        return 0
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(index_path).getFileSystem(spark._jsc.hadoopConfiguration())
    plain = lambda p: jvm_path(p).toUri().getPath()
    named = {plain(p) for _, folder in pointers[-keep:] for p in read_pointer(spark, folder).values()}
    gone = 0
    for number, folder in whole_folders(spark, index_path):
        if number > pointers[-1][0]:
            continue
        for f in files.listStatus(jvm_path(folder)):
            if f.isDirectory() and plain(f.getPath().toString()) not in named:
                files.delete(f.getPath(), True)
                gone += 1
    for _, folder in pointers[:-keep]:
        files.delete(jvm_path(folder), True)
    return gone
