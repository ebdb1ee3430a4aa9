"""Reading tables and publishing index generations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A delimited file whose delimiter is known; all columns are strings, malformed rows are kept."""
    return spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("mode", "PERMISSIVE").csv(path)


def read_json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation catalogue: one row per case, with the file's hash."""
    files = spark.read.format("binaryFile").load(path)
    doc = F.from_json(F.decode("content", "UTF-8"), "version string, language string, cases array<struct<caseKey string, input string, expected string>>")
    return files.select("path", F.sha2("content", 256).alias("sha256"), doc.alias("doc")).select("path", "sha256", "doc.version", "doc.language", F.explode("doc.cases").alias("case")).select("path", "sha256", "version", "language", "case.*")


def upsert_catalogue(known: DataFrame, read: DataFrame) -> DataFrame:
    """(dataset, version, caseKey, sha256, input, expected, change): a catalogue after the cases of files were read into it.

    Both have (dataset, version, caseKey, sha256, input, expected), sha256 that of the whole dataset's files. A version that is new is ADDED; one read again
    with the same hash is SAME; one with another hash is CONFLICT and stays as it was, as versions don't change. What wasn't read is KEPT. Of cases that
    a version has twice the first by input counts.
    """
    once = Window.partitionBy("dataset", "version", "caseKey").orderBy("input", "expected")
    columns = ["dataset", "version", "caseKey", "sha256", "input", "expected"]
    fresh = read.withColumn("n", F.row_number().over(once)).filter("n = 1").select(*columns)
    versions = known.select("dataset", "version", F.col("sha256").alias("was")).distinct()
    added = fresh.join(versions, ["dataset", "version"], "left_anti").withColumn("change", F.lit("ADDED"))
    again = fresh.select("dataset", "version", F.col("sha256").alias("now")).distinct()
    change = F.when(F.col("now").isNull(), "KEPT").when(F.col("now") == F.col("sha256"), "SAME").otherwise("CONFLICT")
    return known.select(*columns).join(again, ["dataset", "version"], "left").select(*columns, change.alias("change")).unionByName(added.select(*columns, "change"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A1: files with their hash and the format that their first bytes show."""
    head = F.hex(F.substring("content", 1, 4))
    shown = F.when(head == "25504446", "PDF").when(head == "504B0304", "ZIP").when(head.startswith("EFBBBF"), "TEXT_BOM").otherwise("TEXT")
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), shown.alias("format"), "content")


def write_generation(df: DataFrame, path: str, generation: int) -> None:
    """One generation of an index projection, as a partition of its own; other generations stay."""
    df.withColumn("index_generation", F.lit(generation)).write.partitionBy("index_generation").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def point_to(spark: SparkSession, path: str, number: int, target: dict[str, str]) -> None:
    """Write pointer ``number`` as a folder of its own; what is there stays, so readers always find a whole one."""
    spark.createDataFrame([(json.dumps(target),)], "target string").coalesce(1).write.mode("overwrite").text(f"{path}/number={number}")


def whole_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and paths of the folders name=number under a path that were written to their end, ascending."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    place = jvm_path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [f.getPath() for f in files.listStatus(place) if f.isDirectory()]
    return sorted((int(p.getName().split("=")[1]), p.toString()) for p in found if "=" in p.getName() and files.exists(jvm_path(p, "_SUCCESS")))


def newest_pointer(spark: SparkSession, path: str) -> tuple[int, dict[str, str]] | None:
    """Number and target of the newest whole pointer; None before the first."""
    whole = whole_folders(spark, path)
    return (whole[-1][0], read_pointer(spark, whole[-1][1])) if whole else None


def read_pointer(spark: SparkSession, folder: str) -> dict[str, str]:
    return json.loads(spark.read.text(folder).first()[0])


def publish(spark: SparkSession, path: str, generation: int) -> None:
    """Move the pointer to a generation. Each move is a pointer of its own and the newest counts, so a move is whole or not there."""
    last = newest_pointer(spark, path)
    point_to(spark, path, last[0] + 1 if last else 0, {"generation": str(generation)})


def published(spark: SparkSession, index_path: str, pointer_path: str) -> DataFrame:
    """The generation the pointer names; its partition alone is read."""
    generation = int(newest_pointer(spark, pointer_path)[1]["generation"])
    return spark.read.parquet(index_path).filter(F.col("index_generation") == generation).drop("index_generation")


def sample_by_hash(df: DataFrame, id_col: str, k: int, group: Column | None = None) -> DataFrame:
    """The k rows of least SHA-256 of the id, in each group."""
    keyed = df.withColumn("hash", F.sha2(F.col(id_col).cast("string"), 256))
    if group is None:
        return keyed.orderBy("hash").limit(k)
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("hash"))).filter(F.col("n") <= k).drop("n")


def fingerprint(*fields: str) -> str:
    """SHA-256 of NUL-terminated fields."""
    return hashlib.sha256("".join(f"{f}\0" for f in fields).encode()).hexdigest()
