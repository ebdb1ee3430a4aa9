"""Joins, aggregates, windows and paging in the forms that the engine's queries need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.shared import materialize

def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order that leaves no ties."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_last(df: DataFrame, keys: list[str], value: str, order: Column, names: tuple[str, str]) -> DataFrame:
    """The values of the first and the last row of each key; one partial aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(names[0]), F.max_by(value, order).alias(names[1]))


def running_before(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Sum over the rows before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def either_endpoint(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once from either end, in one pass over the edges and by no disjunctive join."""
    rest = [c for c in edges.columns if c not in (a, b)]
    end = lambda node, other, direction: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(direction).alias("direction"))
    return edges.select(F.explode(F.array(end(a, b, "OUT"), end(b, a, "IN"))).alias("end"), *rest).select("end.node", "end.other", "end.direction", *rest)


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p n)-th smallest value; values of one group must fit in memory, so pre-aggregate large groups."""
    values = F.array_sort(F.collect_list(value))
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.size(values))).cast("int"))


def floor_rank(value: str, p: float) -> Column:
    """The value at index floor((n - 1) p)."""
    values = F.array_sort(F.collect_list(value))
    return F.element_at(values, (F.floor((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def percentiles_by_counts(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """E10 for groups of any size: values are counted first and ranked by running counts."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return ranked.filter(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all")))).groupBy(*keys).agg(F.min(value).alias(name))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``number``: their place from 0 in ascending order of ``by``, nulls first, without a task that sees all rows."""
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row a partition
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, before = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(before)]
        before += n
    first = F.create_map(*starts)[part] if starts else F.lit(0)
    return placed.withColumn("number", (first + place).cast("long")).drop("_at")


def percentiles_cont(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, and a column for each share by its name): interpolated percentiles of groups of any size; null values don't count.

    Rows are numbered in the order of key and value; a percentile lies between the two rows whose numbers surround its place, so no
    task holds a group.
    """
    placed = numbered(df.select(key, value).filter(F.col(value).isNotNull()), key, value)
    groups = placed.groupBy(key).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    wanted = groups.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for name, p in shares.items()])).alias("w"), "first").select(key, "first", "w.*")
    ends = wanted.select(key, "name", "at", "first", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place")).withColumn("number", F.col("first") + F.col("place"))
    part = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("at")))
    met = ends.join(placed.select("number", F.col(value).alias("v")), "number")
    return met.groupBy(key).agg(*[F.sum(F.when(F.col("name") == name, part * F.col("v"))).alias(name) for name in shares])


def ratio(a: Column, b: Column) -> Column:
    """A / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def page_after(df: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """G4, G7, D: n + 1 rows after a key, in key order; the extra row tells that there are more."""
    if after is not None:
        df = df.filter(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*keys).limit(n + 1)


def page(df: DataFrame, order: list[Column], number: int, size: int, window: int = 10000) -> DataFrame:
    """A page by offset; pages end at the result window."""
    size = max(1, min(size, window))
    start = min(max(0, number) * size, window - size)
    return df.orderBy(*order).offset(start).limit(size)


def merge_maps(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """D15, Q-9: values of either side, 0 where a side has none, and their difference."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return both.select(key, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def islands(df: DataFrame, keys: list[str], order: str, boundary: Column, name: str) -> DataFrame:
    """numbers of runs; a row with the boundary opens a new one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def set_hash(df: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """SHA-256 of the sorted items of each key."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ""), 256).alias(name))


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values; a parameter that is None asks for nothing, and leaves no trace in the plan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df
