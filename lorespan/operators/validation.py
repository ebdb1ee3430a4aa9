"""§2.S: rules that hold for stored rows, as relations of their violations, and writes that publish only what keeps them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lorespan.functions.text import utf16_length

# Statuses that may follow one another, and messages.
LEGAL = (("BUILDING", "READY"), ("BUILDING", "FAILED"), ("READY", "ACTIVE"), ("READY", "FAILED"), ("ACTIVE", "RETIRED"), ("RETIRED", "ACTIVE"), ("RETIRED", "DELETED"), ("FAILED", "DELETED"))
INCOMPLETE, NO_MENTION, NO_EVIDENCE = "Graph generation is incomplete", "Every graph entity must have an evidence mention", "Every graph relationship must have evidence"
UNITS_APART, OUT_OF_BOUNDS = "source locator units are inconsistent", "source locator offsets exceed canonical SourceUnit bounds"


class Violated(RuntimeError):
    """A write that breaks rules; ``counts`` has the broken rules with their rows."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in counts.items()))
        self.counts = counts


def illegal_transitions(log: DataFrame, legal: tuple[tuple[str, str], ...] = LEGAL, first: tuple[str, ...] = ("BUILDING",)) -> DataFrame:
    """(entity, number, before, status) of the rows of a log (entity, number, status) whose status may not follow the one before; before is null at the start.

    A repeated status is no move. Rows of one entity are put in order by number; a null status is illegal.
    """
    before = F.lag("status").over(Window.partitionBy("entity").orderBy("number"))
    moves = log.select("entity", "number", "status", before.alias("before"), F.row_number().over(Window.partitionBy("entity").orderBy("number")).alias("n"))
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in legal])
    may = F.when(F.col("n") == 1, F.col("status").isin(*first)).otherwise((F.col("before") == F.col("status")) | F.exists(known, lambda m: (m["a"] == F.col("before")) & (m["b"] == F.col("status"))))
    return moves.filter(~F.coalesce(may, F.lit(False))).select("entity", "number", "before", "status")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of immutable rows that are GONE or CHANGED in ``after``; further rows are no change. Rows are compared by every column of ``before``."""
    values = [c for c in before.columns if c not in keys]
    packed = lambda df, name: df.select(*keys, F.struct(F.lit(1).alias("there"), *values).alias(name))
    both = _null_safe(packed(before, "old"), packed(after, "new"), keys)
    change = F.when(F.col("new").isNull(), "GONE").when(~F.col("old").eqNullSafe(F.col("new")), "CHANGED")
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], "new")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, on, "left").drop(*[f"_{k}" for k in keys])


def incomplete_manifests(manifests: DataFrame) -> DataFrame:
    """(generation, fault): READY or ACTIVE manifests (generation, status, expected, projected, entities, mentions, relations, evidence) that lack something; a row for each fault."""
    faults = F.array_compact(F.array(F.when(F.col("projected") != F.col("expected"), F.lit(INCOMPLETE)), F.when(F.col("mentions") < F.col("entities"), F.lit(NO_MENTION)), F.when(F.col("evidence") < F.col("relations"), F.lit(NO_EVIDENCE))))
    return manifests.filter(F.col("status").isin("READY", "ACTIVE")).select("generation", F.explode(faults).alias("fault"))


def broken_locators(locators: DataFrame, units: DataFrame) -> DataFrame:
    """(locator_id, fault) of locators whose units don't fit or whose offsets lie outside their units.

    ``locators``: (locator_id, doc_id, revision_id, kind, first_unit, last_unit, first_offset, last_offset, version); ``units``: (unit_id, doc_id,
    revision_id, kind, place, version, text). Offsets count UTF-16 units. A locator whose unit is missing has inconsistent units.
    """
    side = lambda p: units.select(F.col("unit_id").alias(f"{p}_unit"), F.struct("doc_id", "revision_id", "kind", "place", "version", utf16_length(F.col("text")).alias("length")).alias(p))
    j = locators.join(side("first"), "first_unit", "left").join(side("last"), "last_unit", "left")
    fits = F.lit(True)
    for p in ("first", "last"):
        fits = fits & (F.col(f"{p}.doc_id") == F.col("doc_id")) & (F.col(f"{p}.revision_id") == F.col("revision_id")) & (F.col(f"{p}.version") == F.col("version")) & ((F.col("kind") != "PAGE") | (F.col(f"{p}.kind") == "PAGE"))
    fits = fits & (F.col("first.place") <= F.col("last.place"))
    inside = (F.col("first_offset") >= 0) & (F.col("last_offset") >= 0) & (F.col("first_offset") <= F.col("first.length")) & (F.col("last_offset") <= F.col("last.length")) & ((F.col("first_unit") != F.col("last_unit")) | (F.col("last_offset") > F.col("first_offset")))
    fault = F.when(~F.coalesce(fits, F.lit(False)), F.lit(UNITS_APART)).when(~F.coalesce(inside, F.lit(False)), F.lit(OUT_OF_BOUNDS))
    return j.select("locator_id", fault.alias("fault")).filter("fault IS NOT NULL")


def write_checked(df: DataFrame, path: str, rules: dict[str, Column]) -> int:
    """Write a new folder of rows that keep every rule (a condition a row; null counts as broken); the rows written.

    The rows that break each rule are counted by the write itself (an ``Observation``), not by a pass of their own. Rows go to a
    folder aside, which takes its place only if nothing was broken; else it is deleted and ``Violated`` names the
    rules and their rows. A folder that exists already is an error.
    """
    seen = Observation()
    aside = f"{path}-aside-{uuid.uuid4().hex}"
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows written"), *broken).write.parquet(aside)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    place, target = hadoop.Path(aside), hadoop.Path(path)
    files = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    counts = seen.get
    rows = counts.pop("rows written")
    if faults := {k: n for k, n in counts.items() if n}:
        files.delete(place, True)
        raise Violated(faults)
    if files.exists(target) or not files.rename(place, target):
        files.delete(place, True)
        raise FileExistsError(path)
    return rows
