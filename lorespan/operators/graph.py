"""Property graph: merging entities and relations, components, bounded walks, communities, report checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.operators.label_blocks import labels_by_blocks
from lorespan.shared import discard
from lorespan.shared import materialize as written


def merge_entities(mentions: DataFrame) -> DataFrame:
    """L2: one entity per (type, normalised name); the first mention in source order gives name and description.

    ``mentions``: (position, type, name, description). Returns key, type, name, description, aliases (sorted, distinct), mentions.
    """
    norm = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    keyed = mentions.withColumn("key", F.concat_ws("|", "type", norm))
    return keyed.groupBy("key").agg(
        F.min_by("type", "position").alias("type"),
        F.min_by("name", "position").alias("name"),
        F.min_by("description", "position").alias("description"),
        F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("aliases"),
        F.count("*").alias("mentions"),
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    """Relations (a, b, type) without self loops, merged, with their weight."""
    return relations.filter("a <> b").groupBy("a", "b", "type").agg(F.count("*").alias("weight"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) lead to; least labels of neighbours with pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    kept = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        now = written(nearer.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        ended = now.filter("component <> old").isEmpty()
        discard(kept)
        kept, labels = now, now.select("node", "component")
        if ended:
            discard(both)
            return labels


def label_communities(edges: DataFrame) -> DataFrame:
    """(node, community) by label propagation over weighted edges (a, b, weight), until no label changes.

    A node wants the label of largest total weight among its neighbours (the least on ties) if that outweighs
    its own. Of neighbours that want to change, one moves at a time: those that are an end ``a`` and the
    others come first in turn, else the hash decides. So each move adds weight within communities, none can
    be undone, and the end is reached; the same in every run. A community carries its least node.
    """
    linked = written(edges.filter("a <> b").select("a", "b", F.coalesce("weight", F.lit(0)).alias("weight")), "linked")
    kinds = dict(linked.dtypes)
    whole = kinds["a"] == kinds["b"] == "bigint" and kinds["weight"] in ("tinyint", "smallint", "int", "bigint")
    labels = labels_by_blocks(linked) if whole else None
    if labels is None:
        labels = _labels_by_rows(linked)
    discard(linked)
    first = labels.groupBy("label").agg(F.min("node").alias("first"))
    return labels.join(first, "label").select("node", F.col("first").alias("community"))


def _labels_by_rows(edges: DataFrame) -> DataFrame:
    """(node, label) of ``label_communities`` by joins of edges and labels: any type of node and weight, and nodes of any number of edges."""
    both = written(edges.select("a", "b", "weight").union(edges.select("b", "a", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "edges")
    sides = edges.select(F.col("a").alias("node"), F.lit(0).alias("side")).union(edges.select("b", F.lit(1)))
    labels = written(sides.groupBy("node").agg(F.min("side").alias("side")).withColumn("label", F.col("node")), "labels")
    turn = 0
    while True:
        votes = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("votes"))
        own = votes.join(labels.select("node", F.col("label").alias("old")), "node")
        chosen = own.groupBy("node").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("next"), F.max("votes").alias("most"), F.max(F.when(F.col("label") == F.col("old"), F.col("votes"))).alias("now"))
        wants = chosen.filter(F.col("now").isNull() | (F.col("most") > F.col("now"))).join(labels, "node")
        urge = F.struct((F.col("side") == turn % 2).alias("turn"), F.xxhash64("node", F.lit(turn)).alias("hash"), "node")
        wants = written(wants.select("node", "next", urge.alias("urge")), "wants")
        if wants.isEmpty():
            discard(wants)
            break
        rivals = both.select("a", "b").join(wants.select(F.col("node").alias("b"), "urge"), "b").groupBy(F.col("a").alias("node")).agg(F.max("urge").alias("rival"))
        moves = wants.join(rivals, "node", "left").filter(F.col("rival").isNull() | (F.col("urge") > F.col("rival"))).select("node", "next")
        before, labels = labels, written(labels.join(moves, "node", "left").select("node", "side", F.coalesce("next", "label").alias("label")), "labels")
        discard(before, wants)
        turn += 1
    discard(both)
    return labels


def bounded_walk(edges: DataFrame, seeds: DataFrame, hops: int, fan_out: int) -> DataFrame:
    """Simple paths from seeds, at most ``hops`` edges, at each end the ``fan_out`` heaviest edges (ties by node).

    ``edges``: (node, other, weight) in both directions; ``seeds``: (node). Returns seed, depth, node, path.
    The fan-out is cut before any hop joins, so a hub adds at most ``fan_out`` rows to each path.
    """
    best = edges.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.col("weight").desc(), "other"))).filter(F.col("n") <= fan_out).select(F.col("node").alias("at"), "other")
    frontier = seeds.select(F.col("node").alias("seed"), F.lit(0).alias("depth"), F.col("node").alias("node"), F.array("node").alias("path"))
    out = frontier
    for depth in range(1, hops + 1):
        step = frontier.join(best, F.col("node") == F.col("at")).filter(~F.array_contains("path", F.col("other")))
        frontier = step.select("seed", F.lit(depth).alias("depth"), F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"))
        out = out.unionByName(frontier)
    return out


def community_facts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, title (the first three members by name) and relations counted at their source.

    ``members``: (node, community, name); ``edges``: (a, b).
    """
    heads = members.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("name", "node"))).filter("n <= 3")
    title = heads.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), " · ").alias("title"))
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    relations = edges.join(members.select(F.col("node").alias("a"), "community"), "a").groupBy("community").agg(F.count("*").alias("relations"))
    return size.join(title, "community").join(relations, "community", "left").select("community", "members", "title", F.coalesce("relations", F.lit(0)).alias("relations"))


def valid_reports(claims: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """M3-M5: reports of which every claim's every piece of evidence is allowed.

    ``claims``: (report_id, claim_id); ``evidence``: (claim_id, evidence_id); ``allowed``: (evidence_id).
    """
    denied = evidence.join(allowed, "evidence_id", "left_anti").select("claim_id").distinct()
    broken = claims.join(denied, "claim_id", "left_semi").select("report_id").distinct()
    return claims.select("report_id").distinct().join(broken, "report_id", "left_anti")


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of sources (node) with the neighbours (other) they share, and the Jaccard similarity of these.

    Pairs come from shared neighbours; a neighbour of many sources makes many pairs, so callers bound its degree.
    """
    flat = edges.select("node", "other").distinct()
    degree = flat.groupBy("node").agg(F.count("*").alias("n"))
    both = flat.join(degree, "node")
    left, right = (both.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), "other") for x in "ab")
    common = left.join(right, "other").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    return common.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def sql_walk(spark: SparkSession, edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """L10, L14 as recursive SQL: nodes within ``hops`` of the seeds with their least depth."""
    return spark.sql(
        f"""WITH RECURSIVE walk(node, depth) AS (
            SELECT node, 0 FROM {{seeds}} UNION ALL
            SELECT e.other, w.depth + 1 FROM walk w JOIN {{edges}} e ON e.node = w.node WHERE w.depth < {int(hops)})
        SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
        edges=edges,
        seeds=seeds,
    )
