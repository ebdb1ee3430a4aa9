"""Searching a graph: seeds, admitted paths and their evidence; browsing entities, relations and communities; quality of communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.operators.greedy import by_group
from lorespan.shared import spread


def freeze_sources(docs: DataFrame) -> DataFrame:
    """L1: (doc_id, revision_id, acl_version) of ready, current documents that are not deleted: what a graph generation is built from.

    ``docs``: (doc_id, revision_id, current_revision_id, acl_version, status, deleted).
    """
    live = (F.col("status") == "READY") & (F.col("revision_id") == F.col("current_revision_id")) & ~F.col("deleted")
    return docs.filter(live).select("doc_id", "revision_id", "acl_version")


def anchored(mentions: DataFrame, children: DataFrame, spans: DataFrame) -> DataFrame:
    """L3: mentions (mention, child_id, surface) at the first place in the child's text where they stand whole inside one span: first, last, span.

    ``children``: (child_id, text); ``spans``: (child_id, span, a, b). Mentions without such a place are left out.
    """
    per = spans.groupBy("child_id").agg(F.collect_list(F.struct("span", F.greatest("a", F.lit(0)).cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("spans"))
    text = mentions.filter("surface <> ''").join(children.select("child_id", "text"), "child_id").join(per, "child_id")
    size, foremost = F.length("surface"), F.col("foremost") - 1
    text = text.withColumn("foremost", F.position(F.col("surface"), F.col("text")))
    place = lambda first, span: F.struct(first.alias("first"), (first + size).alias("last"), span.alias("span"))
    whole = F.array_min(F.transform(F.filter("spans", lambda s: (s["a"] <= foremost) & (foremost + size <= s["b"])), lambda s: place(foremost, s["span"])))
    # only where the text's first place crosses the ends of spans are the spans searched, each in its own text and those behind that place alone
    behind = F.filter("spans", lambda s: s["b"] > foremost)
    found = F.transform(behind, lambda s: F.struct((s["a"] + F.position(F.col("surface"), F.substr("text", s["a"] + 1, s["b"] - s["a"])) - 1).alias("first"), s["span"].alias("span"), s["a"].alias("a")))
    later = F.array_min(F.transform(F.filter(found, lambda p: p["first"] >= p["a"]), lambda p: place(p["first"], p["span"])))
    placed = text.select("mention", "child_id", F.when(F.col("foremost") > 0, F.coalesce(whole, later)).alias("p"))
    return placed.groupBy("mention", "child_id").agg(F.min("p").alias("p")).filter("p IS NOT NULL").select("mention", "child_id", "p.*")


def seeds(hits: DataFrame, mentions: DataFrame, alias_matches: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, entity, place): entities that a walk starts from: those mentioned in hits first, then those whose alias is in the query; more evidence first.

    ``hits``: (query_id, child_id); ``mentions``: (entity, child_id), authorised; ``alias_matches``: (query_id, entity).
    """
    rows = mentions.count()
    found = spread(hits, rows, "child_id").join(spread(mentions, rows, "child_id"), "child_id").select("query_id", "entity", F.lit(1).cast("long").alias("n"), F.lit(0).alias("priority"))
    spoken = mentions.groupBy("entity").agg(F.count("*").alias("n"))
    named = alias_matches.select("query_id", "entity").distinct().join(spoken, "entity").select("query_id", "entity", "n", F.lit(1).alias("priority"))
    # dealt by query once: groups and places need no other shuffle
    both = spread(found.unionByName(named), rows, "query_id").groupBy("query_id", "entity").agg(F.min("priority").alias("priority"), F.sum("n").alias("n"))
    order = Window.partitionBy("query_id").orderBy("priority", F.col("n").desc(), "entity")
    return both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "entity", "place")


def admit_paths(edges: DataFrame, starts: DataFrame, entity_limit: int = 20, edge_limit: int = 40) -> DataFrame:
    """(query_id, relation, target, place) of the walk's edges in order: each relation once, behind the one it came by, within the limits.

    ``edges``: (query_id, step, relation, parent_relation, target), tens a query; ``starts``: (query_id, entity).
    """
    begun = starts.groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("starts"))
    rows = edges.join(begun, "query_id", "left")

    def choose(group: list[tuple]):
        known = set(group[0][5] if group[0][5] is not None else ())
        taken: dict = {}
        for query, _, relation, parent, target, _ in group:
            missing = parent is not None and parent == parent and parent not in taken
            if relation in taken or missing or (target not in known and len(known) >= entity_limit):
                continue
            known.add(target)
            taken[relation] = 1
            yield query, relation, target, len(taken)
            if len(taken) >= edge_limit:
                return

    return by_group(rows, "query_id", ["step", "relation"], ["query_id", "step", "relation", "parent_relation", "target", "starts"], choose, "query_id long, relation long, target long, place int")


def evidence_candidates(admitted: DataFrame, evidence: DataFrame, limit: int = 30, most: int = 220) -> DataFrame:
    """(query_id, child_id, place, relations, shown): children that prove admitted relations, in the order of their first edge, at most ``limit`` a query.

    ``admitted``: (query_id, relation, place); ``evidence``: (relation, child_id, text), authorised. ``shown`` joins the texts, each cut at ``most``.
    """
    joined = admitted.join(evidence, "relation").select("query_id", "child_id", F.struct("place", "relation", F.left("text", F.lit(most)).alias("text")).alias("e"))
    per = joined.groupBy("query_id", "child_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    order = Window.partitionBy("query_id").orderBy(F.col("first"), "child_id")
    ranked = per.withColumn("first", F.get("e", F.lit(0))["place"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return ranked.select("query_id", "child_id", "place", F.size("e").alias("relations"), F.array_join(F.transform("e", lambda x: x["text"]), " ").alias("shown"))


def browse_entities(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, edges: DataFrame, prefix: str = "", after: tuple | None = None, limit: int = 50) -> DataFrame:
    """A page of entities (entity, type, name, aliases, mentions, relations) whose name or alias begins with ``prefix``, behind the cursor, by type, name, id.

    Only entities with a visible mention are shown. Counts are made before they are joined.
    """
    shown = entities.join(mentions.select("entity").distinct(), "entity", "left_semi")
    if prefix:
        named = aliases.filter(F.col("alias").startswith(prefix)).select("entity").unionByName(entities.filter(F.col("name").startswith(prefix)).select("entity")).distinct()
        shown = shown.join(named, "entity", "left_semi")
    if after:
        shown = shown.filter(F.struct("type", "name", "entity") > F.struct(*[F.lit(x).cast(entities.schema[c].dataType).alias(c) for x, c in zip(after, ("type", "name", "entity"), strict=True)]))
    page = shown.orderBy("type", "name", "entity").limit(limit)
    ends = edges.select("relation", F.explode(F.array_distinct(F.array("a", "b"))).alias("entity"))
    counts = lambda df, name: df.groupBy("entity").agg(F.count("*").alias(name))
    listed = aliases.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("alias")), "; ").alias("aliases"))
    joined = page.join(listed, "entity", "left").join(counts(mentions, "mentions"), "entity", "left").join(counts(ends, "relations"), "entity", "left")
    return joined.select("entity", "type", "name", F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("relations", F.lit(0)).alias("relations"))


def relation_details(edges: DataFrame, entities: DataFrame, evidence: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """Each relation with its ends' names and its first ``most`` pieces of evidence by document, as JSON.

    ``edges``: (relation, a, b, type); ``evidence``: (relation, doc_id, text); ``docs``: (doc_id, title), authorised.
    """
    name = lambda x: entities.select(F.col("entity").alias(x), F.col("name").alias(f"{x}_name"))
    proof = evidence.join(docs.select("doc_id", "title"), "doc_id")
    order = Window.partitionBy("relation").orderBy("doc_id", "text")
    first = proof.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    nested = first.groupBy("relation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc_id", "title", "text"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["title"].alias("title"), x["text"].alias("text")))).alias("evidence"))
    total = proof.groupBy("relation").agg(F.count("*").alias("pieces"))
    return edges.join(name("a"), "a").join(name("b"), "b").join(nested, "relation").join(total, "relation").select("relation", "type", "a_name", "b_name", "pieces", "evidence")


def member_degrees(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (node, community) of each community by falling number of different relations, then by node: degree and place."""
    ends = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "relation").distinct().groupBy("node").agg(F.count("relation").alias("degree"))
    order = Window.partitionBy("community").orderBy(F.col("degree").desc(), "node")
    return members.join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("place", F.row_number().over(order))


def public_subgraph(edges: DataFrame, evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """M1: relations (relation, a, b) with evidence in documents that all users see, and how many pieces of it. ``docs``: (doc_id, visibility)."""
    seen = evidence.join(docs.filter("visibility = 'ALL_USERS'").select("doc_id"), "doc_id", "left_semi").groupBy("relation").agg(F.count("*").alias("pieces"))
    return edges.join(seen, "relation").select("relation", "a", "b", "pieces")


def top_communities(members: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """M2: the ``limit`` communities with most relations inside, ties by key. ``members``: (node, community); ``edges``: (relation, a, b)."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    inside = edges.join(side("a"), "a").join(side("b"), "b").filter("ca = cb")
    counts = inside.groupBy(F.col("ca").alias("community")).agg(F.count_distinct("relation").alias("relations"))
    return counts.orderBy(F.col("relations").desc(), "community").limit(limit)


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the modularity of a partition (node, community) of weighted edges (a, b, weight): the share of weight inside less what chance would put there."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    joined = edges.join(side("a"), "a").join(side("b"), "b")
    inside = joined.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("m"))
    degree = joined.select(F.col("ca").alias("c"), "weight").unionByName(joined.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    chance = degree.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"))
    return inside.crossJoin(chance).select(F.round(F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m")), 6).alias("modularity"))  # one row each
