"""Graph views for readers: bounds of extractions, claims that hold, communities and entities in detail, subgraphs with caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.operators.greedy import by_group
from lorespan.operators.relational import either_endpoint
from lorespan.shared import discard, materialize

# Most entities, relations, aliases and mentions of an extraction, claims of a report, nodes and edges of a view.
ENTITIES, RELATIONS, ALIASES, MENTIONS, CLAIMS, NODES, EDGES = 200, 400, 50, 100, 8, 20, 40


def extraction_bounds(parents: DataFrame, entities: DataFrame, relations: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """(parent_id, entities, relations, aliases, mentions, accepted) of what was extracted from each parent (parent_id).

    ``entities``, ``aliases`` and ``mentions`` have (parent_id, entity_id), a row each; ``relations`` (parent_id). Aliases and mentions are the most that one
    entity of the parent has. An extraction is accepted if it keeps every bound; one of nothing is.
    """
    total = lambda df, name: df.groupBy("parent_id").agg(F.count(F.lit(1)).alias(name))
    most = lambda df, name: df.groupBy("parent_id", "entity_id").agg(F.count(F.lit(1)).alias("n")).groupBy("parent_id").agg(F.max("n").alias(name))
    out = parents.select("parent_id").distinct()
    limits = {"entities": ENTITIES, "relations": RELATIONS, "aliases": ALIASES, "mentions": MENTIONS}
    for part in (total(entities, "entities"), total(relations, "relations"), most(aliases, "aliases"), most(mentions, "mentions")):
        out = out.join(part, "parent_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in limits]
    kept = F.lit(True)
    for c, n in limits.items():
        kept = kept & (F.col(c) <= n)
    return out.select("parent_id", *counts).withColumn("accepted", kept)


def valid_claims(reports: DataFrame, claims: DataFrame, evidence: DataFrame, allowed: DataFrame, most: int = CLAIMS) -> DataFrame:
    """M3: (report_id, place, claim, text, pieces): claims of which every piece of evidence is allowed, placed from 0 within their report.

    ``reports``: (report_id, title, summary); ``claims``: (report_id, claim, text), in the order of claim; ``evidence``: (report_id, claim, evidence_id);
    ``allowed``: (report_id, evidence_id). Claims without a text or evidence, or with one piece that is not allowed, are dropped one by one. A report
    without a title, a summary or claims, or with more than ``most`` claims, gives none. Repeated evidence counts once.
    """
    said = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    told = reports.filter(said(F.col("title")) & said(F.col("summary"))).select("report_id").distinct()
    few = claims.groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("report_id")
    cited = evidence.select("report_id", "claim", "evidence_id").distinct().join(allowed.select("report_id", "evidence_id", F.lit(1).alias("fine")).distinct(), ["report_id", "evidence_id"], "left")
    sound = cited.groupBy("report_id", "claim").agg(F.count(F.lit(1)).alias("pieces"), F.count("fine").alias("fine")).filter("pieces = fine").drop("fine")
    kept = claims.filter(said(F.col("text"))).join(told, "report_id", "left_semi").join(few, "report_id", "left_semi").join(sound, ["report_id", "claim"])
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("claim")) - 1
    return kept.select("report_id", place.alias("place"), "claim", F.trim("text").alias("text"), "pieces")


def child_ranks(ranked: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): a child's place is the best of the reports (query_id, report_id, rank) whose claims (report_id, doc_id) rest on it."""
    return ranked.join(claims.select("report_id", "doc_id").distinct(), "report_id").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))


def community_details(members: DataFrame, relations: DataFrame, claims: DataFrame, visible: DataFrame) -> DataFrame:
    """(community, members, seen, relations, claims) of the communities of which a reader sees something.

    ``members``: (node, community); ``relations``: (relation, a, b); ``claims``: (community, claim, evidence_id); ``visible``: (kind, id) with kind
    NODE, RELATION or EVIDENCE. A community shows if one of its nodes is visible; its relations count if they are visible and lie inside it,
    its claims if all their evidence is visible.
    """
    of = lambda kind, name: visible.filter(F.col("kind") == kind).select(F.col("id").alias(name)).distinct()
    size = members.join(of("NODE", "node").withColumn("there", F.lit(1)), "node", "left").groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.count("there").alias("seen")).filter("seen > 0")
    side = lambda x: members.select(F.col("node").alias(x), F.col("community").alias(f"c_{x}"))
    inside = relations.join(of("RELATION", "relation"), "relation", "left_semi").join(side("a"), "a").join(side("b"), "b").filter("c_a = c_b").groupBy(F.col("c_a").alias("community")).agg(F.count_distinct("relation").alias("relations"))
    proof = claims.join(of("EVIDENCE", "evidence_id").withColumn("there", F.lit(1)), "evidence_id", "left").groupBy("community", "claim").agg((F.count(F.lit(1)) == F.count("there")).alias("whole"))
    told = proof.filter("whole").groupBy("community").agg(F.count(F.lit(1)).alias("claims"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return size.join(inside, "community", "left").join(told, "community", "left").select("community", "members", "seen", none("relations"), none("claims"))


def entity_details(entities: DataFrame, aliases: DataFrame, mentions: DataFrame, relations: DataFrame, visible: DataFrame, most: int = 20) -> DataFrame:
    """(entity, name, type, aliases, mention_count, mentions, relation_count, relations) of entities with a visible mention, lists as JSON.

    ``entities``: (entity, name, type); ``aliases``: (entity, alias); ``mentions``: (entity, doc_id, place, text); ``relations``: (relation, a, b,
    type, doc_id), a row for each piece of evidence; ``visible``: (doc_id). Lists hold the first ``most``: aliases by name, mentions by document and place,
    relations by their pieces, falling, then by relation, each with direction and other end. Counts are of all.
    """

    def first(rows: DataFrame, order: list, fields: list[str], name: str) -> DataFrame:
        placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(*order)))
        shown = F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", *fields))))
        return placed.groupBy("entity").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.to_json(F.transform(shown, lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias(name))

    docs = visible.select("doc_id").distinct()
    seen = mentions.join(docs, "doc_id", "left_semi")
    ends = either_endpoint(relations.join(docs, "doc_id", "left_semi").groupBy("relation", "a", "b", "type").agg(F.count(F.lit(1)).alias("pieces")), "a", "b").withColumnRenamed("node", "entity")
    # ends that no entity is asked for are not placed
    ends = ends.join(entities.select("entity"), "entity", "left_semi")
    known = first(aliases.select("entity", "alias").distinct(), ["alias"], ["alias"], "aliases").drop("aliases_count")
    said = first(seen, ["doc_id", "place"], ["doc_id", "place", "text"], "mentions").withColumnRenamed("mentions_count", "mention_count")
    tied = first(ends, [F.col("pieces").desc(), "relation"], ["relation", "type", "direction", "other", "pieces"], "relations").withColumnRenamed("relations_count", "relation_count")
    out = entities.join(said, "entity").join(known, "entity", "left").join(tied, "entity", "left")
    empty = lambda c: F.coalesce(c, F.lit("[]")).alias(c)
    return out.select("entity", "name", "type", empty("aliases"), "mention_count", "mentions", F.coalesce("relation_count", F.lit(0)).alias("relation_count"), empty("relations"))


def subgraph_views(edges: DataFrame, roots: DataFrame, hops: int = 2, nodes: int = NODES, most_edges: int = EDGES) -> DataFrame:
    """(root, relation, a, b, depth, truncated): the edges around each root, in layers, within caps.

    ``edges``: (relation, a, b, pieces), a row a relation; ``roots``: (root). A layer looks at the ``most_edges`` + 1 edges of its frontier with most pieces, then by relation, and
    takes them in order: an edge is left out if it would add a node beyond ``nodes``, and a layer ends at ``most_edges``; either, or
    a further edge, marks the view as truncated. Frontiers and layers are joins for all roots at once; only the choice among a root's
    few candidates is made one after the other. A root without edges has no row.
    """
    near = either_endpoint(edges.select("relation", "a", "b", "pieces"), "a", "b").select("node", "relation", "pieces", "other", "direction")
    # what is among the first of a frontier is among the first of one of its nodes, so a hub joins with as many edges as a layer looks at
    foremost = F.dense_rank().over(Window.partitionBy("node").orderBy(F.col("pieces").desc(), "relation"))
    near = materialize(near.withColumn("n", foremost).filter(F.col("n") <= most_edges + 1).drop("n"), "near")
    columns = ["root", "rank", "depth", "node", "relation", "first", "truncated", "a", "b"]
    kinds = {"root": roots.schema["root"], "node": edges.schema["a"], "relation": edges.schema["relation"], "a": edges.schema["a"], "b": edges.schema["b"]}
    types = {k: v.dataType.simpleString() for k, v in kinds.items()} | {"depth": "int", "first": "boolean", "truncated": "boolean"}
    schema = ", ".join(f"{c} {types[c]}" for c in columns if c != "rank")
    state, frontier = None, roots.select("root", F.col("root").alias("node")).distinct()
    for depth in range(1, hops + 1):
        touched = frontier.join(near, "node").groupBy("root", "relation").agg(F.max("pieces").alias("pieces"), F.min(F.struct("node", "other", "direction")).alias("e"))
        ranked = touched.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.col("pieces").desc(), "relation"))).filter(F.col("rank") <= most_edges + 1)
        out = F.col("e.direction") == "OUT"
        rows = ranked.select("root", "rank", F.lit(depth).alias("depth"), F.col("e.other").alias("node"), "relation", F.lit(False).alias("first"), F.lit(False).alias("truncated"), F.when(out, F.col("e.node")).otherwise(F.col("e.other")).alias("a"), F.when(out, F.col("e.other")).otherwise(F.col("e.node")).alias("b"))
        rows = rows if state is None else state.withColumn("rank", F.lit(0)).select(*columns).unionByName(rows)

        def choose(group: list[tuple]) -> list[tuple]:
            """Rows of rank 0 are edges taken before, ``first`` those that brought their node in; the others are candidates, with the end that may be new."""
            known = [g for g in group if g[1] == 0]
            found = {group[0][0], *(g[3] for g in known if g[5])}
            taken, cut = {g[4] for g in known}, any(g[6] for g in known)
            new: list[tuple] = []
            if not known or (len(found) < nodes and len(taken) < most_edges):
                cut |= len(group) - len(known) > most_edges
                for root, _, depth, node, relation, _, _, a, b in (g for g in group if g[1] > 0):
                    if relation in taken:
                        continue
                    if node not in found and len(found) >= nodes:
                        cut = True
                        continue
                    if len(taken) >= most_edges:
                        cut = True
                        break
                    new.append((root, depth, node, relation, node not in found, a, b))
                    found.add(node)
                    taken.add(relation)
            return [(g[0], *g[2:6], cut, *g[7:]) for g in known] + [(*n[:5], cut, *n[5:]) for n in new]

        before, state = state, materialize(by_group(rows, "root", ["rank", "relation"], columns, choose, schema), "views")
        if before is not None:
            discard(before)
        frontier = state.filter("first").filter(F.col("depth") == depth).select("root", "node")
    discard(near)
    return state.select("root", "relation", "a", "b", "depth", "truncated")
