"""Communities of a weighted graph by local moves, refinement and contraction, as rounds of joins and sums.

The measure is modularity with a resolution: the sum over communities of inner weight minus
resolution * K^2 / 2m, K the summed degrees of a community, 2m the summed degrees of all.
Each level has three phases. *Local moves*: queued nodes look for the neighbouring community of largest gain and
move. *Refinement*: inside every community nodes start alone, and a node that is alone joins a part that it and
the community connect well; badly connected communities fall apart. *Contraction*: the parts become the nodes of a
smaller graph, which starts from the communities. The levels end when nothing contracts.

Moves of one round never undo one another. No node goes where a neighbour leaves, so inner weights rise by what each
counted on at least; what two nodes cost one another by joining, or leaving, the same community is charged to both before
a move is made, unless a node is the best one of both its communities. So each round raises the measure, and the
rounds end.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.operators.graph import connected_components
from lorespan.operators.relational import numbered
from lorespan.shared import discard
from lorespan.shared import materialize as written

_log = logging.getLogger(__name__)
#: Part of a node's degree below which a gain counts as none: sums of floating-point weights differ that much by order.
_LEAST = 1e-9


def _votes(edges: DataFrame, active: DataFrame, labels: DataFrame, refining: bool) -> DataFrame:
    """(node, label, w): weight from each active node to each label among its neighbours, while refining to those of its own community."""
    near = edges.join(active.select(F.col("node").alias("a"), F.col("home").alias("home_a")), "a").join(labels.select(F.col("node").alias("b"), "label", F.col("home").alias("home_b")), "b")
    if refining:
        near = near.filter("home_a = home_b")
    return near.groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))


def _charge(k: Column, total: Column, resolution: float, m2: float) -> Column:
    return F.lit(resolution / m2) * k * total


def _wanted(edges: DataFrame, labels: DataFrame, resolution: float, m2: float, refining: bool, key: Column) -> DataFrame:
    """(node, k, label, to, gain, urge) of the nodes that would gain by moving."""
    totals = labels.groupBy("label").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))
    active = labels.filter("queued")
    if refining:
        active = active.join(totals.filter("n = 1").select("label"), "label", "left_semi")
    votes = _votes(edges, active, labels, refining)
    targets = totals
    if refining:
        # a part takes nodes only if it is well connected with the rest of its community, and so must the node be
        homes = labels.groupBy("home").agg(F.sum("k").alias("whole"))
        inside = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("label"), F.col("home").alias("home")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("other"), F.col("home").alias("home_b")), "b")
        cut = inside.filter("home = home_b AND label <> other").groupBy("label", "home").agg(F.sum("w").alias("cut"))
        sound = cut.join(totals, "label").join(homes, "home").filter(F.col("cut") >= _charge(F.col("total"), F.col("whole") - F.col("total"), resolution, m2) * (1 - _LEAST))
        targets = totals.join(sound.select("label"), "label", "left_semi")
        active = active.join(sound.select("label"), "label", "left_semi")
    k = F.col("k")
    here = active.select("node", "k", F.col("label").alias("own")).join(totals.select(F.col("label").alias("own"), F.col("total").alias("own_total")), "own")
    seen = votes.join(here, "node").join(targets.select("label", "total"), "label", "left")
    value = F.col("w") - _charge(k, F.col("total"), resolution, m2)
    # equal gains are told apart by a hash that the seed turns
    order = F.struct(F.round(value / k, 9).alias("value"), F.xxhash64("label", key).alias("hash"), F.col("label"))
    best = seen.groupBy("node", "k", "own", "own_total").agg(
        F.max(F.when((F.col("label") != F.col("own")) & F.col("total").isNotNull(), F.struct(order.alias("order"), value.alias("value"), F.col("label").alias("to")))).alias("best"),
        F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0.0)).alias("w_own"),
    )
    stay = F.col("w_own") - _charge(k, F.col("own_total") - k, resolution, m2)
    gain = F.col("best.value") - stay
    return best.filter(F.col("best").isNotNull() & (gain > _LEAST * k)).select("node", "k", F.col("own").alias("label"), F.col("best.to").alias("to"), gain.alias("gain"), F.struct(F.xxhash64("node", key).alias("hash"), "node").alias("urge"))


def _chosen(edges: DataFrame, wants: DataFrame, resolution: float, m2: float) -> DataFrame:
    """(node, to): wishes that can all be granted at once."""
    mine = wants.select(F.col("node").alias("a"), F.col("urge").alias("mine"), F.col("label").alias("from_a"), F.col("to").alias("to_a"))
    other = wants.select(F.col("node").alias("b"), F.col("urge").alias("other"), F.col("label").alias("from_b"), F.col("to").alias("to_b"))
    # an edge spoils what its ends counted on only if one of them goes where the other leaves
    rivals = edges.join(mine, "a").join(other, "b").filter("(to_a = from_b OR to_b = from_a) AND other > mine")
    lost = rivals.select(F.col("a").alias("node")).distinct()
    free = wants.join(lost, "node", "left_anti").withColumn("rank", F.struct(F.round(F.col("gain"), 9).alias("gain"), F.col("urge")))
    joins = free.groupBy("to").agg(F.sum("k").alias("joining"), F.max("rank").alias("first_in"))
    leaves = free.groupBy("label").agg(F.sum("k").alias("leaving"), F.max("rank").alias("first_out"))
    charged = F.col("gain") - _charge(F.col("k"), F.col("joining") + F.col("leaving") - 2 * F.col("k"), resolution, m2)
    first = (F.col("rank") == F.col("first_in")) & (F.col("rank") == F.col("first_out"))
    return free.join(joins, "to").join(leaves, "label").filter(first | (charged > _LEAST * F.col("k"))).select("node", "to")


def _move(edges: DataFrame, labels: DataFrame, resolution: float, m2: float, seed: int, refining: bool, max_rounds: int | None) -> tuple[DataFrame, int]:
    """Rounds of moves until none is wanted; the rounds made. ``labels``: (node, k, home, label, queued), written."""
    turn = 0
    while max_rounds is None or turn < max_rounds:
        key = F.lit(seed * 1_000_003 + turn)
        wants = written(_wanted(edges, labels, resolution, m2, refining, key), "wants")
        if wants.isEmpty():
            discard(wants)
            break
        moves = written(_chosen(edges, wants, resolution, m2), "moves")
        # a node looks again if a neighbour has left for a community that is not its own, or if its wish was not granted
        stirred = edges.join(moves.select(F.col("node").alias("a"), "to"), "a").groupBy(F.col("b").alias("node")).agg(F.min("to").alias("low"), F.max("to").alias("high"))
        waiting = wants.join(moves, "node", "left_anti").select("node", F.lit(True).alias("waits"))
        label = F.coalesce("to", "label")
        queued = F.coalesce((F.col("low") != label) | (F.col("high") != label), F.lit(False)) | F.coalesce("waits", F.lit(False))
        # what is alone looks again while others may come
        after = labels.join(moves, "node", "left").join(stirred, "node", "left").join(waiting, "node", "left").select("node", "k", "home", label.alias("label"), (F.lit(True) if refining else queued).alias("queued"))
        after = written(after, "labels")
        discard(labels, wants, moves)
        labels, turn = after, turn + 1
    return labels, turn


def leiden_communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, seed: int = 42, max_rounds: int | None = None) -> DataFrame:
    """(node, community) of an undirected graph; communities are numbered from 0 by their least node, and each is connected.

    ``edges``: (a, b, weight), weights above 0 (a null or other weight is an error); either direction and repeated edges add up, loops
    don't count, rows with a null end are left out. ``nodes`` (node) adds nodes without edges, each a community of its own; an edge to a
    node that it doesn't list is an error. ``seed`` decides between equal gains and which of two neighbours moves first; the
    same in every run. ``max_rounds`` bounds the rounds of each phase (no bound: until no node gains by moving). The
    rounds made are logged. An empty graph gives no rows.
    """
    if not 0 < resolution:
        raise ValueError("the resolution must be above 0")
    flat = edges.select("a", "b", F.col("weight").cast("double").alias("w")).filter("a IS NOT NULL AND b IS NOT NULL")
    if not flat.filter("w IS NULL OR NOT w > 0 OR isnan(w) OR w = double('infinity')").isEmpty():
        raise ValueError("weights must be finite and above 0")
    proper = flat.filter("a <> b")
    both = written(proper.union(proper.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
    ends = flat.select(F.col("a").alias("node")).union(flat.select("b")).distinct()
    if nodes is not None:
        listed = nodes.select("node").filter("node IS NOT NULL").distinct()
        if not ends.join(listed, "node", "left_anti").isEmpty():
            raise ValueError("an edge ends at a node that isn't listed")
        ends = listed
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    m2 = both.agg(F.sum("w")).first()[0] or 1.0
    members = written(ends.select("node", F.col("node").alias("at")), "members")
    # nodes without edges have no degree and no part in the levels
    labels = written(degrees.select("node", "k", F.col("node").alias("home"), F.col("node").alias("label"), F.lit(True).alias("queued")), "labels")
    graph, level, made = both, 0, []
    while True:
        labels, moved = _move(graph, labels, resolution, m2, seed, False, max_rounds)
        alone = written(labels.select("node", "k", F.col("label").alias("home"), F.col("node").alias("label"), F.lit(True).alias("queued")), "labels")
        parts, joined = _move(graph, alone, resolution, m2, seed, True, max_rounds)
        made.append((moved, joined))
        now = written(members.join(labels.select(F.col("node").alias("at"), F.col("label").alias("community")), "at", "left").select("node", "at", F.coalesce("community", "at").alias("community")), "members")
        if not joined:
            break
        at = parts.select(F.col("node").alias("at"), F.col("label").alias("part"))
        further = written(now.join(at, "at", "left").select("node", F.coalesce("part", "at").alias("at")), "members")
        sides = graph.join(parts.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(parts.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        smaller = written(sides.filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "edges")
        named = parts.groupBy("home").agg(F.min("label").alias("first"))
        start = parts.groupBy(F.col("label").alias("node"), "home").agg(F.sum("k").alias("k")).join(named, "home")
        start = written(start.select("node", "k", F.col("first").alias("home"), F.col("first").alias("label"), F.lit(True).alias("queued")), "labels")
        discard(labels, parts, now, members, *([graph] if graph is not both else []))
        graph, labels, members, level = smaller, start, further, level + 1
    _log.info("levels %d, rounds of moves and of refinement %s", level + 1, made)
    # what the last moves have parted is two communities
    side = now.select(F.col("node").alias("a"), F.col("community").alias("x"))
    inner = both.join(side, "a").join(now.select(F.col("node").alias("b"), F.col("community").alias("y")), "b").filter("x = y AND a < b").select("a", "b")
    whole = now.join(connected_components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("first"))
    out = written(whole, "communities")
    discard(labels, parts, now, members, both, *([graph] if graph is not both else []))
    return out.join(numbered(out.select("first").distinct(), "first").withColumnRenamed("number", "community"), "first").select("node", "community")
