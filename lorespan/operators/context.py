"""Budgets of prompts and chat history, and greedy selections within one query or conversation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.operators.greedy import by_group


def within_budget(items: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows before which the group has spent less than the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("spent") < budget)


def split_budget(total: Column, graph_cap: int, percent: int, global_cap: int) -> tuple[Column, Column]:
    """The graph's share of a budget, and what global reports may take of the rest."""
    graph = F.least(F.lit(graph_cap), F.floor(total * percent / 100))
    return graph, F.least(F.lit(global_cap), total - graph)


def input_cap(window: Column, output: Column) -> Column:
    """Context window less output and a reserve of 5 percent, 256 at least."""
    return window - output - F.greatest(F.lit(256), F.ceil(window * 0.05))


def recent_history(messages: DataFrame, n: int = 12, budget: int = 2048) -> DataFrame:
    """Of each conversation the last ``n`` messages that fit the budget, newest first kept, without leading answers.

    ``messages``: (conv_id, turn, role, text). The budget counts characters of the message and all later ones.
    """
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    upto = last.rowsBetween(Window.unboundedPreceding, 0)
    kept = messages.withColumn("age", F.row_number().over(last)).filter(F.col("age") <= n)
    kept = kept.withColumn("used", F.sum(F.length("text")).over(upto)).filter(F.col("used") <= budget)
    users = F.max(F.when(F.col("role") != "assistant", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.withColumn("started", users).filter("started = 1").drop("started")


# Messages of a history without and with a summary, and the least budget.
HISTORY, AFTER_SUMMARY, LEAST_BUDGET = 12, 4, 64


def history_context(messages: DataFrame, summaries: DataFrame, limit: int = HISTORY, budget: int = 2048, compress: bool = True) -> DataFrame:
    """(conv_id, state, first_turn, messages, tokens, covered): which turns of each conversation go into the prompt, and whether its summary does.

    ``messages``: (conv_id, turn, role, tokens), those that may be used; ``summaries``: (conv_id, covered, tokens), the newest valid one of a
    conversation, which stands for the turns up to ``covered``. With a summary the last four turns behind it are used, else the last ``limit``,
    twelve at most; a summary that more than four turns have outrun is left out. From the oldest on, turns go until summary and turns fit the budget (64 at least), and then
    an answer at the start. A summary that alone exceeds the budget goes too. State: USED with a summary; PENDING where one is being caught up
    with or is needed; else NOT_NEEDED. ``first_turn`` is null where no turn is left. Ordering by turn within a conversation.
    """
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    at_most = max(LEAST_BUDGET, budget)
    own = summaries.select("conv_id", F.col("covered").alias("upto"), F.col("tokens").alias("summary_tokens")) if compress else summaries.limit(0).select("conv_id", F.col("covered").alias("upto"), F.col("tokens").alias("summary_tokens"))
    joined = messages.join(own, "conv_id", "left")
    whole = joined.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all_tokens"), F.count_if(F.col("turn") > F.col("upto")).alias("later"), F.first("upto").alias("upto"), F.first("summary_tokens").alias("summary_tokens"))
    late = F.col("upto").isNotNull() & (F.col("later") > AFTER_SUMMARY)
    whole = whole.select("conv_id", "n", "all_tokens", late.alias("late"), F.when(~late, F.col("upto")).alias("upto"), F.when(~late, F.col("summary_tokens")).alias("summary_tokens"))
    behind = messages.join(whole, "conv_id").filter(F.col("upto").isNull() | (F.col("turn") > F.col("upto"))).withColumn("age", F.row_number().over(last))
    few = behind.filter(F.col("age") <= F.when(F.col("upto").isNull(), max(1, min(HISTORY, limit))).otherwise(AFTER_SUMMARY))
    used = F.coalesce("summary_tokens", F.lit(0)) + F.sum("tokens").over(last.rowsBetween(Window.unboundedPreceding, 0))
    fits = few.withColumn("used", used).filter(F.col("used") <= at_most)
    oldest = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    kept = fits.withColumn("place", oldest).filter((F.col("place") > 1) | (F.col("role") != "assistant"))
    raw = kept.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens"))
    out = whole.join(raw, "conv_id", "left").withColumn("raw", F.coalesce("tokens", F.lit(0)))
    fit = F.col("upto").isNotNull() & (F.col("summary_tokens") + F.col("raw") <= at_most)
    needed = F.lit(compress) & ((F.col("n") > HISTORY) | (F.col("all_tokens") > at_most))
    state = F.when(F.col("late"), "PENDING").when(fit, "USED").when(needed, "PENDING").otherwise("NOT_NEEDED")
    return out.select("conv_id", state.alias("state"), "first_turn", F.coalesce("messages", F.lit(0)).alias("messages"), (F.col("raw") + F.when(fit, F.col("summary_tokens")).otherwise(0)).alias("tokens"), F.when(fit, F.col("upto")).alias("covered"))


def needs_compression(messages: DataFrame, n: int = 12, budget: int = 2048) -> DataFrame:
    """Conversations with more than ``n`` messages or more characters than the budget."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("tokens")).withColumn("compress", (F.col("messages") > n) | (F.col("tokens") > budget))


def plan_parents(candidates: DataFrame, parents: int = 4, per_document: int = 2, parent_tokens: int = 800, budget: int = 6000) -> DataFrame:
    """O1: which parents come along with ranked children: (query_id, child_id, rank, included, tokens, reason).

    ``candidates``: (query_id, rank, child_id, child_tokens, parent_id, parent_tokens, doc_id), tens of rows a
    query. Children are always kept; a parent counts once, is cut at ``parent_tokens``, and stays out beyond the limits.
    """

    columns = ["query_id", "rank", "child_id", "child_tokens", "parent_id", "parent_tokens", "doc_id"]

    def plan(rows: list[tuple]) -> Iterator[tuple]:
        left = budget - sum(r[3] for r in rows)
        taken: set = set()
        by_doc: dict = {}
        for query_id, rank, child_id, _, parent_id, tokens, doc_id in rows:
            cost, reason = 0, ""
            if parent_id in taken:
                reason = "SHARED_PARENT"
            elif len(taken) >= parents:
                reason = "PARENT_LIMIT"
            elif by_doc.get(doc_id, 0) >= per_document:
                reason = "PER_DOCUMENT_PARENT_LIMIT"
            elif left <= 0:
                reason = "TOKEN_BUDGET"
            else:
                cost = min(tokens, parent_tokens, left)
                taken.add(parent_id)
                by_doc[doc_id] = by_doc.get(doc_id, 0) + 1
                left -= cost
            yield query_id, child_id, rank, reason in ("", "SHARED_PARENT"), cost, reason

    return by_group(candidates, "query_id", ["rank", "child_id"], columns, plan, "query_id long, child_id long, rank int, included boolean, tokens int, reason string")


def reserve_branches(candidates: DataFrame, limit: int, branches: tuple[str, ...] = ("graph_rank", "bm25_rank", "vector_rank"), per_slot: int = 2) -> DataFrame:
    """``limit`` candidates of each query in rank order, with places reserved for query slots and branches.

    ``candidates``: (query_id, rank, doc_id, slot and a rank of each branch, null where it did not find the
    document). First ``per_slot`` of each slot, then a sixth of the limit (one to five) of each branch, then by rank.
    Window ranks give each reservation, so no query is handled by Python.
    """
    share = min(5, max(1, limit // 6))
    order = F.struct("rank", "doc_id")
    marked = candidates.withColumn("by_slot", F.row_number().over(Window.partitionBy("query_id", "slot").orderBy("rank", "doc_id")))
    first = F.when(F.col("by_slot") <= per_slot, 0)
    for i, b in enumerate(branches, 1):
        marked = marked.withColumn(f"by_{b}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(b).asc_nulls_last(), "doc_id")))
        first = first.when(F.col(b).isNotNull() & (F.col(f"by_{b}") <= share), i)
    marked = marked.withColumn("turn", first.otherwise(len(branches) + 1))
    kept = marked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", order))).filter(F.col("place") <= limit)
    return kept.select(*candidates.columns)


def graph_path_budget(paths: DataFrame, limit: int = 900) -> DataFrame:
    """O2: paths that fit a budget of characters, short ones first, a path only behind its parent: (query_id, relation, place, text, tokens, cut).

    ``paths``: (query_id, candidate, path, depth, relation, parent_relation, relation_type, text), tens a query, by candidate and path.
    """

    def cost(depth: int, kind: str, text: str) -> int:
        return len(f"citationId={'0' * 8}-0000-0000-0000-{'0' * 12};depth={depth};relationshipType={kind};evidenceText={text}")

    def choose(group: list[tuple]):
        used, taken = 0, set()
        for query, depth, _, _, relation, parent, kind, text in group:
            if relation in taken or (parent is not None and parent == parent and parent not in taken):
                continue
            fixed = cost(depth, kind, "")
            if limit - used <= fixed:
                continue
            part = text[: limit - used - fixed]
            tokens = fixed + len(part)
            taken.add(relation)
            used += tokens
            yield query, relation, len(taken), part, tokens, len(part) < len(text)

    columns = ["query_id", "depth", "candidate", "path", "relation", "parent_relation", "relation_type", "text"]
    return by_group(paths, "query_id", ["depth", "candidate", "path"], columns, choose, "query_id long, relation long, place int, text string, tokens int, cut boolean")


def claim_budget(claims: DataFrame, limit: int = 2400, title_tokens: int = 120) -> DataFrame:
    """O3: claims that fit a budget of characters, by the report's rank: (query_id, evidence_id, title, claim, evidence, tokens).

    ``claims``: (query_id, report_rank, candidate, report_id, claim_order, evidence_id, child_id, community, title, claim, evidence), tens a query. Titles are cut, a
    claim may take half of what is left, its evidence the rest; each piece of evidence comes once.
    """

    def choose(group: list[tuple]):
        used, seen = 0, set()
        for query, _, _, report, _, evidence_id, child, community, title, claim, evidence in group:
            if evidence_id in seen:
                continue
            seen.add(evidence_id)
            title = title[:title_tokens]
            # Fixed value: the form of a citation.
            fixed = len(f"citationId={child};reportId={report};reportTitle={title};communityKey={community};claim=;evidenceText=")
            left = limit - used - fixed
            if left <= 1:
                continue
            claim = claim[: max(1, left // 2)]
            evidence = evidence[: max(0, left - len(claim))]
            tokens = fixed + len(claim) + len(evidence)
            used += tokens
            yield query, evidence_id, title, claim, evidence, tokens

    columns = ["query_id", "report_rank", "candidate", "report_id", "claim_order", "evidence_id", "child_id", "community", "title", "claim", "evidence"]
    return by_group(claims, "query_id", ["report_rank", "candidate", "report_id", "claim_order", "evidence_id"], columns, choose, "query_id long, evidence_id long, title string, claim string, evidence string, tokens int")


def trim_prompt(parts: DataFrame, cap: int) -> DataFrame:
    """(query_id, part_id, trimmed) what leaves a prompt so that it fits: memory, parents, graph context, the summary, old history but two, evidence but one.

    ``parts``: (query_id, part_id, kind, place, tokens, slots array), tens a query; kinds QUESTION, MEMORY, PARENT, GRAPH, SUMMARY, HISTORY, EVIDENCE. Memory, parents,
    graph context and evidence leave from the last place on, history from the first; evidence whose query slots others still hold
    leaves before the rest. What is trimmed names the step (fixed values); parts that stay have an empty name.
    """

    def choose(group: list[tuple]):
        out = {r[1]: "" for r in group}
        used = sum(r[4] for r in group)
        of = lambda kind: sorted((r for r in group if r[2] == kind and not out[r[1]]), key=lambda r: r[3])

        def drop(row: tuple, step: str) -> None:
            nonlocal used
            out[row[1]] = step
            used -= row[4]

        for kind, step in (("MEMORY", "PROMPT_MEMORY_TRIMMED"), ("PARENT", "PROMPT_PARENT_TRIMMED"), ("GRAPH", "PROMPT_GRAPH_AUXILIARY_TRIMMED"), ("SUMMARY", "PROMPT_SUMMARY_TRIMMED")):
            while used > cap and of(kind):
                drop(of(kind)[-1], step)
        while used > cap and len(of("HISTORY")) + len(of("SUMMARY")) > 2:
            drop(of("HISTORY")[0], "PROMPT_OLD_HISTORY_TRIMMED")
        while used > cap and len(of("EVIDENCE")) > 1:
            kept = of("EVIDENCE")
            held: dict = {}
            for r in kept:
                for slot in r[5] if r[5] is not None else ():
                    held[slot] = held.get(slot, 0) + 1
            spare = [r for r in kept if r[5] is None or all(held[s] > 1 for s in r[5])]
            drop(spare[-1] if spare else kept[-1], "PROMPT_CHILD_EVIDENCE_TRIMMED")
        return [(group[0][0], part, step) for part, step in out.items()]

    return by_group(parts, "query_id", ["part_id"], ["query_id", "part_id", "kind", "place", "tokens", "slots"], choose, "query_id long, part_id long, trimmed string")
