"""Chat history and memory: what may be shown again, what is recalled, and whether its sources still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.operators.greedy import by_group


def answer_sources(citations: DataFrame, memories: DataFrame) -> DataFrame:
    """(run_id, current, used_memory): a run is current if it has a citation or used memory, and all of them are available.

    ``citations``: (run_id, available); ``memories``: (run_id, usage, available), of which usage USED counts.
    """
    used = memories.filter("usage = 'USED'").select("run_id", "available", F.lit(True).alias("memory"))
    both = citations.select("run_id", "available", F.lit(False).alias("memory")).unionByName(used)
    return both.groupBy("run_id").agg(F.bool_and(F.coalesce("available", F.lit(False))).alias("current"), F.bool_or("memory").alias("used_memory"))


def eligible_history(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """users' messages; answers of refused runs, and of completed runs whose sources are current and without memory.

    ``messages``: (conv_id, turn, role, run_id, run_status, ...); ``sources``: of ``answer_sources``.
    """
    j = messages.join(sources, "run_id", "left")
    sound = F.coalesce(F.col("current") & ~F.col("used_memory"), F.lit(False))
    answer = (F.upper("role") == "ASSISTANT") & F.col("run_id").isNotNull() & ((F.col("run_status") == "REFUSED") | ((F.col("run_status") == "COMPLETED") & sound))
    return j.filter((F.upper("role") == "USER") | F.coalesce(answer, F.lit(False))).select(*messages.columns)


def memory_candidates(items: DataFrame, sources: DataFrame, visible: DataFrame, now, limit: int = 200) -> DataFrame:
    """P5: of each owner the ``limit`` newest active, unexpired items whose document sources are all still visible at their revision.

    ``items``: (item_id, owner, kind, status, expires_at, updated_at, ...); ``sources``: (item_id, doc_id, revision_id) of documents;
    ``visible``: (owner, doc_id, revision_id). Facts of documents need a source.
    """
    live = items.filter((F.col("status") == "ACTIVE") & F.col("kind").isin("USER_PREFERENCE", "USER_FACT", "DOCUMENT_FACT") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    seen = visible.select("owner", "doc_id", "revision_id", F.lit(True).alias("seen")).distinct()
    owned = sources.join(live.select("item_id", "owner"), "item_id").join(seen, ["owner", "doc_id", "revision_id"], "left")
    per = owned.groupBy("item_id").agg(F.bool_and(F.coalesce("seen", F.lit(False))).alias("all_seen"))
    kept = live.join(per, "item_id", "left").filter(F.coalesce("all_seen", F.col("kind") != "DOCUMENT_FACT"))
    from pyspark.sql import Window

    order = Window.partitionBy("owner").orderBy(F.col("updated_at").desc(), "item_id")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(*items.columns, "place")


def relevant_memory(kind, matches, score, personal: float = 0.10, document: float = 0.20):
    """A fact of a document needs two matches and a score of 0.2, others one match and 0.1."""
    return (matches > 0) & F.when(kind == "DOCUMENT_FACT", (matches >= 2) & (score >= document)).otherwise(score >= personal)


def select_memory(candidates: DataFrame, items: int = 5, budget: int = 512, audited: int = 20, personal_allowed: bool = True) -> DataFrame:
    """(query_id, item_id, status, reason) of the ``audited`` best candidates of each query, best first.

    ``candidates``: (query_id, item_id, kind, matches, score, updated_at, tokens), tens a query.
    """
    good = relevant_memory(F.col("kind"), F.col("matches"), F.col("score"))
    rows = candidates.withColumn("good", good).withColumn("falling", -F.col("score")).withColumn("newest", -F.unix_micros(F.col("updated_at").cast("timestamp")))

    def choose(group: list[tuple]):
        taken = used = 0
        for query, item, kind, tokens, fits, _, _ in group[:audited]:
            fact = kind == "DOCUMENT_FACT"
            cost = 0 if fact else tokens
            if not fits:
                status = ("TRIMMED", "MEMORY_RELEVANCE_LOW")
            elif not fact and not personal_allowed:
                status = ("REMOTE_BLOCKED", "REMOTE_MEMORY_NOT_ALLOWED")
            elif taken >= items:
                status = ("TRIMMED", "MEMORY_ITEM_LIMIT")
            elif used + cost > budget:
                status = ("TRIMMED", "MEMORY_TOKEN_BUDGET")
            else:
                status = ("DOCUMENT_EVIDENCE" if fact else "INJECTED", "")
                taken, used = taken + 1, used + cost
            yield (query, item, *status)

    return by_group(rows, "query_id", ["falling", "newest", "item_id"], ["query_id", "item_id", "kind", "tokens", "good", "falling", "newest"], choose, "query_id long, item_id long, status string, reason string")


def eligible_segments(segments: DataFrame, citations: DataFrame, memories: DataFrame, most: int = 4000) -> DataFrame:
    """Segments (run_id, segment, text, citation_ids, memory_ids) with text of at most ``most`` characters and citations, all ids on the run's lists."""
    listed = lambda df, name: df.groupBy("run_id").agg(F.collect_set("id").alias(name))
    j = segments.join(listed(citations, "cited"), "run_id", "left").join(listed(memories, "remembered"), "run_id", "left")
    none = F.array().cast("array<long>")
    text = F.trim(F.coalesce("text", F.lit("")))
    sound = F.length(text).between(1, most) & (F.size("citation_ids") > 0) & (F.size(F.array_except("citation_ids", F.coalesce("cited", none))) == 0)
    return j.filter(F.coalesce(sound, F.lit(False)) & (F.size(F.array_except(F.coalesce("memory_ids", none), F.coalesce("remembered", none))) == 0)).select("run_id", "segment", text.alias("text"), F.array_distinct("citation_ids").alias("citation_ids"))


def merge_sources(parent: DataFrame, current: DataFrame) -> DataFrame:
    """P10: sources of a summary (conv_id, message_id, sequence, content_hash): those of the one before and new ones, which replace theirs."""
    old = parent.select("conv_id", "message_id", F.struct("sequence", "content_hash").alias("old"))
    new = current.select("conv_id", "message_id", F.struct("sequence", "content_hash").alias("new"))
    return old.join(new, ["conv_id", "message_id"], "full").select("conv_id", "message_id", F.coalesce("new", "old").alias("s")).select("conv_id", "message_id", "s.*")


def current_summaries(summaries: DataFrame, sources: DataFrame, messages: DataFrame) -> DataFrame:
    """P10: (conv_id, current): a summary holds if as many sources as it counts are still there and each message has the hash it had.

    ``summaries``: (conv_id, source_count); ``sources``: of ``merge_sources``; ``messages``: (conv_id, message_id, text).
    """
    now = messages.select("conv_id", "message_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now"))
    per = sources.join(now, ["conv_id", "message_id"]).groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and(F.col("now") == F.col("content_hash")).alias("same"))
    return summaries.join(per, "conv_id", "left").select("conv_id", F.coalesce((F.col("n") == F.col("source_count")) & F.col("same"), F.lit(False)).alias("current"))


def attach_context(paths: DataFrame, claims: DataFrame, contexts: DataFrame) -> DataFrame:
    """Paths and claims (doc_id, span_id, shown) that support a child in whose context their span is, each once, with one citation a span.

    ``contexts``: (doc_id, span_id). The citation of a span is the first eight digits of a hash of both ids.
    """
    both = paths.select("doc_id", "span_id", F.lit("PATH").alias("kind"), "shown").unionByName(claims.select("doc_id", "span_id", F.lit("CLAIM").alias("kind"), "shown"))
    return both.join(contexts.distinct(), ["doc_id", "span_id"], "left_semi").distinct().withColumn("citation", F.left(F.sha2(F.concat_ws("|", "doc_id", "span_id"), 256), F.lit(8)))
