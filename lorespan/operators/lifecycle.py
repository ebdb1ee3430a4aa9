"""Lifecycle: job claims, incremental projection, revisions, retention, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claimable(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The oldest ``n`` jobs that are pending or whose lease has run out, ties by id."""
    free = (F.col("status") == "PENDING") | ((F.col("status") == "RUNNING") & (F.col("lease_until") < now))
    return jobs.filter(free).orderBy("created", "job_id").limit(n).withColumn("attempt", F.col("attempt") + 1)


def claim_jobs(jobs: DataFrame, workers: DataFrame, now: Column, lease: Column, most_attempts: int = 3) -> DataFrame:
    """All jobs after each worker (worker) has claimed one: the oldest free job goes to the first worker by name, and so on.

    ``jobs``: (job_id, status, created, attempt, lease_owner, lease_until). Free is a job that is pending, or running with a lease that has run out, and has
    attempts left; a claimed one is RUNNING, one attempt on, owned until ``now`` + ``lease``. A running job whose last attempt's lease
    has run out is FAILED. Workers are few: as many jobs are ranked.
    """
    out = (F.col("status") == "RUNNING") & (F.col("lease_until") < now)
    last = F.col("attempt") >= most_attempts
    ranked = workers.select("worker").distinct().withColumn("turn", F.row_number().over(Window.orderBy("worker")))  # a stated, small set
    oldest = jobs.filter(((F.col("status") == "PENDING") | out) & ~last).orderBy("created", "job_id").limit(ranked.count()).select("job_id", "created")
    taken = oldest.withColumn("turn", F.row_number().over(Window.orderBy("created", "job_id"))).join(ranked, "turn").select("job_id", "worker")
    mine = F.col("worker").isNotNull()
    status = F.when(mine, "RUNNING").when(out & last, "FAILED").otherwise(F.col("status"))
    return jobs.join(taken, "job_id", "left").select(
        "job_id", status.alias("status"), "created", F.when(mine, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.when(mine, F.col("worker")).otherwise(F.col("lease_owner")).alias("lease_owner"), F.when(mine, now + lease).otherwise(F.col("lease_until")).alias("lease_until")
    )


def after_failure(attempt: Column, most: int) -> Column:
    """The status after a failed attempt."""
    return F.when(attempt < most, "PENDING").otherwise("FAILED")


def stale_projection(source: DataFrame, index: DataFrame, key: str, version: str) -> DataFrame:
    """What an index must take over: (key, action) with UPSERT for missing or older rows, DELETE for rows without a source."""
    both = source.select(key, F.col(version).alias("want")).join(index.select(key, F.col(version).alias("have")), key, "full")
    action = F.when(F.col("want").isNull(), "DELETE").when(F.col("have").isNull() | (F.col("have") < F.col("want")), "UPSERT")
    return both.withColumn("action", action).filter("action IS NOT NULL").select(key, "action")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows in place of those with their keys."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def current_revisions(revisions: DataFrame, key: str, number: str) -> DataFrame:
    """The row of the highest number of each key; late older rows never win."""
    row = F.struct(*revisions.columns)
    return revisions.groupBy(key).agg(F.max_by(row, number).alias("r")).select("r.*")


def evict(entries: DataFrame, order: str, size: str, goal: int, pinned: DataFrame | None = None, key: str = "key", buckets: int = 1024) -> DataFrame:
    """The oldest entries by ``order`` and ``key`` that together free ``goal`` bytes, and what was freed before each; entries that ``pinned`` (key) holds stay.

    Sizes are summed by ranges of the order first; only the ranges before the goal are sorted, each by itself.
    """
    free = entries if pinned is None else entries.join(pinned.select(key).distinct(), key, "left_anti")
    cuts = free.select(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    placed = free.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(order).cast("double")))).drop("cuts")  # one row of cuts
    sums = placed.groupBy("range").agg(F.sum(size).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ``buckets`` rows
    needed = sums.withColumn("before", before).filter(F.col("before") < goal).select("range", "before")
    inside = Window.partitionBy("range").orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return placed.join(F.broadcast(needed), "range").withColumn("freed", freed).filter(F.col("freed") < goal).drop("range", "before")


def format_coverage(documents: DataFrame, projected: DataFrame) -> DataFrame:
    """(format, expected, projected, located, stale): how far an index covers the documents of each format.

    ``documents``: (doc_id, format, revision_id, acl_version), what should be there; ``projected``: (doc_id, revision_id, acl_version, located). A document is stale if
    it is projected at another revision or access version.
    """
    have = projected.select("doc_id", F.col("revision_id").alias("r"), F.col("acl_version").alias("v"), "located")
    j = documents.join(have, "doc_id", "left")
    there = F.col("r").isNotNull()
    same = (F.col("r") == F.col("revision_id")) & (F.col("v") == F.col("acl_version"))
    return j.groupBy("format").agg(F.count("*").alias("expected"), F.count_if(there).alias("projected"), F.count_if(there & same & F.col("located")).alias("located"), F.count_if(there & ~same).alias("stale"))


def closure_status(coverage: DataFrame, orphaned: DataFrame, restricted: DataFrame, invalid: DataFrame, compatible: bool = True, restricted_blocks: bool = False) -> DataFrame:
    """One row: whether an index is closed, and the blockers, joined by plus signs. The last three are one-row tables of a count ``n``."""
    total = coverage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "projected", "located", "stale")])
    one = lambda df, name: F.broadcast(df.select(F.col("n").alias(name)))
    j = total.crossJoin(one(orphaned, "orphaned")).crossJoin(one(restricted, "restricted")).crossJoin(one(invalid, "invalid"))  # one row each
    # Codes of blockers.
    blockers = F.array_compact(
        F.array(
            F.when(~F.lit(compatible), F.lit("SOURCE_LOCATOR_SCHEMA_REQUIRED")),
            F.when(F.col("stale") > 0, F.lit("STALE_PROJECTION")),
            F.when(F.col("orphaned") > 0, F.lit("ORPHANED_PROJECTION")),
            F.when(F.col("expected") > F.col("located"), F.lit("LOCATOR_CLOSURE_INCOMPLETE")),
            F.when(F.lit(restricted_blocks) & (F.col("restricted") > 0), F.lit("RESTRICTED_SOURCE_PRESENT")),
            F.when(F.col("invalid") > 0, F.lit("EVIDENCE_CLOSURE_INCOMPLETE")),
        )
    )
    return j.select("expected", "projected", "located", "stale", "orphaned", (F.size(blockers) == 0).alias("closed"), F.array_join(blockers, "+").alias("blockers"))


def generation_complete(expected: DataFrame, indexed: DataFrame, vectors: bool = True) -> DataFrame:
    """One row: chunks expected and indexed, vectors that are sound, and whether a generation may become ready.

    ``expected``: (chunk_id, revision_id, acl_version); ``indexed``: the same and has_vector.
    """
    j = expected.withColumn("want", F.lit(1)).join(indexed.withColumn("have", F.lit(1)), ["chunk_id", "revision_id", "acl_version"], "full")
    n = j.agg(F.count("want").alias("expected"), F.count("have").alias("indexed"), F.count_if(F.col("have").isNotNull() & F.col("has_vector")).alias("vectors"), F.count_if(F.col("want").isNull() | F.col("have").isNull()).alias("apart"))
    ready = (F.col("apart") == 0) & (F.lit(not vectors) | (F.col("vectors") == F.col("expected")))
    return n.select("expected", "indexed", "vectors", ready.alias("ready"))


def rebuild_requests(open_requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, revision_id, acl_version, state): open requests whose target is no longer current are superseded; each live document has one request of its present state.

    ``open_requests``: (doc_id, revision_id, acl_version, state); ``documents``: (doc_id, revision_id, acl_version, deleted).
    """
    keys = ["doc_id", "revision_id", "acl_version"]
    now = documents.select(*keys, "deleted")
    j = open_requests.join(now.select("doc_id", F.col("revision_id").alias("r"), F.col("acl_version").alias("v"), F.lit(True).alias("known")), "doc_id", "left")
    open_ = F.col("state").isin("REQUESTED", "GRAPH_BUILDING", "GRAPH_READY", "GLOBAL_BUILDING")
    old = F.coalesce("known", F.lit(False)) & ~(F.col("r").eqNullSafe(F.col("revision_id")) & F.col("v").eqNullSafe(F.col("acl_version")))
    kept = j.select(*keys, F.when(open_ & old, F.lit("SUPERSEDED")).otherwise(F.col("state")).alias("state"))
    fresh = now.filter(~F.col("deleted") & F.col("revision_id").isNotNull()).select(*keys).join(open_requests.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.withColumn("state", F.lit("REQUESTED")))


def revision_rollup(jobs: DataFrame) -> DataFrame:
    """(revision_id, status, stages, parsers): the state of each revision by the newest job of each stage.

    ``jobs``: (job_id, revision_id, stage, status, parser, created, updated).
    """
    newest = Window.partitionBy("revision_id", "stage").orderBy(F.col("updated").desc(), F.col("created").desc(), "job_id")
    now = jobs.withColumn("n", F.row_number().over(newest)).filter("n = 1")
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("RUNNING"), "RUNNING").when(has("PENDING"), "PENDING").when(has("QUARANTINED"), "QUARANTINED").when(has("FAILED"), "FAILED").when(has("CANCELLED"), "CANCELLED").otherwise("SUCCEEDED")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return now.groupBy("revision_id").agg(status.alias("status"), joined(F.col("stage")).alias("stages"), joined(F.coalesce("parser", F.lit(""))).alias("parsers"))


def orphaned_objects(objects: DataFrame, rows: DataFrame, before: Column) -> DataFrame:
    """Stored objects (object_key, modified, ...) that no row (object_key) names and that were last changed before a time."""
    return objects.filter(F.col("modified") < before).join(rows.select("object_key").distinct(), "object_key", "left_anti")


def expired_events(events: DataFrame, parents: DataFrame, before: Column) -> DataFrame:
    """Events (event_id, parent_id, ts) older than a time whose parent (parent_id, status) has come to its end; others are kept."""
    ended = parents.filter(F.col("status").isin("SUCCEEDED", "FAILED", "CANCELLED")).select("parent_id")
    return events.filter(F.col("ts") < before).join(ended, "parent_id", "left_semi")


def update_projection(index: DataFrame, access: DataFrame, gone: DataFrame) -> DataFrame:
    """An index (doc_id, revision_id, acl_version, ...) with the access fields of ``access`` (doc_id, acl_version, owner) and without the documents of ``gone`` (doc_id)."""
    fresh = access.select("doc_id", F.struct(*[F.col(c) for c in access.columns if c != "doc_id"]).alias("_new"))
    j = index.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").join(fresh, "doc_id", "left")
    changed = [c for c in access.columns if c != "doc_id"]
    return j.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in index.columns])


def projection_documents(chunks: DataFrame, documents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a searchable chunk, with its document's access fields and the first and last span: key, doc_id, chunk, revision_id, acl_version, owner, title, first_label, last_label, pages.

    ``chunks``: (doc_id, chunk, revision_id); ``documents``: (doc_id, revision_id, acl_version, owner, title), current ones; ``spans``: (doc_id, chunk, span, label).
    """
    ends = spans.groupBy("doc_id", "chunk").agg(F.min_by("label", "span").alias("first_label"), F.max_by("label", "span").alias("last_label"), F.count("*").alias("spans"))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("revision_id").cast("string"), F.col("acl_version").cast("string"))
    return chunks.join(documents, ["doc_id", "revision_id"]).join(ends, ["doc_id", "chunk"], "left").select(key.alias("access_key"), "doc_id", "chunk", "revision_id", "acl_version", "owner", "title", "first_label", "last_label", F.coalesce("spans", F.lit(0)).alias("spans"))


def next_versions(history: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Versions 1, 2, ... of each key; all but the last are superseded."""
    w = Window.partitionBy(*keys)
    out = history.withColumn("version", F.row_number().over(w.orderBy(*order)))
    return out.withColumn("superseded", F.col("version") < F.count("*").over(w))


def idempotency_conflicts(requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that came with more than one fingerprint of the request's fields."""
    print_ = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields]), 256)
    return requests.groupBy(key).agg(F.countDistinct(print_).alias("fingerprints")).filter("fingerprints > 1")
