"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a hash set that is shipped with the tasks as one constant:
buckets of (hash, words, items). Each document is cut into words once, hashes of its windows are
looked up in the set, and hits are verified word by word. Nothing is shuffled. A benchmark whose
set would exceed ``max_set_bytes`` is looked up by the 64-bit hashes of its windows instead: a broadcast
hash join keeps the few windows of documents whose hash the benchmark has, in the task that cut them; above
``max_broadcast_bytes`` of hashes that join is left to the planner. Window texts are never made for whole documents.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import materialize, table

WINDOW = 13
#: Largest set of windows, as text, that is shipped with the tasks.
MAX_SET_BYTES = 4 << 20
#: Largest set of hashes, at BYTES_A_HASH each in a hash table, that is broadcast.
MAX_BROADCAST_BYTES, BYTES_A_HASH = 256 << 20, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _indices(first: int | Column, n: Column) -> Column:
    """first .. n - 1, or nothing."""
    return F.when(n > F.lit(first), F.sequence(F.lit(first), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _window_hash(column: str, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(column), i + k) for k in range(size)])


def _window_text(column: str, i: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(F.col(column), i + k) for k in range(size)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the benchmark: size, words (joined by spaces), hash, items (as strings, sorted).

    An item with fewer words than ``window``, but not none, is one window; null texts and ids give none.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("item IS NOT NULL AND size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    starts = items.select("item", "w", size.alias("size"), F.explode(_indices(0, F.size("w") - size + 1)).alias("i"))
    cut = starts.select("item", "size", F.slice("w", F.col("i") + 1, F.col("size")).alias("w"))
    by_size = F.coalesce(*[F.when(F.col("size") == n, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(n)])) for n in range(1, window + 1)])
    cut = cut.select("item", "size", F.array_join("w", " ").alias("words"), by_size.alias("hash"))
    return cut.groupBy("size", "words", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _literal_set(rows: list, n_buckets: int) -> Column:
    """The hash set as a constant: bucket (hash modulo n_buckets) -> [(hash, words, items)]."""
    buckets: list[list] = [[] for _ in range(n_buckets)]
    for r in rows:
        buckets[r["hash"] % n_buckets].append({"h": r["hash"], "w": r["words"], "t": r["items"]})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<h:bigint,w:string,t:array<string>>>>")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_set_bytes: int = MAX_SET_BYTES,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Words of every document that lie inside an occurrence of a benchmark window.

    Returns doc_id, carried columns, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and
    20 * n_hit >= n_words) and hit_words (places of the hit words, ascending), one row per row of ``docs``.
    Null, empty and wordless texts have no words and are clean; so is everything against an empty benchmark.
    """
    wins = materialize(benchmark_windows(benchmark, window), "windows")
    total = wins.agg(F.coalesce(F.sum(F.length("words") + F.size("items") * 12 + 40), F.lit(0)).alias("bytes")).first()["bytes"]
    # raw words first, in a projection of their own: later expressions refer to it many times
    base = docs.select(F.col(id_col).alias("doc_id"), *carry, words(F.col(text_col)).alias("w"))
    sizes = [r["size"] for r in wins.select("size").distinct().collect()]  # at most ``window``
    # no windows: nothing to look up
    found = _by_set(base, wins, sizes) if total <= max_set_bytes or not sizes else _by_join(base, wins, sizes, max_broadcast_bytes)
    n_hit, n_words, items = F.size("hit_words"), F.size("w"), F.array_sort(F.array_distinct("items"))
    return (
        found.select("doc_id", *carry, n_words.cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), items.alias("items"), "hit_words")
        .select(
            "doc_id",
            *carry,
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            "hit_words",
        )
    )


_NO_ITEMS = "array<string>"


def _covered(hits: Column, size: int) -> Column:
    return F.flatten(F.transform(hits, lambda i: F.sequence(i, i + (size - 1))))


def _by_set(base: DataFrame, wins: DataFrame, sizes: list[int]) -> DataFrame:
    """Look the windows of each document up in the constant set, then verify them."""
    places, items = [F.array().cast("array<int>")], [F.array().cast(_NO_ITEMS)]
    now = base
    for size in sizes:
        rows = wins.filter(F.col("size") == size).collect()  # bounded by max_set_bytes
        now = _look_up(now, rows, size)
        places.append(_covered(F.transform(F.col(f"got{size}"), lambda x: x["i"]), size))
        items.append(F.flatten(F.transform(F.col(f"got{size}"), lambda x: x["t"])))
    return now.withColumn("hit_words", F.array_sort(F.array_distinct(F.concat(*places)))).withColumn("items", F.concat(*items))


def _look_up(now: DataFrame, rows: list, size: int) -> DataFrame:
    """Add got<size>: (place, items) of the verified windows of that size."""
    n_buckets = 1 << max(4, (4 * len(rows)).bit_length())
    known = _literal_set(rows, n_buckets)
    hashes = F.col(f"h{size}")

    def bucket(h: Column) -> Column:
        return F.get(known, F.pmod(h, F.lit(n_buckets)).cast("int"))

    def maybe(h: Column, i: Column) -> Column:
        return F.when((F.size(bucket(h)) > 0) & F.exists(bucket(h), lambda x: x["h"] == h), i)

    def items_at(i: Column) -> Column:
        same = F.filter(bucket(F.get(hashes, i)), lambda x: (x["h"] == F.get(hashes, i)) & (x["w"] == _window_text("w", i, size)))
        return F.struct(i.alias("i"), F.flatten(F.transform(same, lambda x: x["t"])).alias("t"))

    now = now.withColumn(f"h{size}", F.transform(_indices(0, F.size("w") - (size - 1)), lambda i: _window_hash("w", i, size)))
    now = now.withColumn(f"at{size}", F.array_compact(F.transform(hashes, maybe)))
    now = now.withColumn(f"got{size}", F.filter(F.transform(f"at{size}", items_at), lambda x: F.size(x["t"]) > 0))
    return now.drop(f"h{size}", f"at{size}")


def _by_join(base: DataFrame, wins: DataFrame, sizes: list[int], max_broadcast_bytes: int) -> DataFrame:
    """The same for a benchmark of any size: hashes of windows are joined, and what is left is verified word by word."""
    keyed = materialize(base.withColumn("row", F.monotonically_increasing_id()), "keyed")
    hashes = wins.select("size", "hash").distinct()
    if hashes.count() * BYTES_A_HASH <= max_broadcast_bytes:
        hashes = F.broadcast(hashes)

    def hashed(size: int) -> Column:
        return F.transform(_indices(0, F.size("w") - (size - 1)), lambda i: F.struct(F.lit(size).alias("size"), i.alias("i"), _window_hash("w", i, size).alias("hash")))

    made = [hashed(size) for size in sizes]
    at = keyed.select("row", F.explode(F.flatten(F.array(*made))).alias("x")).select("row", "x.size", "x.i", "x.hash")
    left = at.join(hashes, ["size", "hash"], "left_semi")
    maybe = left.join(wins.select("size", "hash", "words", F.col("items").alias("t")), ["size", "hash"])
    per = maybe.groupBy("row").agg(F.collect_list(F.struct("size", "i", "words", "t")).alias("maybe"))
    joined = keyed.join(per, "row", "left")
    same = F.filter("maybe", lambda x: F.array_join(F.slice("w", x["i"] + 1, x["size"]), " ") == x["words"])
    joined = joined.withColumn("hits", F.coalesce(same, F.array().cast("array<struct<size:int,i:int,words:string,t:array<string>>>")))
    places = F.flatten(F.transform("hits", lambda x: F.sequence(x["i"], x["i"] + x["size"] - 1)))
    return joined.withColumn("hit_words", F.array_sort(F.array_distinct(places))).withColumn("items", F.flatten(F.transform("hits", lambda x: x["t"])))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", length_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words of contaminated documents cut out (``remove="spans"``).

    Keeps the columns of ``docs``; clean documents stay as they are. With ``spans`` each hit word goes
    with the characters up to the next word, and ``length_col`` is set anew.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    found = find_contamination(packed.withColumn("id", F.lit(0)), benchmark, window, "id", "t", carry=("row",))
    # written first: a filter on the verdict would be pushed below the projections that make it, and cut each text into words at every window
    found = materialize(found, "verdicts")
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select("row.*")
    tokens = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.when(F.col(f"`{text_col}`").rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
    out = found.select("row.*", F.col("contaminated").alias("_lore_bad"), F.col("hit_words").alias("_lore_hit"))
    out = out.withColumn("_lore_tokens", tokens).withColumn("_lore_lead", lead)
    kept = F.array_join(F.filter("_lore_tokens", lambda t, i: ~F.array_contains("_lore_hit", i - F.col("_lore_lead"))), "")
    out = out.withColumn(text_col, F.when(F.col("_lore_bad"), kept).otherwise(F.col(f"`{text_col}`")))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("_lore_bad"), F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hit_words")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT r, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
