"""Names: acronyms, compact windows, and the cascade by which an alias is found in a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lorespan.functions.text import entity_name, nfkc_plain
from lorespan.operators.retrieval import BROADCAST_BYTES
from lorespan.shared import spread

# Words without a letter in an acronym.
LINK_WORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")

#: Words of a query and of an alias at most, and the longest word.
QUERY_WORDS, ALIAS_WORDS, LONGEST = 40, 8, 64


def name_words(name: Column, most: int = ALIAS_WORDS) -> Column:
    """The first words of a name in lower case, those of more than 64 characters left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(F.filter(found, lambda w: F.length(w) <= LONGEST), 1, most)


def acronym(name: Column) -> Column:
    """Initials, three to ten, of two to eight words, all of ASCII letters, that are no link words; else null."""
    ws = name_words(name)
    made = F.array_join(F.transform(F.filter(ws, lambda w: ~w.isin(*LINK_WORDS)), lambda w: F.substring(w, 1, 1)), "")
    fits = F.size(ws).between(2, 8) & F.forall(ws, lambda w: w.rlike("^[a-z]+$")) & F.length(made).between(3, 10)
    return F.when(fits, made)


def compact_windows(words: Column) -> Column:
    """Up to eight neighbouring words written as one, of three to 64 characters."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    made = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), ""))))
    return F.array_distinct(F.filter(made, lambda x: F.length(x).between(3, 64)))


def holds_name(query: Column, alias: Column) -> Column:
    """The alias is the query, stands in it between word ends, or, if it is not of ASCII words, anywhere in it."""
    q, a = entity_name(query), entity_name(alias)
    bounded = F.concat(F.lit(" "), F.trim(F.regexp_replace(q, r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    inside = F.when(a.rlike("^[a-z0-9_]+( [a-z0-9_]+)*$"), F.contains(bounded, F.concat(F.lit(" "), a, F.lit(" ")))).otherwise((F.length(a) >= 2) & F.contains(q, a))
    return (a != "") & ((q == a) | inside)


@F.pandas_udf(IntegerType())
def osa_within(left, right, most):
    """Least number of insertions, deletions, replacements and swaps of neighbours, no place edited twice; null if it is above ``most``.

    Only places within ``most`` of the diagonal are filled, and a pair ends at the first row that has none within the bound.
    """
    import pandas as pd

    def one(a: str, b: str, most: int) -> int | None:
        if abs(len(a) - len(b)) > most:
            return None
        far = most + 1
        above, before = [], [j if j <= most else far for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            row = [far] * (len(b) + 1)
            if i <= most:
                row[0] = i
            for j in range(max(1, i - most), min(len(b), i + most) + 1):
                best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != b[j - 1]))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                    best = min(best, above[j - 2] + 1)
                row[j] = min(best, far)
            if min(row) > most and min(before) > most:
                return None
            above, before = before, row
        return before[-1] if before[-1] <= most else None

    return pd.Series([None if a is None or b is None or k is None else one(a, b, k) for a, b, k in zip(left, right, most, strict=True)], dtype="Int32")


def deletion_keys(word: Column, most: Column) -> Column:
    """The word with none, one or (``most`` 2) two characters behind its first left out: two words within ``most`` edits that start alike share one."""
    less = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    one = F.array_distinct(less(word))
    two = F.when(most >= 2, F.array_distinct(F.flatten(F.transform(one, less)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def near_words(left: DataFrame, right: DataFrame, most: int = 1) -> DataFrame:
    """Pairs (a, b, distance) of distinct words of ``left`` (a) and ``right`` (b) that start alike and are within ``most`` edits; 1 or 2.

    Words meet by what is left of them when ``most`` characters are gone, so no key is as common as a first letter.
    """
    keyed = lambda df, c: df.select(c).filter(F.col(c) != "").distinct().select(c, F.explode(deletion_keys(F.col(c), F.lit(most))).alias("key"))
    met = keyed(left, "a").join(keyed(right, "b"), "key").select("a", "b").filter((F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.abs(F.length("a") - F.length("b")) <= most)).distinct()
    return met.withColumn("distance", osa_within("a", "b", F.lit(most))).filter("distance IS NOT NULL")


def _plain(name: Column) -> Column:
    return name.rlike("^[a-z0-9_]+( [a-z0-9_]+)*$")


def _odd_pairs(name: Column) -> Column:
    """Neighbouring characters of which one can't stand in an alias of ASCII words."""
    pairs = F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.filter(F.array_distinct(pairs), lambda x: x.rlike("[^a-z0-9_ ]")), lambda x: F.concat(F.lit("p:"), x))


def containment_join(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (id, alias) of the aliases (alias) that each text (id, text) holds, by ``holds_name``.

    An alias of ASCII words is met by the one of its words that fewest texts have, any other by its rarest pair of characters that such aliases
    can't have, an odd single character by the whole text. So a text meets the aliases of its words, and every meeting is verified. Null
    texts and aliases hold and match nothing; repeated aliases count once, repeated rows each.
    """
    words = lambda c: F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), lambda w: F.concat(F.lit("w:"), w))
    named = aliases.select("alias").filter(F.col("alias").isNotNull()).distinct().withColumn("a", entity_name(F.col("alias"))).filter("a <> ''")
    a_keys = F.when(_plain(F.col("a")), F.transform(F.array_distinct(F.split("a", " ")), lambda w: F.concat(F.lit("w:"), w))).when(F.length("a") > 1, _odd_pairs(F.col("a"))).otherwise(F.array(F.concat(F.lit("e:"), "a")))
    keyed = named.select("alias", F.explode(a_keys).alias("key"))
    q = entity_name(F.col("text"))
    q_keys = F.concat(words(F.col("q")), _odd_pairs(F.col("q")), F.when(F.length("q") == 1, F.array(F.concat(F.lit("e:"), "q"))).otherwise(F.array().cast("array<string>")))
    # only words that some alias has stay
    met = texts.select("id", "text", q.alias("q")).filter("q <> ''").select("id", "text", F.explode(q_keys).alias("key")).join(keyed.select("key").distinct(), "key", "left_semi")
    seen = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = keyed.join(seen, "key", "left").groupBy("alias").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return met.join(rarest, "key").filter(holds_name(F.col("text"), F.col("alias"))).select("id", "alias")


def match_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, alias_id, mode, distance, similarity): how each alias is found in each query, the strongest way only.

    ``queries``: (query_id, text), a stated set; ``aliases``: (alias_id, alias). Ways, strongest first: EXACT_ALIAS, PUNCTUATION_NORMALIZED
    (its words in a row, or written as one), ACRONYM, LATIN_FUZZY (one word of five letters or more with the same first letter and
    one swap or typing error, two from nine letters on if similarity is 0.88). Candidates meet by keys: words for exact and fuzzy
    ways, compact windows and acronyms for theirs, words with a character or two left out for fuzzy ones, so aliases and queries are never
    compared all with all; aliases that are not of ASCII words meet the queries' odd character pairs.
    """
    # a query meets aliases by tens of keys
    q = spread(queries.select("query_id", "text"), queries.count() * QUERY_WORDS, "query_id").select("query_id", nfkc_plain(F.col("text")).alias("text")).withColumn("words", name_words(F.col("text"), QUERY_WORDS)).withColumn("windows", compact_windows(F.col("words")))
    a = aliases.select("alias_id", nfkc_plain(F.col("alias")).alias("alias")).withColumn("ws", name_words(F.col("alias"))).withColumn("acronym", acronym(F.col("alias")))
    latin = "^[a-z]{5,64}$"
    # word keys: the first word of an alias of ASCII words stands in the query; others share an odd pair of characters, or are the query
    plain = _plain(entity_name(F.col("alias")))
    first_word = F.split(entity_name(F.col("alias")), " ")[0]
    odd = _odd_pairs(entity_name(F.col("alias")))
    q_words = F.regexp_extract_all(entity_name(F.col("text")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    q_keys = F.concat(F.transform(q_words, lambda w: F.concat(F.lit("w:"), w)), _odd_pairs(entity_name(F.col("text"))), F.array(F.concat(F.lit("e:"), entity_name(F.col("text")))), F.transform("windows", lambda w: F.concat(F.lit("c:"), w)), F.transform("words", lambda w: F.concat(F.lit("c:"), w)))
    # an alias of nine letters or more may be two edits from a word of seven
    fuzzy_of = lambda ws, longest: F.flatten(F.transform(F.filter(ws, lambda w: w.rlike(latin)), lambda w: F.transform(deletion_keys(w, F.when(F.length(w) <= longest, 1).otherwise(2)), lambda k: F.concat(F.lit("f:"), k))))
    a_keys = F.array_compact(
        F.array(
            F.when(plain, F.concat(F.lit("w:"), first_word)).when(F.size(odd) > 0, F.get(odd, F.lit(0))).otherwise(F.concat(F.lit("e:"), entity_name(F.col("alias")))),
            F.when(F.size("ws") > 0, F.concat(F.lit("c:"), F.array_join("ws", ""))),
            F.concat(F.lit("c:"), F.col("acronym")),
        )
    )
    keyed_q = q.withColumn("key", F.explode(F.array_distinct(F.concat(q_keys, fuzzy_of(F.col("words"), 6)))))
    keyed_a = a.withColumn("key", F.explode(F.array_distinct(F.concat(a_keys, F.when(F.size("ws") == 1, fuzzy_of(F.col("ws"), 8)).otherwise(F.array().cast("array<string>"))))))
    # queries with all their keys are never broadcast, aliases only if they are few
    size = keyed_a.agg(F.coalesce(F.sum(F.octet_length("key") + 2 * F.octet_length("alias") + 128), F.lit(0))).first()[0]
    met = keyed_q.join(F.broadcast(keyed_a) if size <= BROADCAST_BYTES else keyed_a.hint("merge"), "key").select("query_id", "text", "words", "windows", "alias_id", "alias", "ws", "acronym").dropDuplicates(["query_id", "alias_id"])
    in_row = (F.size("ws") > 1) & F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")))
    compact = F.array_join("ws", "")
    mode = (
        F.when(holds_name(F.col("text"), F.col("alias")), F.lit("EXACT_ALIAS"))
        .when((F.size("ws") > 0) & (in_row | ((F.length(compact) >= 3) & F.array_contains("windows", compact))), F.lit("PUNCTUATION_NORMALIZED"))
        .when(F.array_contains("words", F.col("acronym")), F.lit("ACRONYM"))
    )
    judged = met.withColumn("mode", mode)
    sure = judged.filter("mode IS NOT NULL").select("query_id", "alias_id", "mode", F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))
    word = F.get("ws", F.lit(0))
    rest = judged.filter(F.col("mode").isNull() & (F.size("ws") == 1) & word.rlike(latin)).select("query_id", "alias_id", word.alias("a"), F.explode("words").alias("b"))
    most = F.when(F.length("a") <= 8, 1).otherwise(2)
    rest = rest.filter(F.col("b").rlike(latin) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.abs(F.length("a") - F.length("b")) <= most))
    near = rest.withColumn("distance", osa_within("a", "b", most)).filter("distance IS NOT NULL").withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("a"), F.length("b")))
    near = near.filter((F.col("distance") <= most) & ((F.length("a") < 9) | (F.col("similarity") >= 0.88)))
    best = Window.partitionBy("query_id", "alias_id").orderBy("distance", F.col("similarity").desc(), "b")
    near = near.withColumn("n", F.row_number().over(best)).filter("n = 1").select("query_id", "alias_id", F.lit("LATIN_FUZZY").alias("mode"), "distance", "similarity")
    return sure.unionByName(near).withColumn("similarity", F.round("similarity", 6))


# Aliases that one scan reads at most, the reason where there are more, and ways of matching in order.
MOST_ALIASES, TOO_MANY_ALIASES, MODES = 20_000, "GRAPH_ENTITY_LINK_SHADOW_SCAN_LIMIT", ("EXACT_ALIAS", "PUNCTUATION_NORMALIZED", "ACRONYM", "LATIN_FUZZY")


def alias_scan(queries: DataFrame, aliases: DataFrame, evidence: DataFrame, visible: DataFrame, limit: int = 20, most_aliases: int = MOST_ALIASES) -> tuple[DataFrame, DataFrame]:
    """Entities whose aliases a query names, of what its reader may see; and the outcome of each query.

    ``queries``: (query_id, reader, text); ``aliases``: (entity_id, alias); ``evidence``: (entity_id, alias, mention_id, doc_id); ``visible``:
    (reader, doc_id). An alias counts for a reader only with evidence in a document that they see. Candidates: (query_id, rank, entity_id, alias,
    mode, distance, similarity, evidence_count, doc_ids): an entity's best alias by mode, distance, similarity and name, its largest evidence
    and the documents of all its aliases that match; the first ``limit`` by the same order, more evidence and entity.
    Outcomes: (query_id, status, matched, truncated): MEASURED with the entities matched and whether ``limit`` cut them; of a reader with more than
    ``most_aliases`` aliases nothing is scanned and the status says so.
    """
    name = entity_name(F.col("alias"))
    seen = evidence.select("entity_id", name.alias("name"), "mention_id", "doc_id").join(visible.select("reader", "doc_id").distinct(), "doc_id")
    backed = seen.groupBy("reader", "entity_id", "name").agg(F.countDistinct("mention_id").alias("evidence_count"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))
    known = aliases.select("entity_id", "alias", name.alias("name")).filter("name <> ''").distinct().join(backed, ["entity_id", "name"])
    counted = known.groupBy("reader").agg(F.count(F.lit(1)).alias("aliases"))
    asked = queries.join(counted, "reader", "left").withColumn("scanned", F.coalesce("aliases", F.lit(0)) <= most_aliases)
    # an alias is matched once for all readers
    texts = known.select("alias").distinct().select(F.xxhash64("alias").alias("alias_id"), "alias")
    found = match_aliases(asked.filter("scanned").select("query_id", "text"), texts).join(texts, "alias_id").drop("alias_id")
    hits = found.join(asked.filter("scanned").select("query_id", "reader"), "query_id").join(known, ["reader", "alias"])
    order = F.struct(F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")).alias("way"), F.col("distance"), (-F.col("similarity")).alias("unlike"), F.col("name"))
    merged = hits.groupBy("query_id", "entity_id").agg(
        F.min(F.struct(order.alias("order"), "alias", "mode", "distance", "similarity")).alias("best"),
        F.max("evidence_count").alias("evidence_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"),
    )
    ranked = Window.partitionBy("query_id").orderBy("best.order.way", "best.order.distance", "best.order.unlike", F.col("evidence_count").desc(), "entity_id")
    top = merged.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= limit)
    candidates = top.select("query_id", "rank", "entity_id", "best.alias", "best.mode", "best.distance", "best.similarity", "evidence_count", "doc_ids")
    total = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"))
    outcomes = asked.join(total, "query_id", "left").select("query_id", F.when(F.col("scanned"), "MEASURED").otherwise(TOO_MANY_ALIASES).alias("status"), F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) > limit).alias("truncated"))
    return candidates, outcomes
