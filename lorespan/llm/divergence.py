"""Source divergence audit: how far the word use of each (lang, source) group lies from the others' and from its language's.

Plain relational work. Terms are exploded from every text and counted by (lang, source, term), which also
pre-aggregates hot terms and hot sources before the shuffle. The kept vocabulary meets the groups of its
language to give zeros a row, shares of two groups meet by (lang, term), and ranks are windows over sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespan.llm.common import materialize, table

#: Documents of a language that hold a kept term, pseudo-count of every kept term, whole of a share, ranks of part ``term``.
MIN_DOCS, PSEUDO, WHOLE, TOP_TERMS = 30, 5, 1_000_000_000, 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with every character named: Java then looks each up in one table instead of trying ranges.
_TERM = "[^" + "".join(f"\\x{c:02X}" for c in [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]) + "]+"
#: Slices of a language's vocabulary when it meets the groups, so that one language doesn't end up in one task.
SLICES = 64


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that hold it."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    terms = F.sort_array(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0)))
    # sorted, a text's first occurrence of a term is the one that differs from its neighbour
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.when(F.get("terms", i - 1).eqNullSafe(t), 0).otherwise(1).alias("first")))
    exploded = docs.select(*read).select("lang", "source", terms.alias("terms")).select("lang", "source", F.explode(marked).alias("x"))
    return exploded.select("lang", "source", "x.term", "x.first").groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def _share(count: Column, total: Column, vocabulary: Column, pseudo: int) -> Column:
    """1 + floor(WHOLE * (count + pseudo) / (total + pseudo * vocabulary)), exact: whole numbers of 38 digits."""
    wide = "decimal(20,0)"
    above = F.lit(WHOLE).cast("decimal(11,0)") * (count + pseudo).cast(wide)
    return F.call_function("div", above, (total + vocabulary * pseudo).cast(wide)) + 1


def audit_sources(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    pseudo: int = PSEUDO,
    top_terms: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Distance of every group to the other sources of its language, and the terms that it uses more than its language.

    Returns lang, source, part, item, value (long), rank (int). Part ``pair``: one row per ordered pair of
    sources of a language, value the sum over kept terms of |p - q|. Part ``term``: the ``top_terms`` kept terms
    whose share in the group exceeds that in the language by most. Ranks run from 1 per group and part, by
    value downwards, then by item in UTF-8 order.

    Null text, lang and source count as ''; a group without terms takes part with counts of zero; a language
    without kept terms has pairs of value 0 and no terms; a language with one source has no pairs; an empty
    table gives no rows. Repeated rows are documents of their own. Other columns are not read.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    counts = term_counts(docs, text_col, lang_col, source_col)
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("uses"))
    # one row a kept term; its uses are one a source at most
    kept = materialize(by_term.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n_lang").alias("total_lang"))
    uses = kept.select("lang", "term", F.explode("uses").alias("source", "n"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = materialize(
        groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "vocabulary", "total_lang")]),
        "source-groups",
    )
    sliced = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    dense = (
        kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(SLICES)).cast("int"))
        .join(sliced, ["lang", "slice"])
        .withColumn("n", F.coalesce(F.try_element_at("uses", F.col("source")), zero))
        .select("lang", "term", "source", "n", _share(F.col("n"), F.col("total"), F.col("vocabulary"), pseudo).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("vocabulary"), pseudo).alias("q"))
    )
    dense = materialize(dense, "source-shares")
    a, b = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    # each unordered pair once; its other direction has the same value
    apart = a.join(b, ["lang", "term"]).filter(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q")).cast("decimal(20,0)")).cast("long").alias("value"))
    both = apart.unionByName(apart.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    pairs = others.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    terms = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = F.row_number().over(order).alias("rank")
    return pairs.select("*", ranked).unionByName(terms.select("*", ranked).filter(F.col("rank") <= top_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
nl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(n.total, 0) + 5 * v.v) AS p,
                 1 + CAST(1000000000 AS HUGEINT) * (cl.n + 5) // (nl.total + 5 * v.v) AS q
          FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN nl USING (lang) JOIN cl USING (lang, term)
          LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
