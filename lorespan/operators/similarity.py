"""Similarity of names and texts, and routing by text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions.text import answer_text, words


def _segments(n: Column, k: Column) -> Column:
    """Places (from 1) and sizes of k + 1 segments of a name of n characters, as even as can be; one of no size if it has too few characters."""
    base, rest = F.floor(n / (k + 1)), n % (k + 1)
    long = k + 1 - rest  # the first segment that has one character more
    made = F.transform(F.sequence(F.lit(0).cast("long"), k), lambda i: F.struct(i.alias("i"), (i * base + F.greatest(i - long, F.lit(0).cast("long")) + 1).cast("int").alias("at"), (base + F.when(i >= long, 1).otherwise(0)).cast("int").alias("size")))
    return F.when(base > 0, made).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(1).alias("at"), F.lit(0).alias("size"))))


def name_pairs(names: DataFrame, least: float) -> DataFrame:
    """Pairs of names with one first letter, lengths at most 3 apart and that Levenshtein similarity.

    A similarity allows so many edits k of the longer name; of k + 1 segments of the shorter one at least one stands in the longer,
    at most k places away. So names meet by first letter, both lengths, and such a segment, and what meets is measured; only names of
    too few characters for k + 1 segments meet all others of their letter and lengths.
    """
    keyed = names.select("name").filter(F.length("name") > 0).distinct().select("name", F.substring("name", 1, 1).alias("c"), F.length("name").cast("long").alias("n"))
    edits = F.floor(F.lit(1 - least) * F.col("n2") + 1e-9)
    short = keyed.select(F.col("name").alias("a"), "c", F.col("n").alias("n1"), F.explode(F.sequence(F.col("n"), F.col("n") + 3)).alias("n2"))
    short = short.select("a", "c", "n1", "n2", F.explode(_segments(F.col("n1"), edits)).alias("s")).select("a", "c", "n1", "n2", "s.i", F.substr("a", F.col("s.at"), F.col("s.size")).alias("part"))
    long = keyed.select(F.col("name").alias("b"), "c", F.col("n").alias("n2"), F.explode(F.sequence(F.greatest(F.col("n") - 3, F.lit(1).cast("long")), F.col("n"))).alias("n1")).withColumn("k", edits)
    long = long.select("b", "c", "n1", "n2", "k", F.explode(_segments(F.col("n1"), F.col("k"))).alias("s"))
    near = F.sequence(F.greatest(F.col("s.at") - F.col("k"), F.lit(1).cast("long")), F.greatest(F.least(F.col("s.at") + F.col("k"), F.col("n2") - F.col("s.size") + 1), F.lit(1).cast("long")))
    places = F.when(F.col("s.size") > 0, F.array_distinct(F.transform(near, lambda at: F.substr("b", at.cast("int"), F.col("s.size"))))).otherwise(F.array(F.lit("")))
    long = long.select("b", "c", "n1", "n2", "s.i", F.explode(places).alias("part"))
    met = short.join(long, ["c", "n1", "n2", "i", "part"]).filter((F.col("n1") < F.col("n2")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    similarity = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return met.withColumn("similarity", F.round(similarity, 6)).filter(similarity >= least)


def token_f1(pairs: DataFrame) -> DataFrame:
    """I16: F1 of the word multisets of two answers (id, a, b); 1 when both are empty."""
    split = lambda c: F.filter(F.split(answer_text(F.col(c)), " "), lambda w: w != "")
    cut = pairs.select("id", split("a").alias("wa"), split("b").alias("wb"))

    def common(wa: Column, wb: Column) -> Column:
        count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
        return F.aggregate(F.array_intersect(wa, wb), F.lit(0), lambda s, w: s + F.least(count(wa, w), count(wb, w)))

    same = cut.withColumn("common", common(F.col("wa"), F.col("wb")))
    na, nb = F.size("wa"), F.size("wb")
    return same.select("id", F.round(F.when((na == 0) & (nb == 0), 1.0).when(F.col("common") == 0, 0.0).otherwise(2.0 * F.col("common") / (na + nb)), 6).alias("f1"))


def near_duplicate_texts(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of texts (id, text) whose word sets have that Jaccard similarity.

    Sets of n words and similarity t share a word among the n - ceil(t n) + 1 rarest of either, so texts meet by those
    only: a word that many texts have is left out wherever rarer ones decide. Met pairs are compared whole.
    """
    sets = texts.select("id", F.array_distinct(words(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    flat = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("term"))
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "term")
    rare = flat.join(df, "term").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    left, right = (rare.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "term") for x in "ab")
    met = left.join(right, "term").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"))
    both = met.join(whole("a"), "a").join(whole("b"), "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    jaccard = F.col("common") / (F.size("wa") + F.size("wb") - F.col("common"))
    return both.filter(jaccard >= least).select("a", "b", F.round(jaccard, 6).alias("jaccard"))


def preflight(docs: DataFrame) -> DataFrame:
    """What the text of pages (doc_id, text, images) looks like, why it goes to a parser, and which one.

    Tables have three blanks or more between words of a line, columns eight or more between twenty characters each; a text of fewer than 40
    letters and digits is of low quality, and scanned if it has images.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")) < 40
    tables = text.rlike(r"(?m)^.*\S\s{3,}\S.*$")
    columns = ~tables & text.rlike(r"(?m)^.{20,}\s{8,}.{20,}$")
    scanned = F.col("images") & low
    # fixed values: reasons
    reason = F.when(scanned, "SCANNED_OR_OCR").when(tables, "COMPLEX_LAYOUT_TABLE").when(columns, "COMPLEX_LAYOUT_MULTICOLUMN").when(low, "LOW_QUALITY_TEXT").otherwise("PDFBOX_SIMPLE_TEXT")
    return docs.select("doc_id", scanned.alias("scanned"), tables.alias("tables"), columns.alias("columns"), low.alias("low_quality"), reason.alias("reason"), F.when(scanned | low | tables | columns, "LAYOUT").otherwise("NATIVE").alias("route"))
