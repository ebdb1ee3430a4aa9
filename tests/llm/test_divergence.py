"""Source divergence against a plain version, with nulls, ties, repeats and clashing columns."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lorespan.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, pseudo, top):
    groups, counts, docs = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        counts[key].update(terms)
        docs[key[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + pseudo) // (n + pseudo * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


ROWS = [
    ("The cat, the CAT", "en", "a"),
    ("the cat", "en", "a"),
    ("the cat", "en", "a"),
    ("dog the éÉ ǅ 日本", "en", "b"),
    ("dog dog the 日本", "en", None),
    (None, "en", "empty"),
    ("12 ++ 3", "en", "signs"),
    ("le chat", None, "a"),
    ("le chat", None, None),
    ("nur einmal", "de", "b"),
    ("", "de", "c"),
    ("x " * 5000 + "the", "en", "long"),
]


@pytest.mark.parametrize("min_docs,top", [(1, 50), (2, 1), (2, 50), (99, 50)])
def test_equals_the_plain_version(spark, min_docs, top):
    docs = spark.createDataFrame([(*r, i, "k", 1.0) for i, r in enumerate(ROWS)], "text string, lang string, source string, doc_id long, term string, value double")
    got = divergence.audit_sources(docs, min_docs=min_docs, top_terms=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(ROWS, min_docs, 5, top)


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_beyond_a_long(spark):
    """Shares are whole numbers of 38 digits: a thousand million times a count may pass 2**63."""
    from pyspark.sql import functions as F

    n, total, v = 9 * 10**17, 10**18 + 7, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence._share(F.col("n"), F.col("total"), F.col("v"), 5)).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_terms_are_those_of_the_ranges(spark):
    from pyspark.sql import functions as F

    text = "".join(map(chr, range(0x250))) + "日本 😀"
    got = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all("text", F.lit(divergence._TERM), F.lit(0))).first()[0]
    assert got == TERM.findall(text)


def test_equals_the_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, divergence.op11_source_divergence(spark, sf).collect())) == sorted(con.sql(divergence.OP11_SQL).fetchall())
