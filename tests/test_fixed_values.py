"""Fixed values, one literal case each, typed out and not taken from the library."""

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import names as N


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


STOPS = "a an and are as at be by did do does for from had has have how in is of on or that the to was were what when where which who with".split()


def test_stop_words(spark):
    assert len(STOPS) == 33
    assert one(spark, " ".join(STOPS), T.query_terms) == []
    assert one(spark, "this why its into about 7 x1 ab 42", T.query_terms) == ["this", "why", "its", "into", "about", "7", "42"]
    assert one(spark, "知识库 search 图", T.query_terms) == ["知识", "识库", "search", "图"]


@pytest.mark.parametrize("text", [
    "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "password: abcd", "passwd=abcd", "pwd = abcd", "cookie: abcd", "token=abcd",
    "api key: abcd", "api_key=abcd", "api-key=abcd", "apikey=abcd", "secret: abcd", "Authorization: abcd", "密码：abcd", "令牌=abcd", "密钥: abcd",
    "Bearer abcdefghijkl", "sk-abcdefghijklmnop", "eyJabcdefgh.abcdefgh.abcdefgh",
])
def test_credentials(spark, text):
    assert one(spark, f"see {text} there", T.has_credential)


@pytest.mark.parametrize("text", ["password: abc", "口令: abcdef", "Bearer abcdefghijk", "sk-abcdefghijklmno", "eyJabcdefg.abcdefgh.abcdefgh", "tokens: abcdef", None])
def test_no_credentials(spark, text):
    assert one(spark, text, T.has_credential) is False


def test_redaction(spark):
    assert one(spark, "Mail a.B+c@x-y.org, key sk-abcdefgh, Bearer abc.def_gh~rest, PASSWORD : x 密码=y pwd=z", T.redact_feedback) == "Mail [EMAIL], key [SECRET], [SECRET]~rest, PASSWORD=[REDACTED] 密码=[REDACTED] pwd=z"
    assert one(spark, "x" * 601, T.redact_feedback) == "x" * 600 + "…"
    assert one(spark, " \n", T.redact_feedback) == one(spark, None, T.redact_feedback) == ""


def test_addresses(spark):
    assert one(spark, " HTTPS://Ex.ORG/A?REF=1&Utm_Source=2&b=x%20y+z*&rss&src=3&c=~&d#top ", T.canonical_url) == "https://ex.org/A?b=x+y+z%2A&c=~&d="
    assert one(spark, "http://h", T.canonical_url) == "http://h" and one(spark, "http://h/?ref=1", T.canonical_url) == "http://h/"


def test_acronyms(spark):
    for word in "a an and at by for from in of on or the to with".split():
        assert one(spark, f"alpha {word} beta gamma", N.acronym) == "abg", word
    assert one(spark, "alpha beta", N.acronym) is None and one(spark, "alpha beta g4mma", N.acronym) is None
    assert one(spark, "a b c d e f g h", N.acronym) == "bcdefgh"
    assert one(spark, "one two three four five six seven eight nine", N.acronym) == "ottffsse"


def test_distance_and_matches(spark):
    pairs = [("ca", "abc", 3), ("abcd", "abdc", 1), ("", "ab", 2), ("same", "same", 0), ("kitten", "sitting", 3)]
    for most in range(4):
        got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(N.osa_within("a", "b", F.lit(most)).alias("d")).collect()
        assert [r.d for r in got] == [p[2] if p[2] <= most else None for p in pairs]
    queries = spark.createDataFrame([(1, "How does open-search rank, and who made Postgresql at the EIB? 知识库 tool")], "query_id long, text string")
    aliases = [(1, "who made"), (2, "Open Search"), (3, "OpenSearch"), (4, "european investment bank"), (5, "postgressql"), (6, "postgrseql"), (7, "知识库"), (8, "识"), (9, "rank and who"), (10, "tooll"), (11, "bool"), (12, "")]
    got = {r.alias_id: (r["mode"], r.distance, r.similarity) for r in N.match_aliases(queries, spark.createDataFrame(aliases, "alias_id long, alias string")).collect()}
    assert got == {1: ("EXACT_ALIAS", 0, 1.0), 2: ("EXACT_ALIAS", 0, 1.0), 3: ("PUNCTUATION_NORMALIZED", 0, 1.0), 4: ("ACRONYM", 0, 1.0), 5: ("LATIN_FUZZY", 1, 0.909091), 6: ("LATIN_FUZZY", 1, 0.9), 7: ("EXACT_ALIAS", 0, 1.0), 9: ("EXACT_ALIAS", 0, 1.0)}


def test_features_and_places(spark):
    assert one(spark, "知识 x1 图", T.memory_features) == ["知识", "x1"]
    assert one(spark, "ＡＢ知识9 q", T.citation_features) == ["w:ab", "h:知", "h:识", "b:知识", "w:9", "w:q"]
    assert one(spark, "第3章 开始", T.pdf_heading_depth) == 1 and one(spark, "第十节", T.pdf_heading_depth) == 2
    assert one(spark, "## x", T.pdf_heading_depth) == 2 and one(spark, "1.2) y", T.pdf_heading_depth) == 2 and one(spark, "SHOUT", T.pdf_heading_depth) == 1
    assert one(spark, "Ünder", T.query_language) == "zh" and one(spark, "plain 1", T.query_language) == "en" and one(spark, "12", T.query_language) == "zh"
    assert one(spark, "a😀b", lambda x: T.utf16_slice(x, F.lit(1), F.lit(3))) == "😀"


def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
