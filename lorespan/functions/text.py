"""Text functions as column expressions: normalisation, token counts, query terms, detectors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the engine counts it (no-break spaces are characters).
SPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x20]"

# Words that carry no meaning in a query.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "had", "has", "have", "how", "in", "is", "of", "on", "or",
    "that", "the", "to", "was", "were", "what", "when", "where", "which", "who", "with",
)

# Parameters of addresses that only track where a reader came from; so do those that begin with utm_.
TRACKING_KEYS = ("ref", "rss", "src")

# Forms of credentials.
CREDENTIALS = (
    r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----",
    r"(?i)\b(?:password|passwd|pwd|cookie|token|api[ _-]?key|secret|authorization)\b\s*[:=]\s*\S{4,}",
    r"(?:密码|令牌|密钥)\s*[:：=]\s*\S{4,}",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)

# What a quoted remark must not show, and what stands in its place.
REDACTIONS = (
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (r"(?i)(sk-[A-Za-z0-9_-]{8,}|bearer\s+[A-Za-z0-9._-]{8,})", "[SECRET]"),
    (r"(?i)(password|密码)\s*[:=]\s*\S+", "$1=[REDACTED]"),
)


def count_tokens(text: Column) -> Column:
    """Characters that are no white space; null counts as empty."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def prompt_tokens(text: Column) -> Column:
    """All characters."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def truncate_tokens(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def conservative_tokens(text: Column, overhead: int = 8, cap: int = 4096) -> Column:
    """I4: a third of each ASCII run, rounded up, one for each other visible character, an overhead, and a cap."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    third = F.aggregate(runs, F.lit(0), lambda a, x: a + F.ceil(F.length(x) / 3).cast("int"))
    rest = F.length(F.regexp_replace(text, r"[A-Za-z0-9\t\n\x0B\f\r ]", ""))
    return F.least(F.lit(cap), third + rest + overhead).cast("long")


def byte_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def han_bigrams(word: Column) -> Column:
    """Pairs of neighbouring characters; the word itself if it is one character."""
    n = F.length(word)
    return F.when(n < 2, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: word.substr(i, F.lit(2))))


def query_terms(text: Column) -> Column:
    """Distinct terms of a query: Han words as bigrams; others of three letters, or all digits, that are no stop words."""
    useful = F.filter(words(text), lambda w: w.rlike(r"\p{IsHan}") | (((F.length(w) >= 3) | w.rlike(r"^\p{Nd}+$")) & ~w.isin(*STOP_WORDS)))
    return F.array_distinct(F.flatten(F.transform(useful, lambda w: F.when(w.rlike(r"\p{IsHan}"), han_bigrams(w)).otherwise(F.array(w)))))


def type_name(text: Column) -> Column:
    """Upper case, other characters as underscores, at most 64; null without a letter or digit."""
    made = F.substring(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z0-9_]", "_"), 1, 64)
    return F.when(made.rlike("[A-Z0-9]"), made)


def entity_name(text: Column) -> Column:
    """Lower, trimmed, white space collapsed; pass names through ``nfkc_plain`` first where they may hold compatibility forms."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compact_name(text: Column) -> Column:
    """The letters and digits of a normalised name."""
    return F.regexp_replace(entity_name(text), r"[^\p{L}\p{N}]", "")


def answer_text(text: Column) -> Column:
    """Lower, ASCII punctuation as spaces, articles dropped, white space collapsed."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<![A-Za-z0-9_])(a|an|the)(?![A-Za-z0-9_])", " "), r"\s+", " "))


def redact_feedback(text: Column, most: int = 600) -> Column:
    """E-mail addresses, secrets and passwords replaced; cut at ``most`` characters; empty for null and blank."""
    out = text
    for form, instead in REDACTIONS:
        out = F.regexp_replace(out, form, instead)
    cut = F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…"))).otherwise(out)
    return F.when(text.isNull() | ~text.rlike(r"\S"), F.lit("")).otherwise(cut)


def _encoded(part: Column) -> Column:
    """Percent-encoded, as queries of addresses are: letters, digits and _.-~ stand, a blank is a plus sign."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Trimmed, scheme and host in lower case, tracking parameters (in any case) and the fragment dropped, the others encoded anew."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", 0)
    rest = F.substring(plain, F.length(head) + 1, F.length(plain))
    path = F.regexp_replace(rest, r"\?.*$", "")

    def pair(text: Column) -> Column:
        key, value = (F.try_url_decode(F.regexp_extract(text, "^([^=]*)=?(.*)$", i)) for i in (1, 2))
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.transform(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda p: ~F.lower(p["key"]).isin(*TRACKING_KEYS) & ~F.lower(p["key"]).startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(F.lower(head), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def clean_corpus_text(text: Column) -> Column:
    """Blanks of each line collapsed, empty lines dropped, paragraphs parted by an empty line."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def heading_depth(line: Column) -> Column:
    """Depth of a heading line, or null: numbered 1.2.3, chapter marks, short capitals."""
    number = F.regexp_extract(line, r"^(\d+(\.\d+)*)\.?\s+\S", 1)
    return (
        F.when((number != "") & (F.length(line) <= 120), F.least(F.lit(6), F.size(F.split(number, r"\."))))
        .when(line.rlike("^第[0-9一二三四五六七八九十百]+[章节]"), F.lit(1))
        .when((F.length(line) <= 60) & line.rlike("[A-Z]") & ~line.rlike(r"[a-z\p{Ll}]") & line.rlike("^[A-Z0-9 ,:&-]+$"), F.lit(1))
    )


def has_credential(text: Column) -> Column:
    """A private key, a key assignment, a bearer token, a secret key or a signed token; false for null."""
    found = F.lit(False)
    for form in CREDENTIALS:
        found = found | text.rlike(form)
    return F.coalesce(found, F.lit(False))


def pdf_quality(text: Column, least: int = 40, most_noise: float = 0.02, least_readable: float = 0.30) -> Column:
    """GIBBERISH_TEXT by the shares of noise and of letters and digits, LOW_QUALITY_TEXT by their number, else null."""
    seen = F.length(F.regexp_replace(text, SPACE, ""))
    meaning = F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    noise = F.length(F.regexp_replace(F.regexp_replace(text, SPACE, ""), r"[^\uFFFD\p{Cc}\p{Co}\p{Cn}]", ""))
    bad = (noise > F.lit(most_noise) * seen) | (meaning < F.lit(least_readable) * seen)
    return F.when((seen >= least) & bad, F.lit("GIBBERISH_TEXT")).when(meaning < least, F.lit("LOW_QUALITY_TEXT"))


def safe_slug(text: Column) -> Column:
    """Runs of other characters as hyphens, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z_-]+", "-"), "^-+|-+$", ""))


def projection_key(document: Column, revision: Column, acl_version: Column) -> Column:
    """The key under which an index projection is visible."""
    return F.concat(document.cast("string"), F.lit(":"), revision.cast("string"), F.lit(":"), acl_version.cast("string"))


def snippet(text: Column, highlight: Column | None = None, most: int = 220) -> Column:
    """The highlighted fragment without its marks, else the first characters."""
    head = F.substring(text, 1, most)
    return head if highlight is None else F.coalesce(F.regexp_replace(highlight, "</?mark>", ""), head)


def heading_path(text: Column) -> Column:
    """The lines of a heading path that are not blank; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f]"), lambda x: x.rlike(r"\S"))


def source_label(kind: Column, first: Column, last: Column, label: Column, address: Column) -> Column:
    """How a place is named: its own label, else its page or pages, else its address."""
    page = F.when(first == last, F.coalesce(label, F.concat(F.lit("第 "), first.cast("string"), F.lit(" 页"))))
    pages = F.concat(F.lit("第 "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" 页"))
    return F.when(kind == "PAGE", page.otherwise(pages)).otherwise(F.coalesce(label, address))


def query_language(text: Column) -> Column:
    """En for letters of ASCII only, else zh."""
    return F.when(text.rlike("[A-Za-z]") & ~text.rlike(r"[\p{L}&&[^A-Za-z]]"), F.lit("en")).otherwise(F.lit("zh"))


def concise(text: Column, most: int) -> Column:
    """Trimmed and cut; empty for null."""
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, most)


def is_number(text: Column) -> Column:
    """A number once commas are gone; false for null and blank."""
    return F.coalesce(F.replace(text, F.lit(",")).try_cast("double").isNotNull() & text.rlike(r"\S"), F.lit(False))


def pdf_heading_depth(line: Column) -> Column:
    """Depth of a heading line of a page, 0 for others: marks, numbers, chapter signs, then Latin capitals."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+.+$", 1)
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)(?:[、.)])?\s+.+$", 1)
    chapter = F.regexp_extract(line, r"^第[一二三四五六七八九十百千万零〇0-9]+([章节篇部])(?:\s*.*)$", 1)
    latin = F.length(F.regexp_replace(line, r"[^\p{IsLatin}]", ""))
    return (
        F.when(marks != "", F.length(marks))
        .when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\."))))
        .when(chapter.isin("章", "篇", "部"), F.lit(1))
        .when(chapter != "", F.lit(2))
        .when((F.length(line) <= 80) & (latin >= 4) & ~line.rlike(r"[\p{IsLatin}&&\p{IsLowercase}]"), F.lit(1))
        .otherwise(F.lit(0))
    )


def memory_features(text: Column) -> Column:
    """Distinct words, and pairs of neighbouring Han characters in them; a Han character alone is none."""
    found = F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def parts(w: Column) -> Column:
        own = F.when(~w.rlike(r"\p{IsHan}") | (F.length(w) >= 2), F.array(w)).otherwise(F.array().cast("array<string>"))
        pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: w.substr(i, F.lit(2))), lambda x: x.rlike(r"^\p{IsHan}{2}$"))
        return F.concat(own, pairs)

    return F.array_distinct(F.flatten(F.transform(found, parts)))


def citation_features(text: Column, most: int = 4096) -> Column:
    """I8: w: words, h: Han characters and b: their pairs, of the first characters in compatibility form and lower case."""
    plain = F.lower(nfkc_plain(F.substring(F.coalesce(text, F.lit("")), 1, most)))
    runs = F.regexp_extract_all(plain, F.lit(r"\p{IsHan}+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0))

    def parts(run: Column) -> Column:
        n = F.length(run)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h:"), run.substr(i, F.lit(1))))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("b:"), run.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(r"^\p{IsHan}"), F.concat(single, pairs)).otherwise(F.array(F.concat(F.lit("w:"), run)))

    return F.array_distinct(F.flatten(F.transform(runs, parts)))


def text_quality(text: Column) -> Column:
    """C4: why a text goes to quarantine, or null."""
    seen = F.length(F.regexp_replace(text, r"\s", ""))
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    meaning = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(text.contains("\x00"), F.lit("NUL"))
        .when(controls > F.greatest(F.lit(2), F.floor(seen / 100)), F.lit("GIBBERISH"))
        .when(meaning < 40, F.lit("LOW_QUALITY"))
    )


def utf16_length(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


@F.pandas_udf(StringType())
def nfkc_plain(texts):
    """NFKC alone."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def utf16_slice(texts, starts, ends):
    """UTF-16 code units [start, end) of a text; a cut through a pair leaves a replacement mark."""
    import pandas as pd

    cut = lambda t, a, b: None if t is None else t.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le", "replace")
    return pd.Series([cut(t, int(a), int(b)) for t, a, b in zip(texts, starts, ends, strict=True)])


@F.pandas_udf(StringType())
def nfc(texts):
    """B1: line ends as newlines, NFC."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\r\n", "\n").replace("\r", "\n")))


@F.pandas_udf(StringType())
def nfkc(texts):
    """B2: NFKC, no-break spaces as spaces, horizontal white space collapsed, line ends trimmed."""
    import re

    def one(t):
        t = unicodedata.normalize("NFKC", t.replace("\r\n", "\n").replace("\r", "\n")).replace("\xa0", " ")
        return "\n".join(re.sub(r"[ \t\f\v]+", " ", x).rstrip() for x in t.split("\n"))

    return texts.map(lambda t: None if t is None else one(t))
