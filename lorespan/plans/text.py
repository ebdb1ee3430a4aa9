"""Queries of text functions and predicates (families B, C, I), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import ids
from lorespan.functions import text as T
from lorespan.operators import names as N
from lorespan.operators import similarity as S
from lorespan.sources.tables import read


def _select(name: str, *columns: Column):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return read(spark, d, name).select(*columns)

    return query


def _lazy(name: str, make):
    """Columns are made when the query runs: they need a session."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return read(spark, d, name).select(*make())

    return query


_t = lambda: F.col("text")


def _part_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every twentieth part asks with its name and type."""
    return read(spark, d, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_size") % 5).alias("reader"))


def _alias_scan(spark: SparkSession, d: str) -> DataFrame:
    """Parts are entities named by the first words of their names, lines their mentions, suppliers the documents, of which a reader sees those of some nations."""
    aliases = read(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.explode(F.slice(F.split("p_name", " "), 1, 2)).alias("alias"))
    lines = read(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("mention_id"), F.col("l_suppkey").alias("doc_id"))
    visible = read(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("reader"), F.col("s_suppkey").alias("doc_id"))
    candidates, outcomes = N.alias_scan(_part_queries(spark, d), aliases, aliases.join(lines, "entity_id"), visible)
    return outcomes.join(candidates.drop("doc_ids"), "query_id", "left")


QUERIES = {
    "i1_count_tokens": (_lazy("documents", lambda: ["doc_id", T.count_tokens(_t()).alias("tokens"), T.prompt_tokens(_t()).alias("prompt_tokens"), T.byte_tokens(_t()).alias("byte_tokens")]), r"SELECT doc_id, length(regexp_replace(text, '[\t\n\x0B\f\r\x1C-\x1F\x20]', '', 'g')) AS tokens, length(text) AS prompt_tokens, CAST(ceil(strlen(text) / 4) AS BIGINT) AS byte_tokens FROM documents"),
    "i3_truncate_tokens": (_lazy("documents", lambda: ["doc_id", T.truncate_tokens(_t(), 200).alias("head")]), "SELECT doc_id, left(text, 200) AS head FROM documents"),
    "i4_conservative_tokens": (
        _lazy("conversations", lambda: ["conv_id", "turn", T.conservative_tokens(_t()).alias("tokens")]),
        r"SELECT conv_id, turn, CAST(least(4096, coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: ceil(length(x) / 3))), 0) + length(regexp_replace(text, '[A-Za-z0-9\t\n\x0B\f\r ]', '', 'g')) + 8) AS BIGINT) AS tokens FROM conversations",
    ),
    "i6_query_terms": (
        _lazy("benchmark", lambda: ["item_id", F.array_join(F.array_sort(T.query_terms(_t())), " ").alias("terms")]),
        r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: (length(w) >= 3 OR regexp_matches(w, '^[0-9]+$')) AND NOT list_contains(['a','an','and','are','as','at','be','by','did','do','does','for','from','had','has','have','how','in','is','of','on','or','that','the','to','was','were','what','when','where','which','who','with'], w)))), ' ') AS terms FROM benchmark",
    ),
    "i10_levenshtein_similarity": (
        lambda spark, d: S.name_pairs(read(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), 0.6),
        "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS a, b.name AS b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity FROM n a JOIN n b ON left(a.name, 1) = left(b.name, 1) AND a.name < b.name AND abs(length(a.name) - length(b.name)) <= 3 WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.6",
    ),
    "i12_acronym": (
        _lazy("part", lambda: ["p_partkey", N.acronym(F.concat_ws(" ", "p_name", F.lit("of the"), "p_type", F.regexp_extract("p_brand", "[A-Za-z]+", 0))).alias("acronym")]),
        r"""WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(concat_ws(' ', p_name, 'of the', p_type, regexp_extract(p_brand, '[A-Za-z]+'))), '[\p{L}\p{N}]+'), lambda x: length(x) <= 64)[1:8] AS w FROM part),
        i AS (SELECT p_partkey, w, array_to_string(list_transform(list_filter(w, lambda x: NOT list_contains(['a','an','and','at','by','for','from','in','of','on','or','the','to','with'], x)), lambda x: left(x, 1)), '') AS made FROM w)
        SELECT p_partkey, CASE WHEN len(w) BETWEEN 2 AND 8 AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[a-z]+'))) = 0 AND length(made) BETWEEN 3 AND 10 THEN made END AS acronym FROM i""",
    ),
    "i16_token_f1": (
        lambda spark, d: S.token_f1(read(spark, d, "conversations").filter("turn = 1").select(F.col("conv_id").alias("id"), F.col("text").alias("a")).join(read(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.col("text").alias("b")), "id")),
        r"""WITH p AS (SELECT a.conv_id AS id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(a.text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS a, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(b.text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS b FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 1 AND b.turn = 0),
        x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM p) GROUP BY ALL), y AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(b) AS w FROM p) GROUP BY ALL),
        o AS (SELECT id, sum(least(x.n, y.n)) AS common FROM x JOIN y USING (id, w) GROUP BY id)
        SELECT id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN coalesce(common, 0) = 0 THEN 0.0 ELSE 2.0 * common / (len(a) + len(b)) END, 6) AS f1 FROM p LEFT JOIN o USING (id)""",
    ),
    "i17_heading_depth": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count(T.heading_depth(F.col("line"))).alias("n_headings"), F.coalesce(F.max(T.heading_depth(F.col("line"))), F.lit(0)).alias("deepest")),
        r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        h AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^(\d+(\.\d+)*)\.?\s+\S') AND length(line) <= 120 THEN least(6, len(string_split(regexp_extract(line, '^(\d+(\.\d+)*)\.?\s+\S', 1), '.')))
          WHEN regexp_matches(line, '^第[0-9一二三四五六七八九十百]+[章节]') THEN 1 WHEN length(line) <= 60 AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z\p{Ll}]') AND regexp_matches(line, '^[A-Z0-9 ,:&-]+$') THEN 1 END AS depth FROM l)
        SELECT doc_id, count(depth) AS n_headings, coalesce(max(depth), 0) AS deepest FROM h GROUP BY doc_id""",
    ),
    "i22_json_extract": (_lazy("events", lambda: ["event_id", F.get_json_object("props", "$.k").cast("int").alias("k")]), "SELECT event_id, CAST(props->>'k' AS INT) AS k FROM events"),
    "i24_stable_uuid": (
        _lazy("documents", lambda: ["doc_id", ids.stable_uuid(F.col("doc_id"), F.col("source")).alias("uid"), ids.name_uuid(F.lit("entity"), F.col("doc_id")).alias("named")]),
        """WITH h AS (SELECT doc_id, sha256(concat_ws('|', doc_id, coalesce(source, 'null'))) AS h, md5(concat_ws('|', 'entity', doc_id)) AS m FROM documents),
        v AS (SELECT *, substr('89ab', (position(h[17] IN '0123456789abcdef') - 1) % 4 + 1, 1) AS hv, substr('89ab', (position(m[17] IN '0123456789abcdef') - 1) % 4 + 1, 1) AS mv FROM h)
        SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || hv || h[18:20] || '-' || h[21:32] AS uid, m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-' || mv || m[18:20] || '-' || m[21:32] AS named FROM v""",
    ),
    "i19_utf16_length": (_lazy("documents", lambda: ["doc_id", T.utf16_length(_t()).alias("units")]), "SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\U00010000-\U0010FFFF]')) AS units FROM documents"),
    "b4_type_name": (_lazy("part", lambda: ["p_partkey", T.type_name(F.concat_ws(" ", "p_type", "p_brand")).alias("type")]), "SELECT p_partkey, left(regexp_replace(upper(trim(p_type || ' ' || p_brand)), '[^A-Z0-9_]', '_', 'g'), 64) AS type FROM part"),
    "b5_compact_name": (_lazy("supplier", lambda: ["s_suppkey", T.compact_name(F.col("s_name")).alias("compact")]), r"SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '[^\p{L}\p{N}]', '', 'g') AS compact FROM supplier"),
    "b6_answer_text": (_lazy("conversations", lambda: ["conv_id", "turn", T.answer_text(_t()).alias("answer")]), r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS answer FROM conversations"),
    "b7_redact_feedback": (
        _lazy("conversations", lambda: ["conv_id", "turn", T.redact_feedback(_t()).alias("clean")]),
        r"WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[EMAIL]', 'gi'), '(sk-[A-Za-z0-9_-]{8,}|bearer\s+[A-Za-z0-9._-]{8,})', '[SECRET]', 'gi'), '(password|密码)\s*[:=]\s*\S+', '\1=[REDACTED]', 'gi') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t IS NULL OR NOT regexp_matches(t, '\S') THEN '' WHEN length(t) > 600 THEN left(t, 600) || '…' ELSE t END AS clean FROM a",
    ),
    "b8_canonical_url": (
        _lazy("pages", lambda: ["page_id", T.canonical_url(F.col("url")).alias("url")]),
        r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS url FROM pages),
        a AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*') AS head, substr(url, length(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*')) + 1) AS rest FROM p),
        b AS (SELECT page_id, lower(head) AS head, regexp_replace(rest, '\?.*$', '') AS path, list_transform(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> ''), lambda x: [url_decode(replace(regexp_extract(x, '^([^=]*)=?(.*)$', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '^([^=]*)=?(.*)$', 2), '+', ' '))]) AS q FROM a),
        c AS (SELECT page_id, head, path, array_to_string(list_transform(list_filter(q, lambda x: lower(x[1]) NOT IN ('ref', 'rss', 'src') AND NOT starts_with(lower(x[1]), 'utm_')), lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') AS q FROM b)
        SELECT page_id, head || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM c""",
    ),
    "b9_clean_corpus_text": (_lazy("documents", lambda: ["doc_id", F.md5(T.clean_corpus_text(_t())).alias("digest")]), r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10))) AS digest FROM documents"),
    "c4_text_quality": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", F.coalesce(T.text_quality(F.col("text")), F.lit("OK")).alias("verdict")),
        r"""SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'NUL' WHEN length(text) - length(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g')) > greatest(2, floor(length(regexp_replace(text, '\s', '', 'g')) / 100)) THEN 'GIBBERISH' WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 40 THEN 'LOW_QUALITY' ELSE 'OK' END AS verdict FROM documents""",
    ),
    "c6_credentials": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", T.has_credential(F.col("text")).alias("credential")),
        r"""SELECT doc_id, regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----') OR regexp_matches(text, '(?i)\b(?:password|passwd|pwd|cookie|token|api[ _-]?key|secret|authorization)\b\s*[:=]\s*\S{4,}') OR regexp_matches(text, '(?:密码|令牌|密钥)\s*[:：=]\s*\S{4,}') OR regexp_matches(text, '(?i)\bBearer\s+[A-Za-z0-9._~+/-]{12,}') OR regexp_matches(text, '\bsk-[A-Za-z0-9_-]{16,}\b') OR regexp_matches(text, '\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b') AS credential FROM documents""",
    ),
    "c8_substring_search": (lambda spark, d: read(spark, d, "documents").filter(F.lower("text").contains("license")).select("doc_id"), "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%'"),
    "c9_prefix_search": (lambda spark, d: read(spark, d, "part").filter(F.lower("p_name").startswith("red")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'red')"),
    "c10_distinct_from": (lambda spark, d: read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").filter(~F.col("quality").eqNullSafe(F.lit(1))).select("doc_id", "quality"), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1"),
    "c14_time_window": (lambda spark, d: read(spark, d, "events").filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00' - INTERVAL 24 HOURS")).groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOURS GROUP BY ALL"),
    "c15_near_duplicate_queries": (
        lambda spark, d: S.near_duplicate_texts(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 0.1),
        r"""WITH t AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
        u AS (SELECT id, len(w) AS n, unnest(w) AS term FROM t), c AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY ALL)
        SELECT a, b, round(common / (na + nb - common), 6) AS jaccard FROM c WHERE common / (na + nb - common) >= 0.1""",
    ),
    "a15_pdf_preflight": (
        lambda spark, d: S.preflight(read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit(".    "))).otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 2 == 0).alias("images"))),
        r"""WITH t AS (SELECT doc_id, doc_id % 2 = 0 AS images, CASE WHEN doc_id % 3 = 0 THEN replace(text, '. ', '.    ') ELSE text END AS text FROM documents),
        f AS (SELECT doc_id, images, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) < 40 AS low, regexp_matches(text, '(?m)^.*\S\s{3,}\S.*$') AS tables, regexp_matches(text, '(?m)^.{20,}\s{8,}.{20,}$') AS cols FROM t)
        SELECT doc_id, images AND low AS scanned, tables, NOT tables AND cols AS columns, low AS low_quality, CASE WHEN images AND low THEN 'SCANNED_OR_OCR' WHEN tables THEN 'COMPLEX_LAYOUT_TABLE' WHEN cols THEN 'COMPLEX_LAYOUT_MULTICOLUMN' WHEN low THEN 'LOW_QUALITY_TEXT' ELSE 'PDFBOX_SIMPLE_TEXT' END AS reason, CASE WHEN low OR tables OR cols THEN 'LAYOUT' ELSE 'NATIVE' END AS route FROM f""",
    ),
    "b10_safe_slug": (_lazy("pages", lambda: ["page_id", T.safe_slug(F.col("url")).alias("slug")]), "SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^0-9A-Za-z_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages"),
    "b11_projection_key": (_lazy("documents", lambda: ["doc_id", T.projection_key(F.col("doc_id"), F.col("n_chars"), F.lit(1)).alias("key")]), "SELECT doc_id, doc_id || ':' || n_chars || ':1' AS key FROM documents"),
    "b12_snippet": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.when(F.contains("text", F.lit("license")), F.regexp_replace(F.regexp_extract("text", "[^\n]{0,40}license[^\n]{0,40}", 0), "license", "<mark>license</mark>"))).alias("snippet")),
        "SELECT doc_id, CASE WHEN contains(text, 'license') THEN regexp_extract(text, '[^\n]{0,40}license[^\n]{0,40}') ELSE left(text, 220) END AS snippet FROM documents",
    ),
    "b13_heading_path": (_lazy("documents", lambda: ["doc_id", F.size(T.heading_path(_t())).alias("levels"), F.get(T.heading_path(_t()), F.lit(0)).alias("first")]), r"WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS p FROM documents) SELECT doc_id, len(p) AS levels, p[1] AS first FROM p"),
    "b14_source_label": (
        lambda spark, d: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.source_label(F.when(F.col("l_returnflag") == "N", "PAGE").otherwise("CELL_RANGE"), F.col("l_linenumber"), F.col("l_linenumber") + (F.col("l_linestatus") == "O").cast("int"), F.when(F.col("l_quantity") > 25, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))), F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"))).alias("label")),
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN coalesce(CASE WHEN l_quantity > 25 THEN 'part ' || l_partkey END, '第 ' || l_linenumber || ' 页') WHEN l_returnflag = 'N' THEN '第 ' || l_linenumber || '–' || (l_linenumber + 1) || ' 页' ELSE coalesce(CASE WHEN l_quantity > 25 THEN 'part ' || l_partkey END, 'line-' || l_orderkey) END AS label FROM lineitem",
    ),
    "b15_query_language": (_lazy("documents", lambda: ["doc_id", T.query_language(_t()).alias("language")]), r"SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(text, '[A-Za-z]', '', 'g'), '\p{L}') THEN 'en' ELSE 'zh' END AS language FROM documents"),
    "c5_pdf_quality": (
        _lazy("documents", lambda: ["doc_id", F.coalesce(T.pdf_quality(_t()), F.lit("OK")).alias("verdict")]),
        r"""WITH s AS (SELECT doc_id, length(regexp_replace(text, '[\t\n\x0B\f\r\x1C-\x1F\x20]', '', 'g')) AS seen, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) AS meaning, length(regexp_replace(regexp_replace(text, '[\t\n\x0B\f\r\x1C-\x1F\x20]', '', 'g'), '[^\x{FFFD}\p{Cc}\p{Co}]', '', 'g')) AS noise FROM documents)
        SELECT doc_id, CASE WHEN seen >= 40 AND (noise > 0.02 * seen OR meaning < 0.3 * seen) THEN 'GIBBERISH_TEXT' WHEN meaning < 40 THEN 'LOW_QUALITY_TEXT' ELSE 'OK' END AS verdict FROM s""",
    ),
    "i7_memory_features": (_lazy("conversations", lambda: ["conv_id", "turn", F.array_join(F.array_sort(T.memory_features(_t())), " ").alias("features")]), r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(trim(text)), '[\p{L}\p{N}_]+'))), ' ') AS features FROM conversations"),
    "i8_citation_features": (_lazy("conversations", lambda: ["conv_id", "turn", F.array_join(F.array_sort(T.citation_features(_t())), " ").alias("features")]), r"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(left(text, 4096)), '[\p{L}\p{Nd}]+'), lambda x: 'w:' || x))), ' ') AS features FROM conversations"),
    "i13_compact_windows": (
        _lazy("part", lambda: ["p_partkey", F.array_join(F.array_sort(N.compact_windows(N.name_words(F.col("p_name")))), " ").alias("windows")]),
        r"""WITH w AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda x: length(x) <= 64)[1:8] AS w FROM part),
        x AS (SELECT DISTINCT p_partkey, array_to_string(w[i : j], '') AS v FROM w, range(1, 9) a(i), range(1, 9) b(j) WHERE i <= j AND j <= len(w) AND j < i + 8)
        SELECT w.p_partkey, coalesce(string_agg(v, ' ' ORDER BY v) FILTER (length(v) BETWEEN 3 AND 64), '') AS windows FROM w LEFT JOIN x USING (p_partkey) GROUP BY w.p_partkey""",
    ),
    "i18_pdf_heading_depth": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.pdf_heading_depth(F.col("line")).alias("depth")).groupBy("doc_id").agg(F.count_if(F.col("depth") > 0).alias("headings"), F.max("depth").alias("deepest")),
        r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        h AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN length(regexp_extract(line, '^(#{1,6})\s+.+$', 1)) WHEN regexp_matches(line, '^(\d+(?:\.\d+)*)(?:[、.)])?\s+.+$') THEN least(6, len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)(?:[、.)])?\s+.+$', 1), '.')))
          WHEN length(line) <= 80 AND length(regexp_replace(line, '[^\p{Latin}]', '', 'g')) >= 4 AND NOT regexp_matches(line, '[\p{Ll}ªº]') THEN 1 ELSE 0 END AS depth FROM l)
        SELECT doc_id, count(*) FILTER (depth > 0) AS headings, max(depth) AS deepest FROM h GROUP BY doc_id""",
    ),
    "i20_string_functions": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("second"), F.left("text", F.lit(12)).alias("head"), F.instr("text", "the").alias("at"), F.btrim(F.col("source"), F.lit("s")).alias("trimmed"), F.nullif("lang", F.lit("en")).alias("foreign"), F.coalesce(F.nullif("lang", F.lit("en")), F.lit("-")).alias("shown"), F.greatest("n_chars", F.lit(500)).alias("most")),
        "SELECT doc_id, split_part(text, ' ', 2) AS second, left(text, 12) AS head, instr(text, 'the') AS at, trim(source, 's') AS trimmed, nullif(lang, 'en') AS foreign, coalesce(nullif(lang, 'en'), '-') AS shown, greatest(n_chars, 500) AS most FROM documents",
    ),
    "i27_numeric_test": (
        lambda spark, d: read(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).groupBy("doc_id").agg(F.count_if(T.is_number(F.col("w"))).alias("numbers")),
        "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, count(*) FILTER (w <> '' AND try_cast(replace(w, ',', '') AS DOUBLE) IS NOT NULL) AS numbers FROM w GROUP BY doc_id",
    ),
    "i31_concise": (_lazy("documents", lambda: ["doc_id", T.concise(_t(), 80).alias("short")]), "SELECT doc_id, left(trim(text), 80) AS short FROM documents"),
    "d12_similar_names": (
        lambda spark, d: S.name_pairs(read(spark, d, "part").select(F.col("p_name").alias("name")), 0.6),
        "WITH n AS (SELECT DISTINCT p_name AS n FROM part), p AS (SELECT a.n AS a, b.n AS b, 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) AS s FROM n a JOIN n b ON a.n < b.n AND left(a.n, 1) = left(b.n, 1) AND abs(length(a.n) - length(b.n)) <= 3) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.6",
    ),
    "i11_near_words": (
        lambda spark, d: (lambda w: N.near_words(w.select(F.col("w").alias("a")), w.select(F.col("w").alias("b"))).filter("a < b"))(read(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")), " ")).alias("w"))),
        "WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) SELECT a.w AS a, b.w AS b, CAST(damerau_levenshtein(a.w, b.w) AS INTEGER) AS distance FROM w a JOIN w b ON a.w < b.w AND left(a.w, 1) = left(b.w, 1) AND damerau_levenshtein(a.w, b.w) <= 1",
    ),
    "i15_alias_matches": (lambda spark, d: N.match_aliases(_part_queries(spark, d), read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("alias")).distinct().select(F.xxhash64("alias").alias("alias_id"), "alias")), None),
    "l13_alias_scan": (_alias_scan, None),
    "d13_containment_join": (
        lambda spark, d: N.containment_join(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(", ", "p_name", "p_type").alias("text")), read(spark, d, "part").select(F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("alias"))).select(F.col("id").alias("p_partkey"), "alias"),
        """WITH a AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_type, ' ', 1)]) AS alias FROM part) SELECT p_partkey, alias FROM part JOIN a ON contains(' ' || regexp_replace(lower(p_name || ', ' || p_type), '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || lower(alias) || ' ')""",
    ),
}
