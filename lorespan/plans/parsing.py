"""Queries of parsing, chunking and streaming, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import parsing as P
from lorespan.sources.tables import read
from lorespan.streaming import sync

QUERIES = {
    "a4_text_blocks": (
        lambda s, d: P.text_blocks(read(s, d, "documents")).select("doc_id", "kind", "first_line", "last_line", F.md5("text").alias("digest")),
        r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        k AS (SELECT *, CASE WHEN trim(t) = '' THEN 'BLANK' WHEN (regexp_matches(trim(t), '^(\d+(\.\d+)*)\.?\s+\S') AND length(trim(t)) <= 120) OR regexp_matches(trim(t), '^第[0-9一二三四五六七八九十百]+[章节]') OR (length(trim(t)) <= 60 AND regexp_matches(trim(t), '[A-Z]') AND NOT regexp_matches(trim(t), '[a-z\p{Ll}]') AND regexp_matches(trim(t), '^[A-Z0-9 ,:&-]+$')) THEN 'HEADING' WHEN regexp_matches(t, '^\s*([-*•]|\d+[.)])\s+\S') THEN 'LIST' ELSE 'PARAGRAPH' END AS kind FROM l),
        b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM k),
        n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> kind OR kind = 'HEADING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM b)
        SELECT doc_id, kind, min(line) AS first_line, max(line) AS last_line, md5(string_agg(t, chr(10) ORDER BY line)) AS digest FROM n WHERE kind <> 'BLANK' GROUP BY doc_id, block, kind""",
    ),
    "a5_markdown_blocks": (lambda s, d: P.parse_markdown(read(s, d, "documents")), None),
    "a6_html_blocks": (lambda s, d: P.parse_html(read(s, d, "pages")), None),
    "a11_page_blocks": (
        lambda s, d: P.page_blocks(read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("page", "text"))).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "HEADING").alias("headings"), F.max("depth").alias("deepest")),
        r"""WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS t, generate_subscripts(string_split(text, '. '), 1) - 1 AS page FROM documents), l AS (SELECT doc_id, page, trim(regexp_replace(unnest(string_split(t, chr(10))), '[ \t\f\v]+', ' ', 'g')) AS line FROM p),
        h AS (SELECT doc_id, page, CASE WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN length(regexp_extract(line, '^(#{1,6})\s+.+$', 1)) WHEN regexp_matches(line, '^(\d+(?:\.\d+)*)(?:[、.)])?\s+.+$') THEN least(6, len(string_split(regexp_extract(line, '^(\d+(?:\.\d+)*)(?:[、.)])?\s+.+$', 1), '.')))
          WHEN length(line) <= 80 AND length(regexp_replace(line, '[^\p{Latin}]', '', 'g')) >= 4 AND NOT regexp_matches(line, '[\p{Ll}ªº]') THEN 1 ELSE 0 END AS depth FROM l WHERE line <> '')
        SELECT doc_id, page, count(*) AS lines, count(*) FILTER (depth > 0) AS headings, max(depth) AS deepest FROM h GROUP BY ALL""",
    ),
    "a13_html_tables": (lambda s, d: P.parse_html_tables(read(s, d, "pages")), None),
    "k3_child_windows": (lambda s, d: P.chunk_children(read(s, d, "documents")), None),
    "k8_row_windows": (
        lambda s, d: P.row_windows(read(s, d, "orders"), "o_custkey", "o_orderkey"),
        "WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT o_custkey, CAST(floor((r - 1) / 20) AS BIGINT) AS block, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM n GROUP BY ALL",
    ),
    "stream_event_windows": (
        lambda s, d: sync.drain(sync.event_windows(sync.stream(s, d, "events"), "1 hour"), "windows", "complete"),
        "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
    "r9_stream_first_events": (lambda s, d: sync.drain(sync.first_events(sync.stream(s, d, "events"), ["event_id"]), "first").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY ALL"),
}
