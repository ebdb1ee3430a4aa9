"""Queries of chunking, tables and their rendering, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.functions.text import is_number
from lorespan.operators import chunking as K
from lorespan.operators import seal
from lorespan.sources.tables import read

_c = F.col


def _cells(s, d):
    """Order lines as cells: a sheet a supplier, rows by order, columns by line number."""
    return read(s, d, "lineitem").groupBy(_c("l_suppkey").alias("sheet"), (_c("l_orderkey") % 50).cast("int").alias("row"), _c("l_linenumber").cast("int").alias("col")).agg(F.max("l_returnflag").alias("text"))


def _merges(s, d):
    return read(s, d, "supplier").select(_c("s_suppkey").alias("sheet"), F.lit(10).alias("top"), (10 + _c("s_nationkey")).cast("int").alias("bottom"), F.lit(2).alias("left"), F.lit(4).alias("right"))


def _hidden(s, d):
    return read(s, d, "supplier").select(_c("s_suppkey").alias("sheet"), F.explode(F.array(F.lit(10), F.lit(13))).alias("row"))


def k9_merges(s, d):
    return K.apply_merges(_cells(s, d), _merges(s, d), _hidden(s, d))


def _chunks(s, d):
    docs = read(s, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 300))).alias("chunk"))
    return docs.select("doc_id", "chunk", F.floor(_c("chunk") / 4).alias("parent"), _c("text").substr((_c("chunk") * 300 + 1).cast("int"), F.lit(300)).alias("text"))


def k10_context(s, d):
    """Every seventh chunk is a hit."""
    chunks = _chunks(s, d)
    docs = read(s, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 1200))).alias("parent"))
    parents = docs.select("doc_id", "parent", F.md5(_c("text").substr((_c("parent") * 1200 + 1).cast("int"), F.lit(1200))).alias("parent_text"))
    hits = chunks.filter((_c("doc_id") + _c("chunk")) % 7 == 0).select("doc_id", "chunk")
    return K.expand_context(hits, chunks, parents).select("doc_id", "chunk", F.md5("context").alias("context"), _c("pieces").cast("long").alias("pieces"), "parent", _c("parent_text").alias("parent_digest"))


def k7_broken_spans(s, d):
    """Digests of slices of 500; those of other languages than en were made of upper-case text."""
    docs = read(s, d, "documents").select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500))).alias("span"))
    first, last = _c("span") * 500, F.least((_c("span") + 1) * 500, F.length("text"))
    cut = _c("text").substr((first + 1).cast("int"), F.lit(500))
    spans = docs.select("doc_id", "span", first.alias("first"), last.alias("last"), F.sha2(F.when(_c("lang") == "en", cut).otherwise(F.upper(cut)), 256).alias("digest"))
    return K.broken_spans(spans, read(s, d, "documents")).select("doc_id", "span", "first", "last")


def _lines(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text")).withColumn("kind", F.when(_c("block") % 3 == 0, "HEADING").otherwise("PARAGRAPH")).withColumn("depth", (_c("block") % 8).cast("int"))


def b17_markdown_tables(s, d):
    """Each order's lines as a table, with a header and cells of two columns or three."""
    rows = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("a|b"), F.lit("c\nd"))), F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["l_returnflag"])))
    return rows.select("l_orderkey", F.md5(K.table_markdown(cells, F.lit(3))).alias("digest"))


def b18_html_tables(s, d):
    lines = read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    cells = lines.select(_c("l_orderkey").alias("table_id"), _c("l_linenumber").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), _c("l_returnflag").alias("text")), F.struct(F.lit(1).alias("col"), F.lit('<&">').alias("text")))).alias("x"))
    cells = cells.select("table_id", "row", "x.*", (_c("row") == 1).alias("header"), (_c("row") % 3).alias("row_span"), (_c("x.col") + 1).alias("col_span"))
    return K.table_html(cells).select("table_id", F.md5("html").alias("digest"))


def b19_cell_ranges(s, d):
    part = read(s, d, "part")
    return part.select("p_partkey", K.cell_range(F.when(_c("p_size") % 2 == 0, F.regexp_replace("p_name", " ", "_")).otherwise(F.concat("p_name", F.lit("'s"))), _c("p_size"), _c("p_partkey") % 1000, _c("p_size") + 3, _c("p_partkey") % 1000 + 40).alias("address"))


def i30_header_rows(s, d):
    """The lines of each text as rows of words."""
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return read(s, d, "documents").select("doc_id", K.header_rows(rows, is_number).cast("int").alias("headers"))


_COLUMN = "CASE WHEN {0} < 26 THEN chr(65 + {0}) WHEN {0} < 702 THEN chr(65 + ({0} - 26) // 26) || chr(65 + ({0} - 26) % 26) ELSE chr(65 + ({0} - 702) // 676) || chr(65 + ({0} - 702) // 26 % 26) || chr(65 + ({0} - 702) % 26) END"
_LEFT, _RIGHT = (_COLUMN.format(x) for x in ("CAST(p_partkey % 1000 AS INT)", "CAST(p_partkey % 1000 + 40 AS INT)"))
_HEADER = "(len(r{0}) > 0 AND len(list_distinct(r{0})) = len(r{0}) AND 2 * len(list_filter(r{0}, lambda c: try_cast(replace(c, ',', '') AS DOUBLE) IS NULL)) >= len(r{0}))"
_ROW = "list_filter(list_transform(string_split(l[{0}], ' '), lambda c: lower(trim(c))), lambda c: c <> '') AS r{0}"

def k7_seals(s, d):
    """Orders are packages of a head and lines."""
    lines = read(s, d, "lineitem").select(_c("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_returnflag")
    heads = read(s, d, "orders").select(_c("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus")
    return seal.sealed([(heads, []), (lines, ["l_linenumber", "l_partkey"])])


QUERIES = {
    "k7_seals": (
        k7_seals,
        """WITH h AS (SELECT o_orderkey AS k, string_agg(strlen(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey || strlen(o_orderstatus) || ':' || o_orderstatus || ';', '') || '#' || count(*) || ';' AS t FROM orders GROUP BY 1),
        l AS (SELECT l_orderkey AS k, string_agg(strlen(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber || strlen(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey || strlen(l_returnflag) || ':' || l_returnflag || ';', '' ORDER BY l_linenumber, l_partkey, l_returnflag) || '#' || count(*) || ';' AS t FROM lineitem GROUP BY 1)
        SELECT coalesce(h.k, l.k) AS doc_id, sha256(coalesce(h.t, '#0;') || coalesce(l.t, '#0;')) AS digest FROM h FULL JOIN l ON h.k = l.k""",
    ),
    "k2_chunks": (lambda s, d: K.chunk_documents(read(s, d, "documents")), None),
    "k2_chunk_blocks": (lambda s, d: K.chunk_blocks(_lines(s, d).select("doc_id", "block", "kind", F.lit("").alias("heading"), "text")), None),
    "k7_broken_spans": (
        k7_broken_spans,
        """WITH s AS (SELECT doc_id, lang, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS span FROM documents)
        SELECT doc_id, span, span * 500 AS first, least((span + 1) * 500, length(text)) AS last FROM s WHERE lang <> 'en' AND upper(substr(text, CAST(span * 500 + 1 AS INT), 500)) <> substr(text, CAST(span * 500 + 1 AS INT), 500)""",
    ),
    "k9_merges": (
        k9_merges,
        """WITH cells AS (SELECT l_suppkey AS sheet, l_orderkey % 50 AS row, l_linenumber AS col, max(l_returnflag) AS text FROM lineitem GROUP BY ALL),
        m AS (SELECT s_suppkey AS sheet, 10 AS top, 10 + s_nationkey AS bottom FROM supplier), r AS (SELECT sheet, unnest(range(top, bottom + 1)) AS row FROM m), v AS (SELECT * FROM r WHERE row NOT IN (10, 13)),
        t AS (SELECT sheet, min(row) AS row, count(*) AS n FROM v GROUP BY sheet)
        SELECT coalesce(c.sheet, t.sheet) AS sheet, coalesce(c.row, t.row) AS row, coalesce(c.col, 2) AS col, coalesce(c.text, '') AS text, coalesce(t.n, 1) AS row_span, CASE WHEN t.n IS NULL THEN 1 ELSE 3 END AS col_span,
        coalesce(v.row IS NOT NULL AND c.col BETWEEN 2 AND 4 AND t.n IS NULL, false) AS covered FROM cells c FULL JOIN t ON c.sheet = t.sheet AND c.row = t.row AND c.col = 2 LEFT JOIN v ON v.sheet = c.sheet AND v.row = c.row""",
    ),
    "k10_context": (
        k10_context,
        """WITH c AS (SELECT doc_id, chunk, chunk // 4 AS parent, substr(text, CAST(chunk * 300 + 1 AS INT), 300) AS text, text AS whole FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 300 + 1)) AS chunk FROM documents)),
        h AS (SELECT doc_id, chunk, parent, whole FROM c WHERE (doc_id + chunk) % 7 = 0)
        SELECT h.doc_id, h.chunk, md5(string_agg(c.text, chr(10) || chr(10) ORDER BY c.chunk)) AS context, count(*) AS pieces, h.parent, md5(substr(any_value(h.whole), CAST(h.parent * 1200 + 1 AS INT), 1200)) AS parent_digest FROM h JOIN c ON c.doc_id = h.doc_id AND c.chunk BETWEEN h.chunk - 1 AND h.chunk + 1 GROUP BY h.doc_id, h.chunk, h.parent""",
    ),
    "b16_markdown": (
        lambda s, d: K.render_markdown(_lines(s, d)).select("doc_id", F.md5("markdown").alias("digest")),
        "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS b FROM documents) SELECT doc_id, md5(string_agg(CASE WHEN b % 3 = 0 THEN repeat('#', CAST(greatest(1, least(6, b % 8)) AS INT)) || ' ' || t ELSE t END, chr(10) || chr(10) ORDER BY b) || chr(10)) AS digest FROM l GROUP BY doc_id",
    ),
    "b17_markdown_tables": (
        b17_markdown_tables,
        r"SELECT l_orderkey, md5('| a\|b | c d |  |' || chr(10) || '| --- | --- | --- | ' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag)) AS digest FROM lineitem GROUP BY l_orderkey",
    ),
    "b18_html_tables": (
        b18_html_tables,
        """WITH c AS (SELECT l_orderkey, l_linenumber, '<' || CASE WHEN l_linenumber = 1 THEN 'th' ELSE 'td' END || CASE WHEN l_linenumber % 3 > 1 THEN ' rowspan="' || (l_linenumber % 3) || '"' ELSE '' END AS o, CASE WHEN l_linenumber = 1 THEN 'th' ELSE 'td' END AS t, max(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)
        SELECT l_orderkey AS table_id, md5('<table><tbody>' || string_agg('<tr>' || o || '>' || f || '</' || t || '>' || o || ' colspan="2">&lt;&amp;&quot;&gt;</' || t || '></tr>', '' ORDER BY l_linenumber) || '</tbody></table>') AS digest FROM c GROUP BY l_orderkey""",
    ),
    "b19_cell_ranges": (b19_cell_ranges, f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE '''' || replace(p_name || '''s', '''', '''''') || '''' END || '!' || {_LEFT} || (p_size + 1) || ':' || {_RIGHT} || (p_size + 4) AS address FROM part"),
    "i30_header_rows": (
        i30_header_rows,
        f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, {_ROW.format(1)}, {_ROW.format(2)}, {_ROW.format(3)} FROM l)
        SELECT doc_id, CASE WHEN len(l) < 2 OR NOT {_HEADER.format(1)} THEN 0 WHEN len(l) >= 3 AND {_HEADER.format(2)} AND NOT {_HEADER.format(3)} THEN 2 ELSE 1 END AS headers FROM r""",
    ),
}
