"""Blocks of a document packed into parents and cut into children, with the headings and blocks they come from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.operators.greedy import by_group
from lorespan.operators.parsing import child_windows, in_frames, markdown_blocks

PARENT_TOKENS, CHILD_TOKENS, OVERLAP = 1200, 300, 40
Block = tuple[int, str, tuple[str, ...], str]  # order, kind, heading path, text


def heading_paths(blocks: list[tuple[str, int, str]]) -> list[Block]:
    """(kind, depth, text) blocks with the headings above them: a heading ends those of its own depth and deeper."""
    stack: list[tuple[int, str]] = []
    out = []
    for order, (kind, depth, text) in enumerate(blocks):
        if kind == "HEADING":
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, text))
        out.append((order, kind, tuple(t for _, t in stack), text))
    return out


def split_block(text: str, most: int) -> list[str]:
    """K1: pieces of at most ``most`` visible characters, without white space at their ends."""
    visible = [i for i, c in enumerate(text) if not c.isspace()]
    return [text[visible[at] : visible[min(at + most, len(visible)) - 1] + 1] for at in range(0, len(visible), most)]


def pack(blocks: list[Block], parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS, overlap: int = OVERLAP, breaks: frozenset[int] = frozenset()) -> Iterator[tuple]:
    """K2, K3, K5, K6: (kind, parent, child, first block, last block, heading path, text, tokens) of all chunks of a document, each parent before its children.

    A parent ends before a heading, before a block of ``breaks``, and where the next piece would exceed it. A child has the first heading
    path that is not empty among the pieces it overlaps, else its parent's.
    """
    groups: list[list[tuple[int, tuple[str, ...], str]]] = []
    used, previous = 0, -1
    for order, kind, path, text in blocks:
        for piece in split_block(text, parent_tokens):
            tokens = sum(not c.isspace() for c in piece)
            forced = order != previous and order in breaks
            if not groups or kind == "HEADING" or forced or used + tokens > parent_tokens:
                groups.append([])
                used = 0
            groups[-1].append((order, path, piece))
            used, previous = used + tokens, order
    child = 0
    for number, group in enumerate(groups):
        places, at = [], 0
        for order, path, piece in group:
            places.append((at, at + len(piece), order, path))
            at += len(piece) + 2
        text = "\n\n".join(p for _, _, p in group)
        own = next((p for *_, p in places if p), ())
        yield "PARENT", number, None, group[0][0], group[-1][0], own, text, sum(not c.isspace() for c in text)
        for a, b in child_windows(text, child_tokens, overlap):
            met = [p for p in places if max(a, p[0]) < min(b, p[1])]
            part = text[a:b]
            yield "CHILD", number, child, min(m[2] for m in met), max(m[2] for m in met), next((m[3] for m in met if m[3]), own), part, sum(not c.isspace() for c in part)
            child += 1


_CHUNK = "kind string, parent int, child int, first_block int, last_block int, heading string, text string, tokens int"


def _rows(key, blocks: list[Block], sizes: tuple[int, int, int]) -> list[tuple]:
    return [(key, k, p, c, f, t, "\n".join(path), text, n) for k, p, c, f, t, path, text, n in pack(blocks, *sizes)]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut=markdown_blocks, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Parse, pack and cut every text where it lies, without a shuffle: (id, kind, parent, child, first_block, last_block, heading, text, tokens).

    ``cut`` makes (kind, depth, text) blocks of a text. Null and blank texts have no chunks.
    """
    names = ["id", *[f.split()[0] for f in _CHUNK.split(", ")]]
    sizes = (parent_tokens, child_tokens, overlap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for i, t in zip(f["id"].tolist(), f["text"].tolist(), strict=True) if t for r in _rows(i, heading_paths(cut(t)), sizes))
        for made in in_frames(rows, names):
            yield made.astype({"child": "Int32"})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, {_CHUNK}")


def chunk_blocks(blocks: DataFrame, parent_tokens: int = PARENT_TOKENS, child_tokens: int = CHILD_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The same for blocks that are rows already: (doc_id long, block int, kind, heading with a line a level, text)."""
    sizes = (parent_tokens, child_tokens, overlap)

    def choose(group: list[tuple]) -> list[tuple]:
        return _rows(group[0][0], [(b, k, tuple(x for x in (h or "").split("\n") if x.strip()), t or "") for _, b, k, h, t in group], sizes)

    return by_group(blocks, "doc_id", ["block"], ["doc_id", "block", "kind", "heading", "text"], choose, f"doc_id long, {_CHUNK}")


def apply_merges(cells: DataFrame, merges: DataFrame, hidden: DataFrame) -> DataFrame:
    """K9: cells (sheet, row, col, text) with row_span, col_span and covered: of each merged area the first cell that shows takes the span, the others are covered.

    ``merges``: (sheet, top, bottom, left, right), areas of a sheet don't overlap; ``hidden``: (sheet, row) of rows that don't show. The first cell
    is made if it is missing. Areas meet cells by sheet and row.
    """
    rows = merges.withColumn("area", F.monotonically_increasing_id()).withColumn("row", F.explode(F.sequence("top", "bottom"))).join(hidden.select("sheet", "row").distinct(), ["sheet", "row"], "left_anti")
    shown = rows.groupBy("sheet", "area", "left", "right").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tops = shown.select("sheet", F.col("first").alias("row"), F.col("left").alias("col"), F.col("rows").alias("row_span"), (F.col("right") - F.col("left") + 1).alias("col_span"))
    inside = cells.join(rows.select("sheet", "row", "left", "right"), ["sheet", "row"], "left").withColumn("in", F.col("col").between(F.col("left"), F.col("right")))
    marked = inside.groupBy("sheet", "row", "col").agg(F.first("text").alias("text"), F.coalesce(F.bool_or("in"), F.lit(False)).alias("in"))
    joined = marked.join(tops, ["sheet", "row", "col"], "full")
    first = F.col("row_span").isNotNull()
    return joined.select("sheet", "row", "col", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("row_span", F.lit(1)).cast("long").alias("row_span"), F.coalesce("col_span", F.lit(1)).cast("long").alias("col_span"), (F.coalesce("in", F.lit(False)) & ~first).alias("covered"))


def expand_context(hits: DataFrame, chunks: DataFrame, parents: DataFrame, around: int = 1) -> DataFrame:
    """Each hit (doc_id, chunk) with its parent's text and the neighbours up to ``around`` places away, in order, joined by blank lines.

    ``chunks``: (doc_id, chunk, parent, text); ``parents``: (doc_id, parent, parent_text). Hits come authorised.
    """
    wanted = hits.select("doc_id", F.col("chunk").alias("hit"), F.explode(F.sequence(F.col("chunk") - around, F.col("chunk") + around)).alias("chunk"))
    near = wanted.join(chunks.select("doc_id", "chunk", "text"), ["doc_id", "chunk"]).groupBy("doc_id", "hit").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"))
    joined = near.select("doc_id", F.col("hit").alias("chunk"), F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("context"), F.size("c").alias("pieces"))
    return joined.join(chunks.select("doc_id", "chunk", "parent"), ["doc_id", "chunk"]).join(parents, ["doc_id", "parent"], "left")


def broken_spans(spans: DataFrame, units: DataFrame) -> DataFrame:
    """K7: spans (doc_id, span, first, last, digest) whose text, code points [first, last) of the unit (doc_id, text), has another SHA-256, or that leave it."""
    text = F.col("text").substr(F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int"))
    sound = F.col("text").isNotNull() & (F.col("first") >= 0) & (F.col("first") < F.col("last")) & (F.col("last") <= F.length("text")) & (F.sha2(text, 256) == F.col("digest"))
    return spans.join(units.select("doc_id", "text"), "doc_id", "left").filter(~F.coalesce(sound, F.lit(False))).drop("text")


def render_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown) of blocks (doc_id, block, kind, depth, text): headings with their marks, blocks parted by blank lines, a line end at last."""
    marked = F.when(F.col("kind") == "HEADING", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("depth")))), F.lit(" "), "text")).otherwise(F.col("text"))
    return blocks.select("doc_id", F.struct("block", marked.alias("t")).alias("b")).groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))


def table_markdown(rows: Column, columns: Column) -> Column:
    """An array of rows of cells as a pipe table: bars escaped, line ends as blanks, a rule behind the first row; empty without rows."""

    def line(row: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), columns - 1), lambda i: F.concat(F.lit(" "), F.replace(F.replace(F.coalesce(F.get(row, i), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(" |")))
        return F.concat(F.lit("|"), F.array_join(cells, ""))

    rule = F.concat(F.lit("| "), F.repeat(F.lit("--- | "), columns))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def table_html(cells: DataFrame) -> DataFrame:
    """(table_id, html) of cells (table_id, row, col, text, header, row_span, col_span)."""
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    tag = F.when(F.col("header"), F.lit("th")).otherwise(F.lit("td"))
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    cell = F.concat(F.lit("<"), tag, span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), escaped, F.lit("</"), tag, F.lit(">"))
    lines = cells.select("table_id", "row", F.struct("col", cell.alias("t")).alias("c")).groupBy("table_id", "row").agg(F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["t"]), ""), F.lit("</tr>")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("table_id").agg(F.concat(F.lit("<table><tbody>"), body, F.lit("</tbody></table>")).alias("html"))


def column_name(index: Column) -> Column:
    """Letters of a column from 0: A to Z, AA and on, up to three letters."""
    letter = lambda n: F.chr(F.lit(65) + n)
    two, three = index - 26, index - 702
    return (
        F.when(index < 26, letter(index))
        .when(index < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def cell_range(sheet: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """An address such as Sheet!A1:C3, rows and columns from 0; names of other than letters, digits and underscores in quotes."""
    name = F.when(sheet.rlike(r"^[\p{L}\p{N}_]+$"), sheet).otherwise(F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'")))
    return F.concat(name, F.lit("!"), column_name(left), (top + 1).cast("string"), F.lit(":"), column_name(right), (bottom + 1).cast("string"))


def looks_like_header(row: Column, numeric) -> Column:
    """Cells that are not blank are all different, in any case, and half of them or more are text."""
    shown = F.filter(F.transform(row, lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))), lambda c: c != "")
    text = F.size(F.filter(shown, lambda c: ~numeric(c)))
    return (F.size(shown) > 0) & (F.size(F.array_distinct(shown)) == F.size(shown)) & (2 * text >= F.size(shown))


def header_rows(rows: Column, numeric) -> Column:
    """How many of the first rows (arrays of cells) are headings: none, one, or two if the third isn't one."""
    first, second, third = (looks_like_header(F.get(rows, F.lit(i)), numeric) for i in range(3))
    return F.when((F.size(rows) < 2) | ~first, 0).when((F.size(rows) >= 3) & second & ~third, 2).otherwise(1)
