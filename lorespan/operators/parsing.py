"""From files' texts to blocks and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.functions.text import heading_depth, nfkc, pdf_heading_depth

#: Rows and characters of a frame that a task gives back.
FRAME_ROWS, FRAME_CHARS = 2_000, 2_000_000
_LIST = r"^\s*([-*•]|\d+[.)])\s+\S"


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of a plain text: (doc_id, block, kind, first_line, last_line, text).

    Headings stand alone, runs of list items and of other lines are one block each, blank lines part blocks.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line", "t"))
    kind = F.when(F.trim("t") == "", "BLANK").when(heading_depth(F.trim("t")).isNotNull(), "HEADING").when(F.col("t").rlike(_LIST), "LIST").otherwise("PARAGRAPH")
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    opens = F.col("before").isNull() | (F.col("before") != F.col("kind")) | (F.col("kind") == "HEADING")
    lines = lines.withColumn("block", F.sum(F.when(opens, 1).otherwise(0)).over(w)).filter("kind <> 'BLANK'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return lines.groupBy("doc_id", "block", "kind").agg((F.min("line") + 1).alias("first_line"), (F.max("line") + 1).alias("last_line"), text.alias("text"))


def markdown_blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """A5: (kind, depth, text) of headings, fenced code, tables, lists and paragraphs."""
    held: list[str] = []
    kind, fence = "", ""

    def close() -> Iterator[tuple[str, int, str]]:
        if held:
            yield kind, 0, "\n".join(held)
            held.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            if mark and mark[1].startswith(fence):
                yield from close()
                fence = ""
            else:
                held.append(line)
            continue
        if mark:
            yield from close()
            kind, fence = "CODE", mark[1]
            continue
        head = re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        now = "HEADING" if head else "BLANK" if not line.strip() else "TABLE" if "|" in line.strip()[1:] or line.startswith("|") else "LIST" if re.match(_LIST, line) else "PARAGRAPH"
        if now != kind or head:
            yield from close()
        kind = now
        if head:
            yield "HEADING", len(head[1]), head[2]
        elif now != "BLANK":
            held.append(line)
    yield from close()


class _Html(HTMLParser):
    """Collects the texts of block elements with their paths; scripts, styles, forms and frames are left out."""

    SKIP = frozenset(("script", "style", "form", "head", "iframe"))
    BLOCK = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "td", "th", "blockquote"))
    VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "source", "wbr"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str]] = []
        self.path: list[tuple[str, int]] = []
        self.seen: list[dict[str, int]] = [{}]
        self.held: list[str] = []
        self.external = 0

    def handle_starttag(self, tag, attrs):
        self.external += sum(k in ("href", "src") and (v or "").strip().lower().startswith(("http:", "https:", "//")) for k, v in attrs)
        if tag in self.VOID:
            return
        self.seen[-1][tag] = self.seen[-1].get(tag, 0) + 1
        if tag in self.BLOCK:
            self.flush()
        self.path.append((tag, self.seen[-1][tag]))
        self.seen.append({})

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.path]:
            return
        while self.path:
            if self.path[-1][0] in self.BLOCK:
                self.flush()
            self.seen.pop()
            if self.path.pop()[0] == tag:
                break

    def handle_data(self, data):
        tags = [t for t, _ in self.path]
        if not self.SKIP.intersection(tags) and self.BLOCK.intersection(tags):
            self.held.append(data)

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            last = max(i for i, (t, _) in enumerate(self.path) if t in self.BLOCK)
            self.blocks.append((self.path[last][0], "".join(f"/{t}[{n}]" for t, n in self.path[: last + 1]), text))


def html_blocks(html: str) -> list[tuple[str, str, str]]:
    """(tag, path, text) of each block with text, in order."""
    parser = _Html()
    parser.feed(html)
    parser.flush()
    return parser.blocks


def external_references(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, external, blocks): addresses of other hosts that the safe scan leaves out of each page, and its blocks of text; none for null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for i, html in zip(f["id"].tolist(), f["text"].tolist(), strict=True):
                parser = _Html()
                parser.feed(html or "")
                parser.flush()
                made.append((i, parser.external, len(parser.blocks)))
            yield pd.DataFrame(made, columns=["id", "external", "blocks"])

    return pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {pages.schema[id_col].dataType.simpleString()}, external int, blocks int")


def table_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, rowspan, colspan) placed on a grid; a spanned place repeats no text."""
    grid: dict[tuple[int, int], str] = {}
    for r, cells in enumerate(rows):
        c = 0
        for text, down, across in cells:
            while (r, c) in grid:
                c += 1
            for i in range(max(1, down)):
                for j in range(max(1, across)):
                    grid.setdefault((r + i, c + j), text if i == j == 0 else "")
            c += max(1, across)
    height, width = (max((k[i] for k in grid), default=-1) + 1 for i in (0, 1))
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


class _Tables(HTMLParser):
    """Rows of cells (text, rowspan, colspan) of the tables of a page; a table inside a cell is its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._end()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._end()
            spans = dict(attrs)
            size = lambda k: int(spans[k]) if (spans.get(k) or "").isdigit() and 0 < int(spans[k]) <= 1000 else 1
            self.cell = ["", size("rowspan"), size("colspan")]

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            if self.depth == 1:
                self._end()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._end()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data

    def _end(self):
        if self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append((" ".join(self.cell[0].split()), self.cell[1], self.cell[2]))
            self.cell = None


def html_tables(html: str) -> list[list[list[str]]]:
    """The tables of a page as grids."""
    parser = _Tables()
    parser.feed(html)
    parser._end() if parser.tables else None
    return [table_grid(t) for t in parser.tables]


def parse_html_tables(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, block, row, cells) of every table row of every page, spans placed."""
    return _blocks(pages, id_col, text_col, lambda t: [(n, r, cells) for n, grid in enumerate(html_tables(t)) for r, cells in enumerate(grid)], ("table", "row", "cells"), "table int, row int, cells array<string>")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, kind, depth, text) of the lines of pages (doc_id, page, text), as a reader of PDF files gives them; texts in compatibility form."""
    text = nfkc(F.coalesce(F.col("text"), F.lit("")))
    lines = pages.select("doc_id", "page", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    depth = pdf_heading_depth(F.col("text"))
    return lines.select("doc_id", "page", "line", F.when(depth > 0, "HEADING").otherwise("PARAGRAPH").alias("kind"), depth.cast("int").alias("depth"), "text")


def in_frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of FRAME_ROWS at most, or about FRAME_CHARS characters, so that a task holds what few texts give and not what a batch of them gives."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= FRAME_ROWS or size >= FRAME_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _blocks(frame: DataFrame, id_col: str, text_col: str, cut, names: tuple[str, ...], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((i, n, *b) for f in frames for i, t in zip(f["id"].tolist(), f["text"].tolist(), strict=True) if t for n, b in enumerate(cut(t)))
        return in_frames(rows, ["id", "block", *names])

    return frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {frame.schema[id_col].dataType.simpleString()}, block int, {schema}")


def parse_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _blocks(docs, id_col, text_col, markdown_blocks, ("kind", "depth", "text"), "kind string, depth int, text string")


def parse_html(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    return _blocks(pages, id_col, text_col, html_blocks, ("tag", "path", "text"), "tag string, path string, text string")


def child_windows(text: str, size: int = 300, overlap: int = 40) -> Iterator[tuple[int, int]]:
    """K3: (start, end) of windows of at most ``size`` visible characters, each starting ``overlap`` visible ones before the last end."""
    visible = [i for i, c in enumerate(text) if not c.isspace()]
    at = 0
    while at < len(visible):
        last = min(at + size, len(visible))
        yield visible[at], visible[last - 1] + 1
        if last == len(visible):
            return
        at = max(last - overlap, at + 1)


def chunk_children(parents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 300, overlap: int = 40) -> DataFrame:
    """K3: windows of every text: (id, block, first, last, text)."""
    return _blocks(parents, id_col, text_col, lambda t: [(a, b, t[a:b]) for a, b in child_windows(t, size, overlap)], ("first", "last", "text"), "first int, last int, text string")


def row_windows(rows: DataFrame, group: str, order: str, header: DataFrame | None = None, size: int = 20) -> DataFrame:
    """K8: data rows of a table in blocks of ``size``, with the rows' range."""
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return numbered.withColumn("block", F.floor((F.col("row") - 1) / size)).groupBy(group, "block").agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))
