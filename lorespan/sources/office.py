"""Office packages and delimited files as rows: small parsers of one file each, run where Spark reads the file."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lorespan.sources.sheets import Cell, cell_name, numbered_parts, sheet_cells

# Limits of a package.
MOST_ENTRIES, ENTRY_BYTES, PACKAGE_BYTES, LEAST_RATIO = 10_000, 32 << 20, 128 << 20, 0.01
SHAPES, TABLE_CELLS = 20_000, 100_000
DELIMITERS = ",\t;|"
#: Nesting of tables and of groups that is read, and rows that leave a task at once.
DEEPEST_TABLE, DEEPEST_GROUP, ROWS_AT_ONCE = 16, 32, 1000
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp"}


def inspect_package(data: bytes) -> str:
    """A2: why a package is refused, or ''. Sizes are those the directory states; nothing is unpacked but relations."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return "NOT_A_PACKAGE"
    entries = package.infolist()
    if len(entries) > MOST_ENTRIES:
        return "TOO_MANY_ENTRIES"
    if any(e.file_size > ENTRY_BYTES for e in entries) or sum(e.file_size for e in entries) > PACKAGE_BYTES:
        return "TOO_LARGE"
    if any(e.file_size and e.compress_size / e.file_size < LEAST_RATIO for e in entries):
        return "RATIO"
    for e in entries:
        if e.filename.endswith(".rels") and b'TargetMode="External"' in package.read(e):
            return "EXTERNAL_RELATION"
    return ""


class Block(NamedTuple):
    """A piece of a document: box is (left, top, right, bottom) in thousandths of its page, asset the bytes of a picture."""

    place: str
    kind: str
    text: str
    box: list[int] | None = None
    media: str | None = None
    asset: bytes | None = None


class Limit(ValueError):
    """A document has more parts of a kind than are read."""


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _get(element: ElementTree.Element, key: str) -> str | None:
    """An attribute of that local name."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == key), None)


def _find(element: ElementTree.Element, *path: str) -> ElementTree.Element | None:
    """The first child of the first name, of that the first child of the second, and so on."""
    for name in path:
        element = next((x for x in element if _name(x) == name), None)
        if element is None:
            return None
    return element


def _text(element: ElementTree.Element, without: tuple[str, ...] = ("del", "tbl", "Fallback")) -> str:
    """Characters shown below an element; text marked as deleted and tables inside it are left out."""
    out, todo = [], [element]
    while todo:
        x = todo.pop()
        name = _name(x)
        if x is not element and name in without:
            continue
        out.append(x.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
        todo += reversed(x)
    return "".join(out)


def _related(package: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationships of a part: id -> (kind, path of the other part)."""
    folder, _, name = part.rpartition("/")
    path = f"{folder}/_rels/{name}.rels".lstrip("/")
    if path not in package.namelist():
        return {}
    found = {}
    for x in ElementTree.fromstring(package.read(path)):
        target = x.get("Target", "")
        found[x.get("Id", "")] = (x.get("Type", "").rpartition("/")[2], posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target)))
    return found


def _pictures(package: zipfile.ZipFile, element: ElementTree.Element, related: dict, place: str, box: list[int] | None = None, without: tuple[str, ...] = ("del", "tbl", "Fallback")) -> Iterator[Block]:
    """Pictures below an element that the package holds, with their descriptions."""
    said, todo, number = "", [element], 0
    while todo:
        x = todo.pop()
        if x is not element and _name(x) in without:
            continue
        if _name(x) in ("docPr", "cNvPr"):
            said = _get(x, "descr") or ""
        path = related.get(_get(x, "embed") or "", ("", ""))[1] if _name(x) == "blip" else ""
        if path in package.NameToInfo:
            number += 1
            suffix = path.rpartition(".")[2].lower()
            yield Block(f"{place}/image:{number}", "IMAGE", said, box, MEDIA.get(suffix, "application/octet-stream"), package.read(path))
        todo += reversed(x)


class _Count:
    """Counts parts of a document up to a limit."""

    def __init__(self, most: int, what: str):
        self.n, self.most, self.what = 0, most, what

    def __call__(self) -> None:
        self.n += 1
        if self.n > self.most:
            raise Limit(self.what)


def _table_rows(package: zipfile.ZipFile, table: ElementTree.Element, related: dict, place: str, cells: _Count, depth: int = 0) -> Iterator[Block]:
    """Rows of a table, then, row by row, the pictures and the tables inside its cells."""
    if depth > DEEPEST_TABLE:
        raise Limit("TABLE_DEPTH")
    for r, row in enumerate((y for y in table if _name(y) == "tr"), 1):
        inside = [c for c in row if _name(c) == "tc"]
        for _ in inside:
            cells()
        yield Block(f"{place}/row:{r}", "TABLE", " | ".join("\n".join(t for p in c if _name(p) in ("p", "txBody", "sdt") and (t := _text(p))) for c in inside))
        for k, cell in enumerate(inside, 1):
            at = f"{place}/row:{r}/cell:{k}"
            yield from _pictures(package, cell, related, at)
            for n, own in enumerate((t for t in cell if _name(t) == "tbl"), 1):
                yield from _table_rows(package, own, related, f"{at}/table:{n}", cells, depth + 1)


def docx_blocks(package: zipfile.ZipFile) -> Iterator[Block]:
    """Paragraphs, list items, headings, table rows with tables inside cells, pictures, then footnotes, in order."""
    cells = _Count(TABLE_CELLS, "TABLE_CELL_LIMIT")
    part = "word/document.xml"
    related = _related(package, part)
    for i, x in enumerate(ElementTree.fromstring(package.read(part))[0], 1):
        if _name(x) == "tbl":
            yield from _table_rows(package, x, related, f"block:{i}", cells)
        elif _name(x) == "p":
            if (text := _text(x)).strip():
                style = _find(x, "pPr", "pStyle")
                heading = style is not None and (_get(style, "val") or "").lower().startswith("heading")
                yield Block(f"block:{i}", "HEADING" if heading else "LIST" if _find(x, "pPr", "numPr") is not None else "PARAGRAPH", text)
            yield from _pictures(package, x, related, f"block:{i}")
    part = "word/footnotes.xml"
    if part in package.NameToInfo:
        related = _related(package, part)
        for note in ElementTree.fromstring(package.read(part)):
            if _name(note) == "footnote" and _get(note, "type") in (None, "normal"):
                for i, x in enumerate((y for y in note if _name(y) == "p"), 1):
                    at = f"footnote:{_get(note, 'id')}/paragraph:{i}"
                    if (text := _text(x)).strip():
                        yield Block(at, "FOOTNOTE", text)
                    yield from _pictures(package, x, related, at)


class Transform(NamedTuple):
    """From a group's inner coordinates to the slide's: x * wide + left, y * high + top."""

    wide: float = 1.0
    high: float = 1.0
    left: float = 0.0
    top: float = 0.0

    def inside(self, frame: ElementTree.Element | None) -> Transform:
        """The transform of what a group with this frame holds."""
        if frame is None or None in (parts := [_find(frame, k) for k in ("off", "ext", "chOff", "chExt")]):
            return self
        off, ext, child, size = ([float(_get(x, k) or 0) for k in (("x", "y") if i % 2 == 0 else ("cx", "cy"))] for i, x in enumerate(parts))
        wide, high = (ext[i] / size[i] if size[i] else 1.0 for i in (0, 1))
        return Transform(self.wide * wide, self.high * high, self.left + self.wide * (off[0] - child[0] * wide), self.top + self.high * (off[1] - child[1] * high))

    def box(self, frame: ElementTree.Element | None, page: tuple[float, float]) -> list[int] | None:
        """A frame's box in thousandths of the page, cut at its edges."""
        off, ext = (None, None) if frame is None else (_find(frame, "off"), _find(frame, "ext"))
        if off is None or ext is None or min(page) <= 0:
            return None
        x, y, w, h = (float(_get(e, k) or 0) for e, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))
        at = lambda v, scale, start, whole: min(1000, max(0, round(1000 * (v * scale + start) / whole)))
        return [at(x, self.wide, self.left, page[0]), at(y, self.high, self.top, page[1]), at(x + w, self.wide, self.left, page[0]), at(y + h, self.high, self.top, page[1])]


def _shapes(package: zipfile.ZipFile, tree: ElementTree.Element, related: dict, page: tuple[float, float], place: str, now: Transform, counts: tuple[_Count, _Count]) -> Iterator[Block]:
    number = 0
    for x in tree:
        kind = _name(x)
        if kind not in ("sp", "grpSp", "pic", "graphicFrame", "cxnSp"):
            continue
        counts[0]()
        number += 1
        at = f"{place}/shape:{number}"
        if kind == "grpSp":
            if at.count("/shape:") > DEEPEST_GROUP:
                raise Limit("GROUP_DEPTH")
            yield from _shapes(package, x, related, page, at, now.inside(_find(x, "grpSpPr", "xfrm")), counts)
        elif kind == "pic":
            yield from _pictures(package, x, related, at, now.box(_find(x, "spPr", "xfrm"), page))
        elif kind == "graphicFrame":
            box, table = now.box(_find(x, "xfrm"), page), _find(x, "graphic", "graphicData", "tbl")
            if table is not None:
                yield from (b._replace(box=box) for b in _table_rows(package, table, related, at, counts[1]))
        elif kind == "sp":
            role = _find(x, "nvSpPr", "nvPr", "ph")
            title = role is not None and _get(role, "type") in ("title", "ctrTitle")
            body, box = _find(x, "txBody"), now.box(_find(x, "spPr", "xfrm"), page)
            for i, p in enumerate(() if body is None else (y for y in body if _name(y) == "p"), 1):
                if (text := _text(p)).strip():
                    marks = _find(p, "pPr")
                    listed = marks is not None and any(_name(m) in ("buChar", "buAutoNum", "buBlip") for m in marks)
                    yield Block(f"{at}/paragraph:{i}", "HEADING" if title and i == 1 else "LIST" if listed else "PARAGRAPH", text, box)


def pptx_blocks(package: zipfile.ZipFile) -> Iterator[Block]:
    """A10: shapes of slides in the order of the presentation, through groups, with their boxes; tables, pictures and notes."""
    counts = _Count(SHAPES, "SHAPE_LIMIT"), _Count(TABLE_CELLS, "TABLE_CELL_LIMIT")
    slides = [n for _, n in numbered_parts(package, "ppt/slides/slide")]
    page = (0.0, 0.0)
    if "ppt/presentation.xml" in package.NameToInfo:
        head = ElementTree.fromstring(package.read("ppt/presentation.xml"))
        related, ids = _related(package, "ppt/presentation.xml"), _find(head, "sldIdLst")
        # a slide's own number and its relationship are both named id: the relationship's has a namespace
        listed = [related.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), ""), ("", ""))[1] for x in (() if ids is None else ids)]
        slides = [s for s in listed if s in package.NameToInfo] or slides
        size = _find(head, "sldSz")
        page = page if size is None else (float(_get(size, "cx") or 0), float(_get(size, "cy") or 0))
    for number, name in enumerate(slides, 1):
        root, related = ElementTree.fromstring(package.read(name)), _related(package, name)
        tree = _find(root, "cSld", "spTree")
        if tree is not None:
            yield from _shapes(package, tree, related, page, f"slide:{number}", Transform(), counts)
        else:
            yield from (Block(f"slide:{number}", "PARAGRAPH", t) for x in root.iter() if _name(x) == "p" and (t := _text(x)).strip())
        notes = [path for kind, path in related.values() if kind == "notesSlide" and path in package.NameToInfo]
        for path in notes:
            said = [s for s in ElementTree.fromstring(package.read(path)).iter() if _name(s) == "sp" and (r := _find(s, "nvSpPr", "nvPr", "ph")) is not None and _get(r, "type") == "body"]
            for i, p in enumerate((p for s in said for p in s.iter() if _name(p) == "p"), 1):
                if (text := _text(p)).strip():
                    yield Block(f"slide:{number}/notes:{i}", "NOTE", text)


def xlsx_blocks(package: zipfile.ZipFile) -> Iterator[Block]:
    """Cells that show, row by row (``sheets.sheet_cells``); covered and empty ones are left out, formulas are kept as text and never run."""
    for c in sheet_cells(package):
        if c.text and not c.covered:
            yield Block(f"sheet:{c.sheet}!{cell_name(c.row, c.col)}", "CELL", c.text)


READERS = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks}


def _in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while held := list(islice(rows, ROWS_AT_ONCE)):
        yield pd.DataFrame(held, columns=columns)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, place, kind, text, box, media, asset) of the office files under a path.

    ``box`` (left, top, right, bottom in thousandths of the slide) is that of shapes, ``asset`` the bytes of pictures, whose text is their description.
    A refused file is one row of kind REFUSED; a file that breaks off, or passes a limit, ends with such a row. Rows leave a task in batches.
    """

    def blocks(file: str, data: bytes) -> Iterator[tuple]:
        reader = READERS.get(file.rpartition(".")[2].lower())
        refused, at = inspect_package(data) if reader else "UNKNOWN_FORMAT", 0
        if not refused:
            try:
                for at, b in enumerate(reader(zipfile.ZipFile(io.BytesIO(data))), 1):
                    yield (file, at - 1, *b)
            except Limit as limit:
                refused = f"LIMIT: {limit}"
            except (KeyError, IndexError, ValueError, ElementTree.ParseError, zipfile.BadZipFile) as broken:
                refused = f"BROKEN: {type(broken).__name__}"
        if refused:
            yield (file, at, *Block("", "REFUSED", refused))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                yield from _in_batches(blocks(file, data), ["path", "block", *Block._fields])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, block int, place string, kind string, text string, box array<int>, media string, asset binary")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, text, row_span, col_span, covered) of the cells that show in the .xlsx files under a path; rows and columns count from 1.

    A refused or broken file has one row with sheet 0 and the reason as its text.
    """

    def cells(file: str, data: bytes) -> Iterator[tuple]:
        refused = inspect_package(data)
        try:
            if not refused:
                yield from ((file, *c) for c in sheet_cells(zipfile.ZipFile(io.BytesIO(data))))
        except (KeyError, IndexError, ValueError, ElementTree.ParseError, zipfile.BadZipFile) as broken:
            refused = f"BROKEN: {type(broken).__name__}"
        if refused:
            yield (file, 0, 0, 0, refused, 1, 1, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                yield from _in_batches(cells(file, data), ["path", *Cell._fields])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sheet int, row int, col int, text string, row_span int, col_span int, covered boolean")


def decode_text(data: bytes) -> tuple[str, str]:
    """(text, encoding) by byte order mark, strict UTF-8, or GB18030 that encodes back to the same bytes; ('', '') if none fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), name
    for name in ("utf-8", "gb18030"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if text.encode(name) == data:
            return text, name
    return "", ""


def detect_delimiter(text: str, rows: int = 20) -> str:
    """The delimiter of the highest score over the first rows: rows that hold it, fields, and how even they are."""

    def fields(line: str, delimiter: str) -> int:
        quoted, n = False, 1
        for c in line:
            quoted ^= c == '"'
            n += c == delimiter and not quoted
        return n

    lines = [x for x in text.splitlines() if x.strip()][:rows]

    def score(delimiter: str) -> int:
        counts = [n for n in (fields(x, delimiter) for x in lines) if n > 1]
        return len(counts) * 100 + sum(counts) - (max(counts) - min(counts)) * 20 if counts else 0

    return max(DELIMITERS, key=score)
