"""Spreadsheet cells as a stream of rows: XML events pass once for a sheet's frame and once for its cells, whole trees are never held."""

from __future__ import annotations

import re
import zipfile
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree


class Cell(NamedTuple):
    sheet: int
    row: int
    col: int
    text: str
    row_span: int = 1
    col_span: int = 1
    covered: bool = False


class Area(NamedTuple):
    """A merged area, and where it shows."""

    top: int
    left: int
    bottom: int
    right: int
    first_row: int
    first_col: int
    rows: int
    cols: int


def cell_name(row: int, col: int) -> str:
    """A1 for (1, 1)."""
    letters = ""
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def cell_place(name: str) -> tuple[int, int]:
    """(1, 1) for A1."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d{1,7})", name)
    if not m:
        raise ValueError(name)
    col = 0
    for c in m[1].upper():
        col = 26 * col + ord(c) - 64
    return int(m[2]), col


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _ends(package: zipfile.ZipFile, part: str, names: tuple[str, ...]) -> Iterator[ElementTree.Element]:
    """Elements of these names as they end, each emptied afterwards, with what stood before it in its parent."""
    with package.open(part) as source:
        above: list[ElementTree.Element] = []
        for event, x in ElementTree.iterparse(source, ("start", "end")):
            if event == "start":
                above.append(x)
                continue
            above.pop()
            if _local(x) in names:
                yield x
                x.clear()
                if above:
                    above[-1].clear()


def _shown(element: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in element.iter() if _local(x) == "t")


def _true(value: str | None) -> bool:
    return value in ("1", "true")


class Frame:
    """What a sheet says about its rows, columns and areas: all of it small beside its cells."""

    def __init__(self, package: zipfile.ZipFile, part: str):
        self.hidden_rows, self.hidden_cols, areas, row = array("I"), [], [], 0
        for x in _ends(package, part, ("col", "row", "mergeCell")):
            if _local(x) == "col" and _true(x.get("hidden")):
                self.hidden_cols.append((int(x.get("min", 0)), int(x.get("max", 0))))
            elif _local(x) == "row":
                row = int(x.get("r") or row + 1)
                if _true(x.get("hidden")):
                    self.hidden_rows.append(row)
            elif _local(x) == "mergeCell":
                first, _, last = (x.get("ref") or "").partition(":")
                areas.append((*cell_place(first), *cell_place(last or first)))
        self.areas = sorted(a for x in areas if (a := self._area(*x)))

    def row_shows(self, row: int) -> bool:
        at = bisect_left(self.hidden_rows, row)
        return at == len(self.hidden_rows) or self.hidden_rows[at] != row

    def col_shows(self, col: int) -> bool:
        return not any(a <= col <= b for a, b in self.hidden_cols)

    def _area(self, top: int, left: int, bottom: int, right: int) -> Area | None:
        rows = bottom - top + 1 - (bisect_right(self.hidden_rows, bottom) - bisect_left(self.hidden_rows, top))
        cols = [c for c in range(left, right + 1) if self.col_shows(c)]
        if rows < 1 or not cols:
            return None
        first = top
        while not self.row_shows(first):
            first += 1
        return Area(top, left, bottom, right, first, cols[0], rows, len(cols))


def _rows(package: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """(row, its texts by column) in the order of the sheet."""
    row = 0
    for x in _ends(package, part, ("row",)):
        row, col, texts = int(x.get("r") or row + 1), 0, {}
        for cell in x:
            if _local(cell) != "c":
                continue
            col = cell_place(cell.get("r"))[1] if cell.get("r") else col + 1
            parts = {_local(y): y for y in cell}
            value = (parts["v"].text or "") if "v" in parts else _shown(cell)
            if "f" in parts:
                value = f"={parts['f'].text or ''}"
            elif cell.get("t") == "s":
                value = shared[int(value)]
            elif cell.get("t") == "b":
                value = "TRUE" if value == "1" else "FALSE"
            texts[col] = value
        yield row, texts


def _placed(frame: Frame, rows: Iterator[tuple[int, dict[int, str]]], sheet: int) -> Iterator[Cell]:
    """Cells that show, row by row, areas applied as rows pass; an area's first cell is made where the sheet has none."""
    # areas that are still to come, those that the row may touch, and of these those whose first cell has not passed
    coming = 0
    held: list[Area] = []
    open_: list[Area] = []

    def out(row: int, texts: dict[int, str]) -> Iterator[Cell]:
        firsts = {a.first_col: a for a in held if a.first_row == row}
        across = sorted((a.left, a.right) for a in held)
        for col in sorted(texts.keys() | firsts.keys()):
            if not frame.col_shows(col):
                continue
            at = bisect_right(across, (col, 1 << 30)) - 1
            inside = at >= 0 and across[at][1] >= col
            area = firsts.get(col)
            yield Cell(sheet, row, col, texts.get(col, ""), *((area.rows, area.cols) if area else (1, 1)), inside and not area)

    def blank(area: Area) -> Cell:
        return Cell(sheet, area.first_row, area.first_col, "", area.rows, area.cols)

    for row, texts in rows:
        while coming < len(frame.areas) and frame.areas[coming].top <= row:
            held.append(frame.areas[coming])
            open_.append(frame.areas[coming])
            coming += 1
        # first rows that the sheet leaves out
        yield from (blank(a) for a in open_ if a.first_row < row)
        held, open_ = [a for a in held if a.bottom >= row], [a for a in open_ if a.first_row > row]
        if frame.row_shows(row):
            yield from out(row, texts)
    yield from (blank(a) for a in [*open_, *frame.areas[coming:]])


def numbered_parts(package: zipfile.ZipFile, start: str) -> list[tuple[int, str]]:
    """Parts of a package whose path is ``start``, a number and .xml, in the order of numbers."""
    return sorted((int(m[1]), n) for n in package.namelist() if (m := re.fullmatch(re.escape(start) + r"(\d+)\.xml", n)))


def sheet_cells(package: zipfile.ZipFile) -> Iterator[Cell]:
    """Cells of the sheets that show, in order; areas of a sheet don't overlap and its rows ascend."""
    part = "xl/sharedStrings.xml"
    shared = [_shown(x) for x in _ends(package, part, ("si",))] if part in package.NameToInfo else []
    for number, name in numbered_parts(package, "xl/worksheets/sheet"):
        yield from _placed(Frame(package, name), _rows(package, name, shared), number)
