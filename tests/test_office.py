"""Office packages and delimited text from made-up files."""

import zipfile

from lorespan.sources import office


def package(path, **files):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_x", "."), text)


W = 'xmlns:w="urn:w"'


def test_office_files(spark, tmp_path):
    package(
        tmp_path / "a.docx",
        word__document_xxml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    )
    package(
        tmp_path / "b.xlsx",
        xl__sharedStrings_xxml="<sst><si><t>name</t></si></sst>",
        xl__worksheets__sheet1_xxml='<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row><row r="2" hidden="1"><c r="A2"><v>9</v></c></row></sheetData></worksheet>',
    )
    package(tmp_path / "c.pptx", ppt__slides__slide1_xxml="<sld><p><r><t>Slide text</t></r></p></sld>")
    package(tmp_path / "d.docx", word___rels__document_xxml_xrels='<Relationships><Relationship TargetMode="External"/></Relationships>')
    (tmp_path / "e.docx").write_bytes(b"no package")
    got = {}
    for r in office.read_office(spark, str(tmp_path)).orderBy("path", "block").collect():
        got.setdefault(r.path[-6], []).append((r.kind, r.place, r.text))
    assert got["a"] == [("HEADING", "block:1", "Top"), ("PARAGRAPH", "block:2", "one two"), ("TABLE", "block:3/row:1", "x | y")]
    assert got["b"] == [("CELL", "sheet:1!A1", "name"), ("CELL", "sheet:1!B1", "=1+1")]
    assert got["c"] == [("PARAGRAPH", "slide:1", "Slide text")]
    assert got["d"] == [("REFUSED", "", "EXTERNAL_RELATION")] and got["e"] == [("REFUSED", "", "NOT_A_PACKAGE")]


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="http://x/{kind}" Target="{to}"/>' for k, (kind, to) in targets.items()) + "</Relationships>"


def test_word_files_with_notes_lists_tables_and_pictures(tmp_path):
    para = lambda t, p="": f"<w:p>{p}<w:r><w:t>{t}</w:t></w:r></w:p>"
    picture = '<w:p><w:r><w:drawing><wp:docPr xmlns:wp="urn:wp" descr="a cat"/><a:blip xmlns:a="urn:a" xmlns:r="urn:r" r:embed="i1"/></w:drawing></w:r></w:p>'
    inner = f"<w:tbl><w:tr><w:tc>{para('in')}{picture}</w:tc></w:tr></w:tbl>"
    package(
        tmp_path / "a.docx",
        word__document_xxml=f'<w:document {W}><w:body>{para("item", "<w:pPr><w:numPr/></w:pPr>")}<w:p><w:r><w:t>kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>{picture}<w:tbl><w:tr><w:tc>{para("x")}{para("z")}{inner}</w:tc><w:tc>{para("y")}</w:tc></w:tr></w:tbl></w:body></w:document>',
        word__footnotes_xxml=f'<w:footnotes {W}><w:footnote w:type="separator" w:id="-1">{para("line")}</w:footnote><w:footnote w:id="2">{para("note")}</w:footnote></w:footnotes>',
        word___rels__document_xxml_xrels=rels(i1=("image", "media/p.png")),
        word__media__p_xpng="png bytes",
    )
    with zipfile.ZipFile(tmp_path / "a.docx") as z:
        got = [(b.place, b.kind, b.text, b.media, b.asset) for b in office.docx_blocks(z)]
    image = ("IMAGE", "a cat", "image/png", b"png bytes")
    assert got == [
        ("block:1", "LIST", "item", None, None),
        ("block:2", "PARAGRAPH", "kept", None, None),
        ("block:3/image:1", *image),
        ("block:4/row:1", "TABLE", "x\nz | y", None, None),
        ("block:4/row:1/cell:1/table:1/row:1", "TABLE", "in", None, None),
        ("block:4/row:1/cell:1/table:1/row:1/cell:1/image:1", *image),
        ("footnote:2/paragraph:1", "FOOTNOTE", "note", None, None),
    ]
    deep = para("d")
    for _ in range(office.DEEPEST_TABLE + 2):
        deep = f"<w:tbl><w:tr><w:tc>{deep}</w:tc></w:tr></w:tbl>"
    package(tmp_path / "deep.docx", word__document_xxml=f"<w:document {W}><w:body>{deep}</w:body></w:document>")
    import pytest

    with zipfile.ZipFile(tmp_path / "deep.docx") as z, pytest.raises(office.Limit):
        list(office.docx_blocks(z))


def test_slides_in_order_through_groups(tmp_path):
    frame = lambda x, y, w, h, inner="", tag="xfrm": f'<{tag}><off x="{x}" y="{y}"/><ext cx="{w}" cy="{h}"/>{inner}</{tag}>'
    shape = lambda t, at, ph="", p="": f'<sp><nvSpPr><nvPr>{ph}</nvPr></nvSpPr><spPr>{at}</spPr><txBody><p>{p}<r><t>{t}</t></r></p></txBody></sp>'
    inner = frame(100, 100, 400, 400, '<chOff x="0" y="0"/><chExt cx="100" cy="100"/>')
    outer = frame(500, 0, 500, 500, '<chOff x="0" y="0"/><chExt cx="1000" cy="1000"/>')
    group = f'<grpSp><grpSpPr>{outer}</grpSpPr><grpSp><grpSpPr>{inner}</grpSpPr>{shape("deep", frame(50, 50, 50, 50))}</grpSp></grpSp>'
    table = f'<graphicFrame>{frame(0, 900, 2000, 50)}<graphic><graphicData><tbl><tr><tc><txBody><p><r><t>a</t></r></p></txBody></tc><tc><txBody><p><r><t>b</t></r></p></txBody></tc></tr></tbl></graphicData></graphic></graphicFrame>'
    pic = f'<pic><nvPicPr><cNvPr id="1" descr="pic"/></nvPicPr><blipFill><blip r:embed="i1"/></blipFill><spPr>{frame(0, 0, 100, 100)}</spPr></pic>'
    title = shape("Title", frame(0, 0, 1000, 100), '<ph type="title"/>')
    listed = shape("point", "", p='<pPr><buChar char="-"/></pPr>')
    slide = lambda body: f'<sld xmlns:r="urn:r"><cSld><spTree>{body}</spTree></cSld></sld>'
    package(
        tmp_path / "a.pptx",
        ppt__presentation_xxml='<presentation xmlns:r="urn:r"><sldIdLst><sldId id="256" r:id="r2"/><sldId id="257" r:id="r1"/></sldIdLst><sldSz cx="1000" cy="1000"/></presentation>',
        ppt___rels__presentation_xxml_xrels=rels(r1=("slide", "slides/slide1.xml"), r2=("slide", "/ppt/slides/slide2.xml")),
        ppt__slides__slide1_xxml=slide(title + group + table + pic),
        ppt__slides__slide2_xxml=slide(listed),
        ppt__slides___rels__slide1_xxml_xrels=rels(i1=("image", "../media/p.jpg"), n=("notesSlide", "../notesSlides/notesSlide1.xml")),
        ppt__media__p_xjpg="jpg",
        ppt__notesSlides__notesSlide1_xxml=f'<notes><cSld><spTree>{shape("said", "", chr(60) + "ph type=" + chr(34) + "body" + chr(34) + "/>")}{shape("7", "", chr(60) + "ph type=" + chr(34) + "sldNum" + chr(34) + "/>")}</spTree></cSld></notes>',
    )
    with zipfile.ZipFile(tmp_path / "a.pptx") as z:
        got = [(b.place, b.kind, b.text, b.box, b.asset) for b in office.pptx_blocks(z)]
    assert got == [
        ("slide:1/shape:1/paragraph:1", "LIST", "point", None, None),
        ("slide:2/shape:1/paragraph:1", "HEADING", "Title", [0, 0, 1000, 100], None),
        # (50, 50)-(100, 100) in the inner group is (300, 300)-(500, 500) in the outer one, half of that from 500 on the slide
        ("slide:2/shape:2/shape:1/shape:1/paragraph:1", "PARAGRAPH", "deep", [650, 150, 750, 250], None),
        ("slide:2/shape:3/row:1", "TABLE", "a | b", [0, 900, 1000, 950], None),
        ("slide:2/shape:4/image:1", "IMAGE", "pic", [0, 0, 100, 100], b"jpg"),
        ("slide:2/notes:1", "NOTE", "said", None, None),
    ]


def sheet(cells, merges=(), hidden_rows=(), hidden_cols=()):
    rows = {}
    for (r, c), t in sorted(cells.items()):
        rows.setdefault(r, []).append(f'<c r="{office.cell_name(r, c)}" t="inlineStr"><is><t>{t}</t></is></c>')
    for r in hidden_rows:
        rows.setdefault(r, [])
    body = "".join(f'<row r="{r}"{" hidden=" + chr(34) + "1" + chr(34) if r in hidden_rows else ""}>{"".join(rows[r])}</row>' for r in sorted(rows))
    refs = "".join(f'<mergeCell ref="{office.cell_name(t, lo)}:{office.cell_name(b, hi)}"/>' for t, b, lo, hi in merges)
    return f'<worksheet xmlns="urn:x"><cols>{"".join(f"<col min={chr(34)}{c}{chr(34)} max={chr(34)}{c}{chr(34)} hidden={chr(34)}1{chr(34)}/>" for c in hidden_cols)}</cols><sheetData>{body}</sheetData><mergeCells>{refs}</mergeCells></worksheet>'


def test_sheets_equal_the_merge_operator(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from lorespan.operators.chunking import apply_merges

    rng, raw, areas, hidden, pages = random.Random(6), [], [], [], {}
    for n in range(1, 9):
        cells = {(rng.randint(1, 14), rng.randint(1, 8)): f"t{i}" for i in range(rng.randint(0, 50))}
        merges = [(r, r + rng.randint(0, 3), c, c + rng.randint(0, 2)) for r in (1, 6, 11, 16) for c in (1, 5) if rng.random() < 0.6]
        rows = rng.sample(range(1, 15), rng.randint(0, 4))
        pages[f"xl__worksheets__sheet{n}_xxml"] = sheet(cells, merges, rows)
        raw += [(n, r, c, t) for (r, c), t in cells.items() if r not in rows]
        areas += [(n, *m) for m in merges]
        hidden += [(n, r) for r in rows]
    package(tmp_path / "a.xlsx", **pages)
    want = apply_merges(spark.createDataFrame(raw, "sheet int, row int, col int, text string"), spark.createDataFrame(areas, "sheet int, top int, bottom int, left int, right int"), spark.createDataFrame(hidden, "sheet int, row int"))
    got = office.read_sheets(spark, str(tmp_path)).drop("path")
    order = ["sheet", "row", "col", "text", "row_span", "col_span", "covered"]
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    package(tmp_path / "b.xlsx", xl__worksheets__sheet1_xxml=sheet({(1, 1): "a", (1, 2): "b", (1, 3): "c", (2, 2): "d"}, [(1, 2, 1, 3)], (), (1,)))
    (tmp_path / "c.xlsx").write_bytes(b"none")
    rows = office.read_sheets(spark, str(tmp_path)).filter(F.col("path").rlike("[bc].xlsx")).orderBy("path", "row", "col").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 1, 2, "b", 2, 2, False), (1, 1, 3, "c", 1, 1, True), (1, 2, 2, "d", 1, 1, True), (0, 0, 0, "NOT_A_PACKAGE", 1, 1, False)]


def test_a_long_sheet_is_read_in_bounded_memory(tmp_path):
    import tracemalloc

    from lorespan.sources import sheets

    with zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_STORED) as z, z.open("xl/worksheets/sheet1.xml", "w") as out:
        out.write(b"<worksheet><sheetData>")
        for r in range(1, 30001):
            out.write(b'<row r="%d"><c r="A%d"><v>%d</v></c><c r="B%d"><v>1</v></c></row>' % (r, r, r, r))
        out.write(b"</sheetData></worksheet>")
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        tracemalloc.start()
        total = sum(int(c.text) for c in sheets.sheet_cells(z) if c.col == 1)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert total == 30000 * 30001 // 2 and peak < 1_000_000


def test_text_detection():
    assert office.decode_text("é".encode()) == ("é", "utf-8") and office.decode_text(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")
    assert office.decode_text("检索".encode("gb18030")) == ("检索", "gb18030")
    assert [office.detect_delimiter(f'a{d}b{d}c\n1{d}"x,y;z"{d}3\n') for d in ",\t;|"] == list(",\t;|")


def test_uploads_are_what_they_say(spark, tmp_path):
    from pyspark.sql import functions as F

    from lorespan.sources import uploads

    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    package(tmp_path / "a.docx", word__document_xxml="<d/>")
    package(tmp_path / "b.docx", xl__workbook_xxml="<d/>")
    files = {"c.pdf": b"%PDF-1.7", "d.pdf": b"text", "e.txt": b"plain", "g.exe": b"MZ", "h.csv": b"a,b", "i.txt": b"%PDF-1.7"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    declared = {"a.docx": docx, "b.docx": docx, "c.pdf": "application/pdf", "d.pdf": "application/pdf", "e.txt": "text/plain; charset=utf-8", "g.exe": None, "h.csv": "application/pdf", "i.txt": None}
    said = spark.createDataFrame(list(declared.items()), "name string, declared string")
    read = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).join(said, "name")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.fault) for r in uploads.validate_uploads(read, uploads.format_registry(spark)).collect()}
    assert got == {
        "a.docx": ("DOCX", None), "b.docx": ("DOCX", "FILE_SIGNATURE_INVALID"), "c.pdf": ("PDF", None), "d.pdf": ("PDF", "FILE_SIGNATURE_INVALID"), "e.txt": ("TXT", None),
        "g.exe": (None, "FILE_EXTENSION_INVALID"), "h.csv": ("CSV", "FILE_MEDIA_TYPE_INVALID"), "i.txt": ("TXT", "FILE_CONTENT_TYPE_INVALID"),
    }


def test_delimited_files_and_tables(spark, tmp_path):
    from lorespan.operators import parsing as P
    from lorespan.sources import uploads

    (tmp_path / "a.csv").write_bytes('x;"y;z"\n\n1;检索\n'.encode("gb18030"))
    (tmp_path / "b.csv").write_text("a\tb\n" * 20_001)
    rows = {(r.path[-5], r.row): (r.cells, r.delimiter) for r in uploads.read_delimited(spark, str(tmp_path)).collect()}
    assert rows == {("a", 0): (["x", "y;z"], ";"), ("a", 1): (["1", "检索"], ";"), ("b", -1): (["LIMIT_EXCEEDED"], "\t")}
    html = "<table><tr><th rowspan=2>a</th><td colspan=2>b <table><tr><td>in</td></tr></table></td></tr><tr><td>c<td>d</table>"
    assert P.html_tables(html) == [[["a", "b in", ""], ["", "c", "d"]]] and P.html_tables("no") == []
