import zipfile

from pyspark.sql import functions as F

from pagelore.operators import ocr
from pagelore.sources import intake, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path):
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text, span: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>'
    package(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('Heading2', 'Title')}{p('Normal', 'Body')}<w:tbl><w:tr>{cell('wide', 2)}{cell('next', 1)}</w:tr></w:tbl></w:body></w:document>"})
    sheet = '<worksheet><cols><col min="2" max="2" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row r="2" hidden="1"><c r="A2"><v>9</v></c></row></sheetData></worksheet>'
    package(tmp_path / "b.xlsx", {"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>"})
    shape = '<p:sp><p:spPr><a:xfrm><a:off x="127000" y="0"/><a:ext cx="254000" cy="127000"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sp>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="127000" y="0"/><a:ext cx="508000" cy="254000"/><a:chOff x="0" y="0"/><a:chExt cx="254000" cy="127000"/></a:xfrm></p:grpSpPr>{shape}</p:grpSp>'
    names = 'xmlns:p="p" xmlns:a="a"'
    package(tmp_path / "c.pptx", {"ppt/presentation.xml": f'<p:presentation {names} {R}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>', "ppt/slides/s1.xml": f"<p:sld {names}><p:cSld><p:spTree>{group}</p:spTree></p:cSld></p:sld>"})
    (tmp_path / "d.docx").write_bytes(b"no zip")
    package(tmp_path / "e.docx", {"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    office.register(spark)
    rows = spark.read.format("office_items").load(str(tmp_path)).withColumn("file", F.regexp_extract("file", r"[^/]+$", 0)).collect()
    got = {(r["file"], r["type"], r["value"], r["row_no"], r["col_no"]) for r in rows if r["type"] != "error"}
    assert got == {("a.docx", "heading", "Title", None, None), ("a.docx", "text", "Body", None, None), ("a.docx", "cell", "wide", 0, 0), ("a.docx", "cell", "next", 0, 2), ("b.xlsx", "cell", "Name", 0, 0), ("b.xlsx", "cell", "2", 0, 2), ("c.pptx", "text", "Hi", None, None)}
    assert {r["file"] for r in rows if r["type"] == "error"} == {"d.docx", "e.docx"}
    slide = next(r for r in rows if r["file"] == "c.pptx")
    assert (slide["x"], slide["width"]) == (30.0, 40.0) and next(r for r in rows if r["value"] == "Title")["level"] == 2


def test_uploads_and_signatures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.png").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.tif").write_bytes(b"II*\x00" + b"x" * 50)
    files = intake.read_uploads(spark, str(tmp_path), 20)
    got = {r["path"][-5:]: (r["reason"], r["ok"]) for r in files.withColumn("ok", intake.signature_matches(F.col("content"), F.col("path"), spark)).collect()}
    assert got == {"a.pdf": (None, True), "b.png": (None, False), "c.tif": ("too_large", None)}


def test_declared_kinds(spark):
    df = spark.createDataFrame([("a.PDF", "application/pdf; q=1"), ("b.tif", "image/png"), ("c.exe", None), ("d.docx", None), (None, None)], "n string, m string")
    assert [r["declared"] for r in intake.declared_kind(df, "n", "m").orderBy("n").collect()] == ["unknown_extension", "accepted", "type_mismatch", "unknown_extension", "accepted"]


def test_adapter_conformance(spark):
    rows = [("pdf", "1.0", ["pdf"], ["application/pdf"], 100), ("other", "x", ["pdf", ".TIF"], [], 0), ("", "1.0.0", [], None, None)]
    got = {r[0]: r[1] for r in intake.adapter_issues(spark.createDataFrame(rows, "name string, version string, extensions array<string>, media_types array<string>, max_bytes bigint")).collect()}
    assert got == {"pdf": ["ownership_conflict"], "other": ["extension_form", "ownership_conflict", "size_limit", "version_malformed"], "": ["extensions_missing", "name_missing", "size_limit"]}


def test_word_files(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "w.tsv").write_text(f'{head}\n5\t1\t1\t1\t1\t1\t0\t0\t5\t5\t120\t"quoted\n5\t1\t1\t1\t1\t2\t9\t0\t0\t5\t50\tflat\n')
    assert [(r["text"], r["conf"]) for r in ocr.read_words(spark, str(tmp_path / "w.tsv")).collect()] == [('"quoted', 1.0)]
