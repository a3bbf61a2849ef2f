"""Office files as rows: a Python data source over ZIP packages.

`spark.read.format("office_items").load(folder)` gives the paragraphs, list
entries, table cells, slide texts and sheet cells of .docx, .pptx and .xlsx files
with the standard library alone. Files are spread over partitions; a package
that is damaged, too large or carries a document type declaration gives one row
of type "error" and never fails the scan. Hidden rows, columns, sheets and
slides are skipped; formulas are never run, their stored values are read.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, page_index int, reading_order int, type string, value string, level int, row_no int, col_no int, row_span int, col_span int, x double, y double, width double, height double"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
MAX_PART_BYTES, MAX_PARTS = 64 * 1024 * 1024, 4096
POINTS_PER_EMU = 1 / 12700
FILES_PER_PARTITION = 16


def _row(file: str, **values: object) -> tuple:
    return tuple(file if c == "file" else values.get(c) for c in COLUMNS)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if _local(c.tag) == name]


def _first(node: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        node = next(iter(_children(node, name)), None) if node is not None else None
    return node


def _attr(node: ElementTree.Element | None, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None) if node is not None else None


class Package:
    """Bounded access to the XML parts of a package and their relationships."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.sizes = {i.filename: i.file_size for i in self.zip.infolist()}
        if len(self.sizes) > MAX_PARTS or sum(self.sizes.values()) > 4 * MAX_PART_BYTES:
            raise ValueError("package too large")

    def xml(self, part: str) -> ElementTree.Element | None:
        if part not in self.sizes:
            return None
        if self.sizes[part] > MAX_PART_BYTES:
            raise ValueError(f"part too large: {part}")
        data = self.zip.read(part)
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise ValueError("document type declaration")
        return ElementTree.fromstring(data)

    def targets(self, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        rels = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in rels if rels is not None else ():
            target = r.attrib.get("Target", "")
            if r.attrib.get("TargetMode") != "External":
                out[r.attrib.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out


def docx_rows(file: str, package: Package) -> Iterator[tuple]:
    body = _first(package.xml("word/document.xml"), "body")
    order = 0
    for node in body if body is not None else ():
        if _local(node.tag) == "p":
            text = "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t" and not _deleted(node, t))
            if not text.strip():
                continue
            style = _attr(_first(node, "pPr", "pStyle"), "val") or ""
            heading = re.fullmatch(r"(?i)heading\s*(\d)", style)
            numbered = _first(node, "pPr", "numPr")
            level = int(heading[1]) if heading else int(_attr(_first(numbered, "ilvl"), "val") or 0) + 1 if numbered is not None else None
            yield _row(file, page_index=1, reading_order=order, type="heading" if heading else "list" if numbered is not None else "text", value=text, level=level)
            order += 1
        elif _local(node.tag) == "tbl":
            for r, line in enumerate(_children(node, "tr")):
                column = 0
                for cell in _children(line, "tc"):
                    span = int(_attr(_first(cell, "tcPr", "gridSpan"), "val") or 1)
                    text = "\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in _children(cell, "p"))
                    yield _row(file, page_index=1, reading_order=order, type="cell", value=text, row_no=r, col_no=column, row_span=1, col_span=span)
                    column += span
            order += 1


def _deleted(paragraph: ElementTree.Element, text: ElementTree.Element) -> bool:
    return any(text in set(d.iter()) for d in paragraph.iter() if _local(d.tag) == "del")


Matrix = tuple[float, float, float, float]  # scale x, scale y, shift x, shift y


def _frame(node: ElementTree.Element | None) -> tuple[float, float, float, float] | None:
    off, ext = _first(node, "off"), _first(node, "ext")
    if off is None or ext is None:
        return None
    return float(off.attrib["x"]), float(off.attrib["y"]), float(ext.attrib["cx"]), float(ext.attrib["cy"])


def _shapes(tree: ElementTree.Element, m: Matrix) -> Iterator[tuple[str, tuple | None]]:
    for node in tree:
        kind = _local(node.tag)
        if kind == "grpSp":
            xfrm = _first(node, "grpSpPr", "xfrm")
            own, inner = _frame(xfrm), None
            off, ext = _first(xfrm, "chOff"), _first(xfrm, "chExt")
            if off is not None and ext is not None:
                inner = float(off.attrib["x"]), float(off.attrib["y"]), float(ext.attrib["cx"]), float(ext.attrib["cy"])
            if own and inner and inner[2] and inner[3]:
                sx, sy = own[2] / inner[2], own[3] / inner[3]
                g = (m[0] * sx, m[1] * sy, m[0] * (own[0] - inner[0] * sx) + m[2], m[1] * (own[1] - inner[1] * sy) + m[3])
            else:
                g = m
            yield from _shapes(node, g)
        elif kind == "sp":
            text = "\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in node.iter() if _local(p.tag) == "p")
            f = _frame(_first(node, "spPr", "xfrm"))
            box = (m[0] * f[0] + m[2], m[1] * f[1] + m[3], m[0] * f[2], m[1] * f[3]) if f else None
            if text.strip():
                yield text, box


def pptx_rows(file: str, package: Package) -> Iterator[tuple]:
    deck = package.xml("ppt/presentation.xml")
    targets = package.targets("ppt/presentation.xml")
    page = 0
    for slide_id in _first(deck, "sldIdLst") or ():
        slide = package.xml(targets.get(next((v for k, v in slide_id.attrib.items() if k.startswith("{") and _local(k) == "id"), ""), ""))
        if slide is None or slide.attrib.get("show") == "0":
            continue
        page += 1
        tree = _first(slide, "cSld", "spTree")
        for order, (text, box) in enumerate(_shapes(tree, (1.0, 1.0, 0.0, 0.0)) if tree is not None else ()):
            x, y, w, h = (v * POINTS_PER_EMU for v in box) if box else (None,) * 4
            yield _row(file, page_index=page, reading_order=order, type="text", value=text, x=x, y=y, width=w, height=h)


def cell_place(reference: str) -> tuple[int, int]:
    """(row, column), both from 1, of a reference such as BC12."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits), column


def xlsx_rows(file: str, package: Package) -> Iterator[tuple]:
    shared = [("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t")) for si in (package.xml("xl/sharedStrings.xml") or ())]
    book, targets = package.xml("xl/workbook.xml"), package.targets("xl/workbook.xml")
    page = 0
    for entry in _first(book, "sheets") or ():
        if entry.attrib.get("state", "visible") != "visible":
            continue
        page += 1
        sheet = package.xml(targets.get(next((v for k, v in entry.attrib.items() if k.startswith("{") and _local(k) == "id"), ""), ""))
        hidden = set()
        for c in _first(sheet, "cols") or ():
            if c.attrib.get("hidden") in ("1", "true"):
                hidden.update(range(int(c.attrib["min"]), int(c.attrib["max"]) + 1))
        order = 0
        for line in _first(sheet, "sheetData") or ():
            if line.attrib.get("hidden") in ("1", "true"):
                continue
            for cell in line:
                row, column = cell_place(cell.attrib["r"])
                kind, stored = cell.attrib.get("t", "n"), _first(cell, "v")
                value = stored.text if stored is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
                elif kind == "b":
                    value = {"1": "true", "0": "false"}.get(value or "")
                if value is None or column in hidden:
                    continue
                yield _row(file, page_index=page, reading_order=order, type="cell", value=value, row_no=row - 1, col_no=column - 1, row_span=1, col_span=1)
                order += 1


READERS = {".docx": docx_rows, ".pptx": pptx_rows, ".xlsx": xlsx_rows}


def file_rows(path: str) -> Iterator[tuple]:
    """All rows of one file; what cannot be read gives one row of type error."""
    try:
        data = Path(path).read_bytes()
        yield from list(READERS[os.path.splitext(path)[1].lower()](path, Package(data)))
    except (ValueError, KeyError, IndexError, AttributeError, OSError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        yield _row(path, type="error", value=f"{type(e).__name__}: {e}"[:300])


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class OfficeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        if os.path.isfile(self.path):
            found = [self.path]
        else:
            found = sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if os.path.splitext(f)[1].lower() in READERS)
        return [Files(found[i : i + FILES_PER_PARTITION]) for i in range(0, len(found), FILES_PER_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from file_rows(path)


class OfficeItems(DataSource):
    """Rows of the Office files in a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "office_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> OfficeReader:
        return OfficeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OfficeItems)
