"""XLSX workbooks as a Spark data source: cells to read, one partition a sheet, and a plain writer."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def letters(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def address(ref: str) -> tuple[int, int]:
    name, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in name:
        col = col * 26 + ord(c) - 64
    return int(row) - 1, col - 1


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + targets[s.get(f"{REL}id")].removeprefix("/xl/")) for s in root.iter(f"{MAIN}sheet")]


class SheetPartition(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        self.path, self.name, self.part = path, name, part


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[SheetPartition]:
        with zipfile.ZipFile(self.path) as book:
            return [SheetPartition(self.path, n, p) for n, p in sheet_parts(book)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        kinds = {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error"}
        with zipfile.ZipFile(partition.path) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
            with book.open(partition.part) as part:
                for _, cell in ElementTree.iterparse(part):
                    if cell.tag == f"{MAIN}row":
                        cell.clear()
                    if cell.tag != f"{MAIN}c":
                        continue
                    row, col = address(cell.get("r"))
                    kind, v, f = cell.get("t", "n"), cell.find(f"{MAIN}v"), cell.find(f"{MAIN}f")
                    value = v.text if v is not None else None
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    if kind == "b" and value is not None:
                        value = "TRUE" if value == "1" else "FALSE"
                    formula = None if f is None or f.text is None else "=" + f.text
                    if value is not None or formula:
                        yield partition.name, row, col, formula, kinds.get(kind, "number"), value


class XlsxSource(DataSource):
    """spark.read.format("xlsx_cells").load(path): (sheet, row, col, formula, kind, value)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return "sheet string, row long, col int, formula string, kind string, value string"

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options["path"].removeprefix("file:"))


def write_workbook(cells: DataFrame, path: str) -> None:
    """One workbook file of cells; a file of this kind is at most 1,048,576 rows a sheet, read sheet by sheet in row order."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = [r["sheet"] for r in cells.select("sheet").distinct().orderBy("sheet").collect()]

    def one(c) -> str:
        at, f = f'r="{letters(c["col"])}{c["row"] + 1}"', f"<f>{escape(c['formula'][1:])}</f>" if c["formula"] else ""
        v = escape(c["value"] or "")
        if c["kind"] == "text" and not f:
            return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>'
        kind = {"text": ' t="str"', "bool": ' t="b"', "error": ' t="e"'}.get(c["kind"], "")
        return f"<c {at}{kind}>{f}<v>{'1' if v == 'TRUE' else '0' if c['kind'] == 'bool' else v}</v></c>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, text: str) -> None:
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + text)

        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook {space} xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, name in enumerate(names, 1):
            out, at = io.StringIO(), None
            for c in cells.filter(cells["sheet"] == name).orderBy("row", "col").toLocalIterator():
                if c["row"] != at:
                    out.write(("</row>" if at is not None else "") + f'<row r="{c["row"] + 1}">')
                    at = c["row"]
                out.write(one(c))
            put(f"xl/worksheets/sheet{i}.xml", f"<worksheet {space}><sheetData>{out.getvalue()}{'</row>' if at is not None else ''}</sheetData></worksheet>")
