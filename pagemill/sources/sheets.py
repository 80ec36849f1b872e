"""XLSX as a Spark data source: first or named sheet in, several sheets out. Only the standard library reads and writes it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def looks_like_xlsx(head: bytes) -> bool:
    return head[:4] == b"PK\x03\x04"


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def read_sheet(data: bytes, sheet: str | None = None) -> Iterator[list[str]]:
    """The rows of a sheet as texts; rich text is joined, formulas give their cached value, missing cells are empty."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    sheets = list(ET.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
    chosen = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
    if chosen is None:
        return
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    path = targets[chosen.get(f"{LINKS}id")].lstrip("/")
    path = path if path.startswith("xl/") else f"xl/{path}"
    for row in ET.fromstring(book.read(path)).iter(f"{MAIN}row"):
        out: list[str] = []
        for cell in row.iter(f"{MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(out)
            out += [""] * (at + 1 - len(out))
            value = cell.find(f"{MAIN}v")
            if cell.get("t") == "s" and value is not None:
                out[at] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
            else:
                out[at] = (value.text or "") if value is not None else ""
        yield out


def write_workbook(sheets: dict[str, Iterable[Iterable]], frozen: bool = True) -> bytes:
    """A workbook of named sheets, their first row frozen; texts are inline, numbers stay numbers."""
    names = list(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(names))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINKS[1:-1]}"><sheets>{listed}</sheets></workbook>')
        related = "".join(f'<Relationship Id="r{i + 1}" Type="{LINKS[1:-1]}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>')
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if frozen else ""
        for i, n in enumerate(names):
            with book.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{MAIN[1:-1]}">{pane}<sheetData>'.encode())
                for r, row in enumerate(sheets[n], 1):
                    cells = []
                    for c, v in enumerate(row):
                        at = f"{_letters(c)}{r}"
                        if isinstance(v, int | float) and not isinstance(v, bool):
                            cells.append(f'<c r="{at}"><v>{v}</v></c>')
                        elif v is not None:
                            text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
                            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
                    f.write(f'<row r="{r}">{"".join(cells)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, row, cells of the workbooks under a path, one task a workbook, through any file system that Spark reads."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, i, cells) for p, data in zip(frame["path"], frame["content"], strict=True) for i, cells in enumerate(read_sheet(bytes(data), sheet))]
            yield pd.DataFrame(rows, columns=["file", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row long, cells array<string>")


def band(confidence: F.Column) -> F.Column:
    """The colour band of a confidence in reports."""
    return F.when(confidence < 0.6, "low").when(confidence < 0.8, "middle").otherwise("high")
