"""Workbooks: many files in parallel, one task per file, rows streamed in Arrow batches.

Spark brings the bytes (any file system it can read); the standard library opens the archive. The first
sheet is read with its first row as header, every cell as text, so ids and dates keep their form.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMAT_IDS = {*range(14, 23), *range(45, 48)}
_EPOCH = dt.datetime(1899, 12, 30)
SHEET_ROWS = 1_048_576
_BATCH_ROWS = 10_000


def _text(node: ET.Element) -> str:
    """All runs of a rich or plain text, without phonetic hints."""
    parts = []
    for child in node:
        if child.tag == _MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == _MAIN + "r":
            parts.append(_text(child))
    return "".join(parts)


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == sheet.get(_REL_ID):
            target = rel.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("the workbook has no sheet")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ET.iterparse(f):
            if node.tag == _MAIN + "si":
                texts.append(_text(node))
                node.clear()
    return texts


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    dated = set(_DATE_FORMAT_IDS)
    for fmt in root.iterfind(f"{_MAIN}numFmts/{_MAIN}numFmt"):
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", "").lower())):
            dated.add(int(fmt.get("numFmtId")))
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", "0")) in dated}


def _column_number(reference: str) -> int:
    n = 0
    for ch in reference:
        if ch.isdigit():
            break
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell(node: ET.Element, shared: list[str], dated: set[int]) -> str | None:
    kind, value = node.get("t", "n"), node.findtext(_MAIN + "v")
    if kind == "inlineStr":
        inline = node.find(_MAIN + "is")
        return _text(inline) if inline is not None else None
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and int(node.get("s", "0")) in dated:
        return str((_EPOCH + dt.timedelta(days=float(value))).replace(microsecond=0))
    return value


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dated = _shared_texts(book), _date_styles(book)
        with book.open(_first_sheet(book)) as f:
            for _, node in ET.iterparse(f):
                if node.tag != _MAIN + "row":
                    continue
                row: list[str | None] = []
                for i, cell in enumerate(node):
                    at = _column_number(cell.get("r")) if cell.get("r") else i
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell(cell, shared, dated) or None
                yield row
                node.clear()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """A workbook, or a folder of workbooks with one header, as a table of strings."""

    def first_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers = [next(sheet_rows(c.as_buffer().to_pybytes()), []) for c in batch.column(0)]
            yield pa.record_batch({"h": pa.array(headers, pa.list_(pa.string()))})

    found = _files(spark, path).select("content").limit(1).mapInArrow(first_row, "h array<string>").first()
    if found is None:
        raise FileNotFoundError(f"no workbook at '{path}'")
    header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(found["h"])]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    width = len(header)
    arrow = pa.schema([(h, pa.string()) for h in header])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, file in zip(batch.column(0), batch.column(1)):
                held: list[list[str | None]] = []
                lines = sheet_rows(content.as_buffer().to_pybytes())
                own = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(next(lines, []))]
                if own != header:
                    raise ValueError(f"{file} has the columns {own}, expected {header}")
                for line in lines:
                    if any(v is not None for v in line[width:]):
                        raise ValueError(f"{file} has a row longer than its header of {width} columns")
                    held.append((line + [None] * width)[:width])
                    if len(held) == _BATCH_ROWS:
                        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=arrow)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=arrow)

    return _files(spark, path).select("content", F.col("path")).mapInArrow(rows, schema)


# The parts every workbook has.
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _row_xml(values) -> str:
    cells = [
        "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in values
    ]
    return "<row>" + "".join(cells) + "</row>"


def write_xlsx(df: DataFrame, folder: str, rows_per_file: int = SHEET_ROWS - 1) -> int:
    """Write the table as workbooks, each task its own, and return the number of rows.

    ``folder`` is a path that all executors share. File names follow partition numbers, and a file
    appears under its name only when whole, so a repeated task replaces its own files.
    """
    columns = df.columns
    os.makedirs(folder, exist_ok=True)

    def save(name: str, lines: list[str]) -> None:
        target = os.path.join(folder, name)
        with zipfile.ZipFile(target + ".tmp", "w", zipfile.ZIP_DEFLATED) as book:
            for part, xml in _PARTS.items():
                book.writestr(part, xml)
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                sheet.write(_row_xml(columns).encode())
                sheet.write("".join(lines).encode())
                sheet.write(b"</sheetData></worksheet>")
        os.replace(target + ".tmp", target)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, total, lines = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                lines.append(_row_xml(row))
                total += 1
                if len(lines) == rows_per_file:
                    save(f"part-{part:05d}-{number:03d}.xlsx", lines)
                    number, lines = number + 1, []
        if lines:
            save(f"part-{part:05d}-{number:03d}.xlsx", lines)
        yield pa.record_batch({"n": pa.array([total], pa.int64())})

    return df.select(*[F.col(c).cast("string") for c in columns]).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0
