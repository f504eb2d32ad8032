"""Spreadsheets (xlsx) as a source: zip members of XML, read row by row, without a spreadsheet library.

Files come through Spark's binary reader, so they may lie in any store that Spark reads; each file is a row, and the
rows of a sheet are made one after the other. Only known columns are kept, by trimmed header, as text that the caller
types. A file that is no workbook is an error, a sheet without a header has no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that a file's rows are given out in.
ROWS = 4096
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item, of all its runs, without the reading aids of phonetic runs."""
    if _plain(node.tag) == "rPh":
        return ""
    own = node.text or "" if _plain(node.tag) == "t" else ""
    return own + "".join(_texts(child) for child in node)


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if _plain(node.tag) == "si":
                found.append(_texts(node))
                node.clear()
    return found


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets, in order, and the members that hold them."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    member = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name"), member(rels[s.get(_REL)])) for s in root.iter() if _plain(s.tag) == "sheet"]


def _column(ref: str | None, before: int) -> int:
    """The place of a cell from its reference (A1, AB7); the next one if it has none."""
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return before + 1
    n = 0
    for c in letters[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell)
    v = next((x.text for x in cell if _plain(x.tag) == "v"), None)
    if v is None or kind == "e":
        return None
    return strings[int(v)] if kind == "s" else v


def rows_of_sheet(book: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str | None]]]:
    """Row numbers and their cells by place; what is absent is left out."""
    with book.open(member) as f:
        number = 0
        for _, node in ElementTree.iterparse(f):
            if _plain(node.tag) == "row":
                number = int(node.get("r", number + 1))
                cells, at = {}, -1
                for c in node:
                    at = _column(c.get("r"), at)
                    cells[at] = _value(c, strings)
                yield number, cells
                node.clear()


def load_sheets(spark: SparkSession, paths: list[str], columns: list[str], sheet: int | str | None = 0) -> DataFrame:
    """path, sheet, row (its number in the sheet) and the named columns as text, null where a file lacks one.

    The first row that has a cell is the header. sheet: a place, a name, or None for all sheets. Rows without any
    value are left out. Numbers and days come as the file has them; ``typed_day`` reads the serial numbers of days.
    """
    columns = list(columns)

    def table(path: str, name: str, base: str, found: list[tuple[int, list[str | None]]]) -> pa.RecordBatch:
        values = list(zip(*(v for _, v in found))) or [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([name] * len(found)), pa.array([base] * len(found)), pa.array([n for n, _ in found], pa.int64()),
                                           *[pa.array(v, pa.string()) for v in values]], names=["path", "sheet", "base", "row", *[f"c{k}" for k in range(len(columns))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as book:
                    strings = _strings(book)
                    base = "1904" if re.search(rb'date1904="(1|true)"', book.read("xl/workbook.xml")) else "1900"
                    for k, (name, member) in enumerate(_sheets(book)):
                        if sheet is not None and sheet not in (k, name):
                            continue
                        places, out = None, []
                        for number, cells in rows_of_sheet(book, member, strings):
                            if places is None:
                                header = {(v or "").strip(): at for at, v in reversed(cells.items())}
                                places = [header.get(c) for c in columns] if cells else None
                                continue
                            values = [cells.get(at) for at in places]
                            if any(v is not None for v in values):
                                out.append((number, values))
                            if len(out) >= ROWS:
                                yield table(path, name, base, out)
                                out = []
                        yield table(path, name, base, out)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    fields = ", ".join(["path string", "sheet string", "base string", "row long", *[f"c{k} string" for k in range(len(columns))]])
    return files.mapInArrow(run, fields).toDF("path", "sheet", "base", "row", *columns)


def typed_day(c, base=None):
    """A day from ``2024-01-31``, with a time or without, ``31/01/2024`` (day first), or a serial number; else null.

    base: the column that says from which year serial numbers count, 1900 if there is none.
    """
    text = F.trim(c.cast("string"))
    serial = F.when(text.rlike(r"^\d{1,6}(\.\d+)?$"), F.floor(text.try_cast("double")).cast("int"))
    # Serial numbers of 1900 count a 29th of February that never was; days from 1 March 1900 on are right.
    origin = F.lit("1899-12-30") if base is None else F.when(base == "1904", "1904-01-01").otherwise("1899-12-30")
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(iso, F.to_date(F.try_to_timestamp(text, F.lit("d/M/yyyy"))), F.date_add(origin.cast("date"), serial))
