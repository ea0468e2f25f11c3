"""Workbooks (Office Open XML) without a library: sheets as tables of cells, and result tables as formatted sheets.

Scan: a workbook is read by one task, as it is one zip archive; many workbooks are read in parallel. Cells are texts as they are
stored (numbers as written, booleans as TRUE or FALSE); dates are the numbers that the format has for them.

Sink: a sheet has at most 1,048,576 rows by the format, which bounds what a writer holds; rows come to the driver partition by partition and
go straight into the archive. A larger table is an error, never cut.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import find_name

MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(reference: str) -> int:
    """Place of a cell's column, from 0: of AB12, 27."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def column_name(number: int) -> str:
    name = ""
    while number >= 0:
        name, number = chr(65 + number % 26) + name, number // 26 - 1
    return name


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


class Workbook:
    """Sheets and cells of one archive."""

    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.archive.namelist())
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {}
        for sheet in self._xml("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            target = links[sheet.get(f"{_LINK}id")].lstrip("/")
            self.sheets[sheet.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
        self.shared = [_text(s) for s in self._xml("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []

    def _xml(self, name: str):
        return ElementTree.fromstring(self.archive.read(name))

    def _value(self, cell) -> str | None:
        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return _text(cell)
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        return ("TRUE" if value.text == "1" else "FALSE") if kind == "b" else value.text

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """Row numbers from 1, and the cells; rows without cells are left out."""
        number = 0
        with self.archive.open(self.sheets[sheet]) as data:
            for _, row in ElementTree.iterparse(data):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{_MAIN}c"):
                    place = column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = self._value(cell)
                if cells:
                    yield number, cells
                row.clear()


def read_rows(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """path, sheet, row (from 1), cells (array of texts) of workbooks; sheet: a name in any case and spacing, or None for all."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        for part in parts:
            for place, content in zip(part["path"], part["content"]):
                book = Workbook(content)
                for name in book.sheets if sheet is None else [find_name(book.sheets, sheet)]:
                    out = []
                    for number, cells in book.rows(name):
                        out.append((place, name, number, cells))
                        if len(out) == 5000:
                            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])
                            out = []
                    yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.mapInPandas(run, "path string, sheet string, row bigint, cells array<string>")


def read_cells(spark: SparkSession, path: str | list[str], sheet: str | None = None) -> DataFrame:
    """path, sheet, row, column (from 0), value of the cells that have one."""
    rows = read_rows(spark, path, sheet)
    return rows.select("path", "sheet", "row", F.posexplode("cells").alias("column", "value")).where(F.col("value").isNotNull())


def read_sheet(spark: SparkSession, path: str, sheet: str, header_row: int | None = 1) -> DataFrame:
    """A sheet as a table of texts with the names of its header row (those before it are left out), and `row_in_sheet`. Without a header
    row, columns are column_0, column_1, ...; empty cells are null."""
    rows = read_rows(spark, path, sheet)
    if header_row is None:
        width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
        names = [f"column_{i}" for i in range(width)]
    else:
        head = rows.where(F.col("row") == header_row).select("cells").first()
        if head is None:
            raise ValueError(f"{sheet} has no row {header_row}")
        names = [n if n else f"column_{i}" for i, n in enumerate(head["cells"])]
        rows = rows.where(F.col("row") > header_row)
    return rows.select(F.col("row").alias("row_in_sheet"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


_STYLES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FF{fill}"/></patternFill></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>'
    '<xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>'
)
_UNPRINTED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(place: str, value, style: int) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}" s="{style}"><v>{value!r}</v></c>'
    text = escape(_UNPRINTED.sub("", str(value)))
    return f'<c r="{place}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str, overwrite: bool = False, widths: dict[str, float] | None = None, fill: str = "D9E1F2") -> None:
    """One workbook with a sheet for each table: a bold, filled header that stays in view, wrapped cells, and the columns' widths (by name; 18
    otherwise). An error if the path is there and overwrite isn't asked for, or if a table has more rows than a sheet can hold."""
    spark = next(iter(sheets.values())).sparkSession
    widths, data = widths or {}, io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, kind = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for number, (name, df) in enumerate(sheets.items(), 1):
            with archive.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as out:
                columns = "".join(f'<col min="{i}" max="{i}" width="{widths.get(c, 18)}" customWidth="1"/>' for i, c in enumerate(df.columns, 1))
                out.write(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData>'.encode())
                out.write(('<row r="1">' + "".join(_cell(f"{column_name(i)}1", c, 1) for i, c in enumerate(df.columns)) + "</row>").encode())
                for row, values in enumerate(df.toLocalIterator(), 2):
                    if row > MOST_ROWS:
                        raise ValueError(f"{name} has more than {MOST_ROWS - 1} rows")
                    out.write((f'<row r="{row}">' + "".join(_cell(f"{column_name(i)}{row}", v, 2) for i, v in enumerate(values)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{kind}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        links += f'<Relationship Id="rIdS" Type="{kind}/styles" Target="styles.xml"/>'
        package = "http://schemas.openxmlformats.org/package/2006"
        archive.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        archive.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        archive.writestr("xl/styles.xml", _STYLES.replace("{fill}", fill))
        spreadsheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{spreadsheet}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{spreadsheet}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{spreadsheet}.styles+xml"/>{parts}</Types>',
        )
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
