"""Spreadsheets (.xlsx): export of a DataFrame, sheet names, rows and preview of a sheet.

Export: each row becomes its XML in column expressions, in parallel; one task joins the rows in order into the zip, as a stream,
and begins another sheet where one is full. The file appears under its name when it is whole. Reading: one task a sheet, which
streams its rows; the file's table of shared strings and nothing else is held.

Cells are read as text: numbers without a fraction as whole ones, dates as ``%Y-%m-%d %H:%M:%S``, what means "not available" as
null. Paths are what pyarrow's file systems and Hadoop both open, such as a shared folder or an hdfs address.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans.tables import written
from feedloom.sources.files import opened, whole_file

#: Limits of the format.
MOST_ROWS, MOST_COLUMNS, LONGEST = 1_048_576, 16_384, 32_767
#: Texts that count as not available.
NOT_AVAILABLE = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])

#: Rows that are written at a time.
_AT_ONCE = 1000

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Cell formats: 0 general, 1 date, 2 date and time.
_STYLES = f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def _escaped(text: Column) -> Column:
    """Text as XML; characters that XML has no form for, and what looks like their escape, as _xHHHH_."""
    text = F.regexp_replace(text, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    for c in (*range(9), 11, 12, *range(13, 32), 0xFFFE, 0xFFFF):
        text = F.replace(text, F.lit(chr(c)), F.lit(f"_x{c:04X}_"))
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def _text_cell(text: Column) -> Column:
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(F.substring(text, 1, LONGEST)), F.lit("</t></is></c>"))


def _cell(value: Column, kind: str) -> Column:
    """A cell of a column of Spark type ``kind``; null is an empty one. Dates before March 1900 and values that are no number are text."""
    text = value.cast("string")
    if kind in ("array", "struct", "map", "variant"):
        cell = _text_cell(F.to_json(value))
    elif kind == "boolean":
        cell = F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        since = F.timestamp_diff("MICROSECOND", F.lit("1899-12-30").cast("timestamp_ntz"), value.cast("timestamp_ntz"))
        serial = F.concat(F.lit(f'<c s="{1 if kind == "date" else 2}"><v>'), (since / F.lit(86_400_000_000)).cast("decimal(20,10)").cast("string"), F.lit("</v></c>"))
        cell = F.when(value >= F.lit("1900-03-01").cast(kind), serial).otherwise(_text_cell(text))
    elif kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        number = F.concat(F.lit("<c><v>"), text, F.lit("</v></c>"))
        cell = number if kind not in ("float", "double") else F.when(text.isin("NaN", "Infinity", "-Infinity"), "<c/>").otherwise(number)
    else:
        cell = _text_cell(text)
    return F.coalesce(cell, F.lit("<c/>"))


def _sheets(batches: Iterator[pa.RecordBatch], file, head: str, title: str, most: int) -> int:
    """Write the rows (value) into a workbook, as many sheets as ``most`` rows each ask for; returns how many."""
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as book:
        sheet, left, number = None, 0, 0

        def begin():
            opened = book.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True)
            opened.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>{head}'.encode())
            return opened

        def end() -> None:
            sheet.write(b"</sheetData></worksheet>")
            sheet.close()

        for batch in batches:
            rows, at = batch.column("value").to_pylist(), 0
            while at < len(rows):
                if not left:
                    if sheet:
                        end()
                    number, left = number + 1, most - 1
                    sheet = begin()
                own = rows[at : at + min(left, _AT_ONCE)]
                sheet.write("".join(own).encode())
                left, at = left - len(own), at + len(own)
        if not sheet:
            number = 1
            sheet = begin()
        end()
        names = [title if i == 1 else f"{title[:25]} {i}" for i in range(1, number + 1)]
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        links = [("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, number + 1)] + [("styles", "styles.xml")]
        book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(links, 1)) + "</Relationships>")
        book.writestr("xl/styles.xml", _STYLES)
        book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = [("xl/workbook.xml", "sheet.main"), ("xl/styles.xml", "styles"), *((f"xl/worksheets/sheet{i}.xml", "worksheet") for i in range(1, number + 1))]
        book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{p}" ContentType="{kind}.{k}+xml"/>' for p, k in parts) + "</Types>")
    return number


def export_sheet(df: DataFrame, path: str, title: str = "Sheet1", most: int = MOST_ROWS) -> None:
    """All rows of ``df``, under its column names, as the workbook ``path``; over ``most`` rows, the names included, go on in a next sheet.

    Texts end at the format's 32,767 characters; over 16,384 columns, or an existing file, is an error. After a failure there is no file.
    """
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"a sheet has at most {MOST_COLUMNS} columns")
    if most < 2:
        raise ValueError("a sheet has at least two rows")
    spark = df.sparkSession
    fields = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [_cell(F.col(f"c{i}"), "decimal" if f.dataType.typeName().startswith("decimal") else f.dataType.typeName()) for i, f in enumerate(df.schema)]
    rows = fields.select(F.concat(F.lit("<row>"), *cells, F.lit("</row>")).alias("value"))
    names = spark.range(1).select(F.concat(F.lit("<row>"), *[_text_cell(F.lit(c)) for c in df.columns], F.lit("</row>")).alias("value")).first()[0]
    whole_file(spark, path, [rows], lambda batches, file: _sheets(batches, file, names, title, most))


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _plain(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _said(element: ElementTree.Element) -> str:
    """Text of a string: of all its runs, without what tells how to say it."""
    return _plain("".join(t.text or "" for part in element if _name(part.tag) != "rPh" for t in ([part] if _name(part.tag) == "t" else part) if _name(t.tag) == "t"))


def _ended(book: zipfile.ZipFile, member: str, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what came before them is let go."""
    with book.open(member) as file:
        around: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(file, ("start", "end")):
            if event == "start":
                around.append(element)
                continue
            around.pop()
            if _name(element.tag) == name:
                yield element
                if around:
                    around[-1].clear()


def _members(book: zipfile.ZipFile) -> tuple[dict[str, str], dict[str, str], datetime]:
    """Member of each sheet by its name, of other parts by their kind, and the day that dates count from."""
    links = {e.get("Id"): (posixpath.basename(e.get("Type")), e.get("Target")) for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    whole = {k: (kind, to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"xl/{to}")) for k, (kind, to) in links.items()}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = {e.get("name"): whole[e.get(f"{{{_LINKS}}}id")][1] for e in root.iter() if _name(e.tag) == "sheet"}
    late = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    return sheets, dict(whole.values()), datetime(1904, 1, 1) if late else datetime(1899, 12, 30)


def _dates(book: zipfile.ZipFile, member: str | None) -> set[int]:
    """Places of the cell formats that show dates."""
    if member is None or member not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read(member))
    shown = lambda code: bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code.lower())))
    own = {int(e.get("numFmtId")) for e in root.iter() if _name(e.tag) == "numFmt" and shown(e.get("formatCode") or "")}
    formats = next((e for e in root if _name(e.tag) == "cellXfs"), ())
    return {i for i, e in enumerate(formats) if int(e.get("numFmtId") or 0) in DATE_FORMATS | own}


def _place(reference: str | None, after: int) -> int:
    """Column of a cell, from 0; without a reference the next one."""
    letters = re.match("[A-Z]+", reference or "")
    if not letters:
        return after
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _rows(file, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a sheet (None: the first) as texts."""
    with zipfile.ZipFile(file) as book:
        sheets, others, first_day = _members(book)
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}")
        strings = [_said(e) for e in _ended(book, others["sharedStrings"], "si")] if others.get("sharedStrings") in book.namelist() else []
        dates = _dates(book, others.get("styles"))

        def value(cell: ElementTree.Element) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                text = "".join(_said(e) for e in cell if _name(e.tag) == "is")
            else:
                text = next((e.text for e in cell if _name(e.tag) == "v"), None)
            if text is None:
                return None
            if kind == "s":
                text = strings[int(text)]
            elif kind == "b":
                return "True" if text.strip() in ("1", "true") else "False"
            elif kind == "n":
                number = float(text)
                if int(cell.get("s") or 0) in dates:
                    return (first_day + timedelta(seconds=round(number * 86_400))).strftime("%Y-%m-%d %H:%M:%S")
                return text.strip() if re.fullmatch(r"\s*-?\d+\s*", text) else str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
            elif kind == "d":
                return datetime.fromisoformat(text.replace("Z", "")).strftime("%Y-%m-%d %H:%M:%S")
            elif kind == "str":
                text = _plain(text)
            return None if text in NOT_AVAILABLE else text

        at = 0
        for row in _ended(book, sheets[sheet] if sheet is not None else next(iter(sheets.values())), "row"):
            number = int(row.get("r") or at + 1)
            while at + 1 < number:  # rows that the file leaves out are empty
                yield []
                at += 1
            cells: list[str | None] = []
            for cell in row:
                k = _place(cell.get("r"), len(cells))
                cells += [None] * (k + 1 - len(cells))
                cells[k] = value(cell)
            yield cells
            at += 1


def _task(spark: SparkSession, path: str, run, fields: str) -> DataFrame:
    """What ``run`` makes of the opened file, in one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                yield from run(file)

    return spark.range(0, 1, 1, 1).mapInArrow(read, fields)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the sheets of a workbook, in order."""

    def run(file) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(file) as book:
            yield pa.RecordBatch.from_pydict({"name": list(_members(book)[0])})

    return [r["name"] for r in _task(spark, path, run, "name string").collect()]


def _names(row: list[str | None]) -> list[str]:
    """Names of the columns, from the first row: blank ones by their place, repeated ones numbered."""
    names: list[str] = []
    for i, name in enumerate(row):
        name, k = f"Unnamed: {i}" if name is None else name, 0
        unique = name
        while unique in names:
            k += 1
            unique = f"{name}.{k}"
        names.append(unique)
    return names


def _header(spark: SparkSession, path: str, sheet: str | None) -> list[str]:
    """Names of the columns of a sheet."""

    def run(file) -> Iterator[pa.RecordBatch]:
        for row in _rows(file, sheet):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.string()))], names=["cells"])
            return

    found = _task(spark, path, run, "cells array<string>").collect()
    return _names(found[0]["cells"]) if found else []


def _blocks(file, sheet: str | None, width: int, most: int | None, names: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """row_idx (from 0, below the names) and cells of the rows, at most ``most``; other names than those asked for are an error."""

    def batch(rows: list[tuple[int, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([(r + [None] * width)[:width] for _, r in rows], pa.list_(pa.string()))], names=["row_idx", "cells"])

    held: list[tuple[int, list]] = []
    for i, row in enumerate(_rows(file, sheet), -1):
        if most is not None and i >= most:
            break
        if i >= 0:
            held.append((i, row))
        elif names is not None and _names(row) != names:
            raise ValueError(f"sheet {sheet!r} has other columns than the first one")
        if len(held) == 1000:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _cells(spark: SparkSession, path: str, sheet: str | None, width: int, most: int | None) -> DataFrame:
    """row_idx (from 0, below the names) and cells of the rows, at most ``most``."""
    return _task(spark, path, lambda file: _blocks(file, sheet, width, most), "row_idx long, cells array<string>")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """row_idx (from 0) and a text column for each name in the first row of a sheet, the first one if none is named."""
    names = _header(spark, path, sheet)
    rows = _cells(spark, path, sheet, len(names), None)
    return rows.select("row_idx", *[F.col("cells")[i] for i in range(len(names))]).toDF("row_idx", *names)


def read_sheets(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """What ``read_sheet`` gives, of a table that goes on from sheet to sheet (all of them, or those named, in order): a task for each.

    Every sheet begins with the same names, else it is an error; row_idx goes on from one to the next.
    """
    listed = sheets or sheet_names(spark, path)
    names = _header(spark, path, listed[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                system, inner = opened(path)
                with system.open_input_file(inner) as file:
                    for found in _blocks(file, listed[k], len(names), None, names):
                        yield found.append_column("sheet", pa.array([k] * found.num_rows, pa.int32()))

    rows = written(spark.range(0, len(listed), 1, len(listed)).mapInArrow(run, "row_idx long, cells array<string>, sheet int"), "sheet-rows")
    counts = {r["sheet"]: r["n"] for r in rows.groupBy("sheet").agg(F.count("*").alias("n")).collect()}  # one number a sheet
    before = [(k, sum(counts.get(j, 0) for j in range(k))) for k in range(len(listed))]
    placed = rows.join(F.broadcast(spark.createDataFrame(before, "sheet int, before long")), "sheet")
    return placed.select((F.col("row_idx") + F.col("before")).alias("row_idx"), *[F.col("cells")[i] for i in range(len(names))]).toDF("row_idx", *names)


def sheet_preview(spark: SparkSession, path: str, sheet: str | None = None, rows: int = 100) -> tuple[list[dict[str, str]], DataFrame]:
    """Columns (headerName, field) of a sheet, and its first rows with fields col_0, col_1 and so on; no more rows are read."""
    names = _header(spark, path, sheet)
    found = _cells(spark, path, sheet, len(names), rows)
    return [{"headerName": n, "field": f"col_{i}"} for i, n in enumerate(names)], found.select("row_idx", *[F.col("cells")[i].alias(f"col_{i}") for i in range(len(names))])
