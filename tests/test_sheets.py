"""Workbooks: round trips of all types, several sheets, other writers' files, previews, failures."""

import zipfile
from datetime import date, datetime

import duckdb
import pytest

from feedloom.plans import catalogue
from feedloom.sources import sheets, sinks

SF = "/root/testdata/sf0.001"


def test_types_come_back(spark, tmp_path):
    kinds = "n long, x double, ok boolean, day date, at timestamp, t string, many array<int>, d decimal(9,2), none void"
    rows = [
        (1, 1.5, True, date(2024, 2, 29), datetime(2024, 2, 29, 23, 59, 58), " <a> & 'b'\n ", [1, 2], None, None),
        (2**60, 2.0, False, date(1850, 1, 2), datetime(1999, 12, 31), "\x07_x0007_ é😀", [], None, None),
        (None, float("nan"), None, None, None, "", None, None, None),
        (-3, 1e300, None, None, None, "N/A", None, None, None),
    ]
    sheets.export_sheet(spark.createDataFrame(rows, kinds).coalesce(1), f"{tmp_path}/new/a.xlsx")
    got = [tuple(r) for r in sheets.read_sheet(spark, f"{tmp_path}/new/a.xlsx").collect()]
    assert got[0] == (0, "1", "1.5", "True", "2024-02-29 00:00:00", "2024-02-29 23:59:58", " <a> & 'b'\n ", "[1,2]", None, None)
    assert got[1] == (1, str(2**60), "2", "False", "1850-01-02", "1999-12-31 00:00:00", "\x07_x0007_ é😀", "[]", None, None)
    assert got[2] == (2, *[None] * 9) and got[3][:3] == (3, "-3", "1e+300") and got[3][6] is None
    assert [p.name for p in (tmp_path / "new").iterdir() if not p.name.startswith(".")] == ["a.xlsx"]
    with pytest.raises(FileExistsError):
        sheets.export_sheet(spark.range(1), f"{tmp_path}/new/a.xlsx")


def test_full_sheets_go_on_in_the_next(spark, tmp_path):
    path = f"{tmp_path}/many.xlsx"
    sheets.export_sheet(spark.range(0, 250, 1, 5), path, "Rows & more", most=101)
    names = sheets.sheet_names(spark, path)
    assert names == ["Rows & more", "Rows & more 2", "Rows & more 3"]
    assert [int(r["id"]) for n in names for r in sheets.read_sheet(spark, path, n).orderBy("row_idx").collect()] == list(range(250))
    sinks.export(spark.range(0), f"{tmp_path}/empty.xlsx", "xlsx")
    assert sheets.read_sheet(spark, f"{tmp_path}/empty.xlsx").columns == ["row_idx", "id"] and sheets.read_sheet(spark, f"{tmp_path}/empty.xlsx").count() == 0
    columns, shown = sheets.sheet_preview(spark, path, rows=3)
    assert columns == [{"headerName": "id", "field": "col_0"}] and [tuple(r) for r in shown.collect()] == [(0, "0"), (1, "1"), (2, "2")]


def test_all_sheets_are_read_as_one_table(spark, tmp_path):
    path = f"{tmp_path}/many.xlsx"
    sheets.export_sheet(spark.range(0, 2500, 1, 7).selectExpr("id", "id * 2 AS twice"), path, most=1202)
    assert [tuple(r) for r in sheets.read_sheets(spark, path).orderBy("row_idx").collect()] == [(i, str(i), str(2 * i)) for i in range(2500)]
    later = sheets.read_sheets(spark, path, ["Sheet1 2", "Sheet1 3"]).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["id"]) for r in later] == [(i, str(i + 1201)) for i in range(1299)]
    with zipfile.ZipFile(path) as book, zipfile.ZipFile(f"{tmp_path}/other.xlsx", "w") as other:
        for name in book.namelist():
            other.writestr(name, book.read(name).replace(b">twice<", b">thrice<") if name.endswith("sheet3.xml") else book.read(name))
    with pytest.raises(Exception, match="other columns"):
        sheets.read_sheets(spark, f"{tmp_path}/other.xlsx").collect()


def test_round_trip_of_more_rows_than_a_sheet_has(spark, monkeypatch):
    """The query on more orders than fit one sheet."""
    monkeypatch.setattr(sheets.export_sheet, "__defaults__", ("Sheet1", 401))
    found = catalogue.QUERIES["sheet_round_trip"](spark, SF)
    assert found.agg({"row_idx": "max"}).first()[0] == spark.read.parquet(f"{SF}/orders.parquet").count() - 1 > 800


def test_shared_strings_gaps_and_dates(spark, tmp_path):
    """What other programs write: shared and formatted strings, cells and rows left out, own date formats, the later first day."""
    main, links = sheets._MAIN, sheets._LINKS
    with zipfile.ZipFile(f"{tmp_path}/o.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><workbookPr date1904="1"/><sheets><sheet name="A" sheetId="1" r:id="x"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="x" Type="{links}/worksheet" Target="/xl/worksheets/s.xml"/><Relationship Id="y" Type="{links}/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="z" Type="{links}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="3"><c r="C3" t="s"><v>1</v></c></row><row r="4"><c r="A4" s="1"><v>1.5</v></c><c s="2"><v>2.50</v></c><c t="e"><v>#DIV/0!</v></c></row></sheetData></worksheet>')
    got = sheets.read_sheet(spark, f"{tmp_path}/o.xlsx")
    assert got.columns == ["row_idx", "name", "Unnamed: 1", "name.1"]
    assert [tuple(r) for r in got.collect()] == [(0, None, None, None), (1, None, None, "two runs"), (2, "1904-01-02 12:00:00", "2.5", "#DIV/0!")]
    with pytest.raises(Exception, match="no sheet 'B'"):
        sheets.read_sheet(spark, f"{tmp_path}/o.xlsx", "B")


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="broken"):
        sheets.export_sheet(spark.range(9).selectExpr("if(id = 7, raise_error('broken'), id) AS id"), f"{tmp_path}/f/x.xlsx")
    assert not [p for p in (tmp_path / "f").iterdir() if not p.name.startswith(".")]


@pytest.mark.parametrize("name", ["sheet_round_trip", "sheet_preview"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name]).to_arrow_table()
    assert found.columns == want.column_names
    assert sorted(map(tuple, found.collect())) == sorted(zip(*want.to_pydict().values(), strict=True))
