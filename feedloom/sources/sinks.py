"""Exports and reports; data sinks are parallel writers, reports are made on the driver from one row a field or fault."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.operators import stats
from feedloom.operators.predicates import select
from feedloom.plans.tables import in_order, written
from feedloom.sources import sheets, xml_scan
from feedloom.sources.files import Part, whole_file

#: Headers of the columns that are no paths.
HEADERS = {"id": "Record ID", "raw_content": "Raw XML/JSON Content"}


def labelled(df: DataFrame) -> DataFrame:
    """Columns under the headers of an export: paths as they are, every column once."""
    return df.withColumnsRenamed(HEADERS)


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema])


def _lines(parts: Iterator[Part], file: pa.NativeFile) -> None:
    """Texts and the rows (value) of batches, each on lines of its own; null is an empty one."""
    for part in parts:
        if isinstance(part, str):
            file.write(f"{part}\n".encode())
        else:
            values = pc.fill_null(part.column("value"), "")
            file.write(pc.binary_join(pa.LargeListArray.from_arrays([0, len(values)], values), "\n")[0].as_buffer())
            file.write(b"\n")


def one_file(parts: list[DataFrame | str], path: str) -> None:
    """Texts and the rows (value) of DataFrames, one after another and each on lines of its own, as the one file ``path``.

    All work before is distributed; one task writes the rows in their order, a batch at a time and without a sort, under another name.
    The file appears under its own when it is whole: after a failure there is none. An existing file is an error.
    """
    spark = next(p for p in parts if isinstance(p, DataFrame)).sparkSession
    whole_file(spark, path, [p if isinstance(p, str) else p.select("value") for p in parts], _lines)


def _framed(before: str, lines: DataFrame, after: str, path: str, as_file: bool = False) -> None:
    """Text parts that make up one document in name order: an opening, the lines (value), a closing; or all in one file."""
    if as_file:
        one_file([before, lines, after], path)
        return
    frame = lambda text: lines.sparkSession.createDataFrame([(text,)], "value string")
    frame(before).write.text(f"{path}/0-open")
    lines.write.text(f"{path}/1-records")
    frame(after).write.text(f"{path}/2-close")


def _items(parts: Iterator[Part]) -> Iterator[Part]:
    """Parts whose rows begin with a comma, the first row that is not null without it."""
    first = True
    for part in parts:
        if first and not isinstance(part, str) and (values := part.column("value")).null_count < len(values):
            first, i = False, pc.index(values.is_valid(), True).as_py()
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([values[:i], pa.array([values[i].as_py()[1:]], values.type), values[i + 1 :]])], names=["value"])
        yield part


def json_array(values: DataFrame, path: str, as_file: bool = False) -> None:
    """The JSON texts (value) as items of one array, in the order of the rows, as parts that make it up in name order or one file."""
    if as_file:  # the task that joins the rows knows the first one
        whole_file(values.sparkSession, path, ["[", values.select(F.concat(F.lit(","), "value").alias("value")), "]"], lambda parts, file: _lines(_items(parts), file))
        return
    held = written(values.select("value", F.monotonically_increasing_id().alias("n")), "json-array")
    first = held.agg(F.min("n")).first()[0]
    lines = held.orderBy("n").select(F.concat(F.when(F.col("n") == F.lit(first), "").otherwise(","), "value").alias("value"))
    _framed("[", lines, "]", path)


def export(df: DataFrame, path: str, fmt: str, as_file: bool = False) -> None:
    """All rows as csv (UTF-8 with a byte order mark in each part), json (one array), json-lines, parquet or xlsx (one file).

    csv and json can be one file, which has one byte order mark and header, or is one document.
    """
    if fmt == "xlsx":
        sheets.export_sheet(df, path)
        return
    if as_file and fmt not in ("csv", "json"):
        raise ValueError(f"no single file as {fmt!r}")
    if fmt == "csv" and as_file:
        flat = _text(df)
        quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        cell = lambda c: F.coalesce(F.when(c.rlike('[,"\\r\\n]|^$|^\\s|\\s$'), quoted(c)).otherwise(c), F.lit(""))
        line = F.concat_ws(",", *[cell(F.col(f"`{c}`").cast("string")) for c in flat.columns])
        head = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in flat.columns)
        one_file([head, flat.select(line.alias("value"))], path)
    elif fmt == "csv":
        flat = _text(df)
        flat.toDF(*["\ufeff" * (i == 0) + c for i, c in enumerate(flat.columns)]).write.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        json_array(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")), path, as_file)
    elif fmt == "json-lines":
        df.write.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no export as {fmt!r}")


def export_analysis(df: DataFrame, paths: list[str], what: str, fmt: str, out: str, field: str | None = None, **spec) -> None:
    """Export ``query`` (rows that filters and a search keep), ``stats`` (one row a field) or ``duplicates`` (of ``field``).

    As csv, json or xlsx; stats also as html. Every other combination is an error.
    """
    if what == "query" and fmt in ("csv", "json", "xlsx"):
        export(labelled(select(df, paths, **spec)), out, fmt)
    elif what == "stats" and fmt in ("csv", "json", "xlsx"):
        export(stats.all_field_stats(df, paths).orderBy("field_idx"), out, fmt)
    elif what == "stats" and fmt == "html":
        rows = stats.all_field_stats(df, paths).orderBy("field_idx")
        df.sparkSession.createDataFrame([(html_report("Field statistics", stats.summary(df, paths).first().asDict(), rows),)], "value string").coalesce(1).write.text(out)
    elif what == "duplicates" and fmt in ("csv", "json"):
        if not field:
            raise ValueError("duplicates need a field")
        export(stats.duplicate_values(df, field), out, fmt)
    else:
        raise ValueError(f"no export of {what!r} as {fmt!r}")


def merged_xml(records: DataFrame, path: str, root: str = "source", as_file: bool = False) -> None:
    """The raw records in order, as they are, as text parts between an opening and a closing part, or in one file."""
    rows = in_order(records, "source_idx", "rec_idx") if as_file else records.orderBy("source_idx", "rec_idx")
    _framed(f'<?xml version="1.0" encoding="utf-8"?>\n<{root}>', rows.select(F.col("raw").alias("value")), f"</{root}>", path, as_file)


@F.pandas_udf(StringType())
def direct_children(raw: pd.Series) -> pd.Series:
    """A raw record as a JSON object: of XML the direct children's text, the last of a name; JSON as it is."""

    def one(text: str | None) -> str | None:
        if not text or text.lstrip()[:1] != "<":
            return text
        return json.dumps({c.name: c.all_text().strip() for c in xml_scan.parsed(text.encode()).children}, ensure_ascii=False)

    return raw.map(one)


def merged_json(records: DataFrame, path: str, as_file: bool = False) -> None:
    """The direct children of each record as an object of one JSON array."""
    rows = in_order(records, "source_idx", "rec_idx") if as_file else records.orderBy("source_idx", "rec_idx")
    json_array(rows.select(direct_children("raw").alias("value")), path, as_file)


def writer_for(name: str):
    """The writer of a merged feed, by the suffix of its name."""
    return merged_json if name.lower().endswith(".json") else merged_xml


def _cells(values, tag: str) -> str:
    return "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values)


def _html_frame(title: str, totals: dict[str, object], columns: list[str]) -> tuple[str, str]:
    """What comes before and after the lines of a page with totals and a table."""
    head = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in totals.items())
    before = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{head}</ul><table><tr>{_cells(columns, 'th')}</tr>"
    return before, "</table></body></html>"


def html_lines(rows: DataFrame) -> DataFrame:
    """A line (value) of a table for each row, in their order."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        for char, name_ in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(char), F.lit(name_))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    return rows.select(F.concat(F.lit("<tr>"), *[cell(c) for c in rows.columns], F.lit("</tr>")).alias("value"))


def html_report(title: str, totals: dict[str, object], rows: DataFrame) -> str:
    """A page with totals and one line for each row of a report that has a row a field."""
    before, after = _html_frame(title, totals, rows.columns)
    return before + "".join(r["value"] for r in html_lines(rows).toLocalIterator()) + after


def error_lines(errors: DataFrame) -> DataFrame:
    """One tab-separated line for each error."""
    return errors.select(F.concat_ws("\t", "error_number", "severity", "line", "column", "category", "message").alias("value"))


#: Columns of the list of errors, and their headers.
ERROR_HEADERS = {"error_number": "Error#", "severity": "Severity", "line": "Line", "column": "Column", "byte_offset": "ByteOffset", "category": "Category", "message": "Message"}


def sorted_errors(errors: DataFrame, by: str = "error_number", descending: bool = False) -> DataFrame:
    """Errors by one of the columns of the list; messages without case, ties by number."""
    if by not in ERROR_HEADERS:
        raise ValueError(f"errors have no column {by!r}")
    key: Column = F.lower(by) if by == "message" else F.col(by)
    return errors.orderBy(key.desc() if descending else key.asc(), "path", "error_number")


def _text_report(info: DataFrame, errors: DataFrame) -> DataFrame:
    """The lines (value) of a report in order: files and a summary, which are few, then the errors with their context."""
    rule = "=" * 72
    head = [rule, "  Validation report", rule, "", "FILE INFORMATION"]
    for row in info.orderBy("path").toLocalIterator():
        head += [*(f"  {k.replace('_', ' ').capitalize():<15}: {'—' if v is None else v}" for k, v in row.asDict().items()), ""]
    head.append("SUMMARY")
    head += [f"  {r['severity']} / {r['category']}: {r['n']}" for r in errors.groupBy("severity", "category").agg(F.count("*").alias("n")).orderBy("severity", "category").collect()]
    head += ["", "ERRORS"]
    first = errors.sparkSession.createDataFrame([(0, i, 0, x) for i, x in enumerate(head)], "k int, n long, i int, value string")
    said = F.format_string("  #%d [%s] %s at line %d, column %d: %s", "error_number", "severity", "category", "line", "column", "message")
    shown = F.transform(F.coalesce("context_lines", F.array().cast(errors.schema["context_lines"].dataType)), lambda c: F.format_string("    %s %6d | %s", F.when(c["is_error_line"], ">").otherwise(" "), c["line_number"], c["text"]))
    lines = sorted_errors(errors).select(F.monotonically_increasing_id().alias("n"), F.posexplode(F.concat(F.array(said), shown)).alias("i", "value"))
    return first.union(lines.select(F.lit(1).alias("k"), "n", "i", "value")).orderBy("k", "n", "i").select("value")


def validation_report(info: DataFrame, errors: DataFrame, path: str, fmt: str) -> None:
    """A report of ``file_info`` and ``validate`` rows under ``path``, as csv, json, html or txt."""
    listed = sorted_errors(errors).select(*[F.col(c).alias(h) for c, h in ERROR_HEADERS.items()])
    if fmt == "csv":
        export(listed, path, "csv")
    elif fmt == "json":
        held = errors.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*[c for c in errors.columns if c != "path"]))).alias("errors"))
        whole = info.join(held, "path", "left").withColumn("errors", F.coalesce("errors", F.array().cast(held.schema["errors"].dataType))).withColumn("error_count", F.size("errors"))
        export(whole.orderBy("path"), path, "json")
    elif fmt == "html":
        totals = {r["severity"]: r["n"] for r in errors.groupBy("severity").agg(F.count("*").alias("n")).collect()}
        totals = {"Files": info.count(), "Errors": sum(totals.values())} | totals
        before, after = _html_frame("Validation report", totals, listed.columns)
        _framed(before, html_lines(listed), after, path)
    elif fmt == "txt":
        _text_report(info, errors).write.text(path)
    else:
        raise ValueError(f"no report as {fmt!r}")


def output_preview(path_text: DataFrame, lines: int = 100) -> list[str]:
    """The first lines of a written feed (value), in the order of its parts."""
    return [r["value"] for r in path_text.limit(lines).collect()]
