"""Well-formedness of many files at once: one row for each fault, with category, severity, place and context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.xml_faults import xml_faults
from feedloom.plans.tables import written
from feedloom.sources import json_scan
from feedloom.sources.feeds import encoding, files_of, head, json_by_name_or_start, sniff
from feedloom.sources.ranges import loaded
from feedloom.sources.scan import chunked, found_in

def json_faults(data: bytes) -> list[tuple[int, int, str]]:
    """(line, column, message) of the first fault of a JSON document."""
    fault = json_scan.first_fault(data)
    return [fault] if fault else []


def category(message: Column, kind: Column) -> Column:
    """The category that a message falls into."""
    low = F.lower(message)
    has = lambda *words: F.greatest(*[low.contains(w) for w in words], F.lit(False))
    as_json = F.when(has("bracket", "brace", "structure"), "Tag Mismatch").when(has("unclosed string"), "Unexpected EOF").when(has("comma", "duplicate"), "Invalid Attribute").otherwise("Malformed XML")
    as_json = F.when(low.startswith("expected ','"), "Malformed XML").otherwise(as_json)
    # What a message holds, in the order in which it is looked for.
    said = lambda *words: F.greatest(*[message.contains(w) for w in words], F.lit(False))
    as_xml = (
        F.when(said("tag mismatch", "Opening and ending"), "Tag Mismatch")
        .when(has("encoding") | said("UTF"), "Invalid Encoding")
        .when(said("Entity", "entity"), "Invalid Entity")
        .when(said("CDATA", "CData"), "Malformed CDATA")
        .when(said("EOF", "Premature end", "Extra content at the end", "Document is empty"), "Unexpected EOF")
        .when(said("XML declaration") & said("allowed only"), "Duplicate Declaration")
        .when(said("Namespace", "namespace"), "Namespace Error")
        .when(said("xmlChar") | has("invalid character", "illegal"), "Illegal Character")
        .when(has("attribute"), "Invalid Attribute")
        .otherwise("Malformed XML")
    )
    as_xml = F.when(said("does not exist", "not a regular file", "Cannot read"), "Other").otherwise(as_xml)
    return F.when(kind == "json", as_json).otherwise(as_xml)


#: What a message says about its tag, as patterns with the tag in a group.
_TAGS = (
    r"Tag\s+(\S+)\s+was not closed",
    r"Entity\s+'([^']+)'",
    r"(?i)undefined entity\s+&([^;]+);",
    r"Attribute\s+(\S+)\s+redefined",
    r"(?i)namespace prefix[:\s]+['\"]?([\w]+)['\"]?",
    r"(?:xmlChar|Char)\s+0x([0-9A-Fa-f]+)",
)
_MISMATCH = r"Opening and ending tag mismatch:\s+(\S+)\s+line\s+(\d+)\s+and\s+(\S+)"
#: Bytes at the start of a file that have no line break if it is minified, and around a fault of such a file.
_MINIFIED, _AROUND = 2048, 500


def tag_name(message: Column) -> Column:
    """The tag that a message is about: of a mismatch the closing one."""
    found = [F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in _TAGS]
    found[-1] = F.concat(F.lit("U+"), F.upper(found[-1]))
    return F.coalesce(F.nullif(F.regexp_extract(message, _MISMATCH, 3), F.lit("")), *found)


def reference_tag(message: Column) -> Column:
    """The opening tag of a mismatch."""
    return F.nullif(F.regexp_extract(message, _MISMATCH, 1), F.lit(""))


def reference_line(message: Column) -> Column:
    """The line of the opening tag of a mismatch."""
    return F.regexp_extract(message, _MISMATCH, 2).try_cast("int")


def severity(message: Column, kind: Column) -> Column:
    """Fatal where the document is not well-formed, Error for namespaces, Warning for what is only doubtful."""
    return F.when((kind == "xml") & message.contains("is not absolute"), "Warning").when((kind == "xml") & message.contains("Namespace"), "Error").otherwise("Fatal")


def byte_offset(line: Column, size: Column, lines: Column) -> Column:
    """Where a line begins in a file of so many bytes and lines, if all were as long."""
    return F.when(lines > 0, F.floor((line - 1) * (size / lines))).otherwise(0).cast("long")


def _minified(start: bytes) -> bool:
    return len(start) >= _MINIFIED and b"\n" not in start[:_MINIFIED]


def _around(data: bytes) -> list[dict]:
    """What lies around a fault in a file without line breaks, cut between tags and objects."""
    shown = re.sub(r"(?<=>)(?=<)|(?<=\},)", "\n", data.decode("utf-8", "replace")).splitlines()
    return [{"line_number": k + 1, "text": x, "is_error_line": k == len(shown) // 2} for k, x in enumerate(shown)]


def _context(data: bytes, breaks: list[int], at: int, offset: int, context: int) -> list[dict]:
    """The lines around line ``at``, by the places of line breaks."""
    if _minified(data):
        start = max(0, offset - _AROUND)
        return _around(data[start : start + 2 * _AROUND])
    out = []
    many = len(breaks) + (not data.endswith(b"\n"))
    for k in range(max(0, at - 1 - context), min(many, at + context)):
        begin, end = breaks[k - 1] + 1 if k else 0, breaks[k] if k < len(breaks) else len(data)
        out.append({"line_number": k + 1, "text": data[begin:end].decode("utf-8", "replace").rstrip("\r"), "is_error_line": k + 1 == at})
    return out


_FIELDS = "path string, kind string, n int, line int, column int, size long, lines long, message string, context_lines array<struct<line_number:int,text:string,is_error_line:boolean>>"


#: Faults that a task returns at a time, and bytes of their context after which it does so earlier.
_ROWS, _BYTES = 2000, 4 << 20
_MISMATCHED = re.compile(_MISMATCH, re.ASCII)


def _kept(faults: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The faults of a document without the mismatches that lie inside the last kept one, from which they only follow."""
    begun = ended = None
    out = []
    for line, column, message in faults:
        m = _MISMATCHED.search(message)
        if m:
            if begun is not None and int(m[2]) < begun and line >= ended:
                continue
            begun, ended = int(m[2]), line
        out.append((line, column, message))
    return out


def _faults(context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, kind, data in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "content")), strict=True):
                faults = json_faults(data) if kind == "json" else _kept(xml_faults(data))
                if not faults:
                    continue
                breaks = [m.start() for m in re.finditer(b"\n", data)]
                many = max(1, len(breaks))
                for i, (a, b, m) in enumerate(faults):
                    shown = _context(data, breaks, a, int((a - 1) * (len(data) / many)), context)
                    rows.append((path, kind, i, a, b, len(data), many, m, shown))
                    size += sum(len(x["text"]) for x in shown)
                    if len(rows) >= _ROWS or size >= _BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _fields_schema()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _contents(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, content, kind) of files; the reader leaves out those without content."""
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    if not files:
        return listed.select("path", F.lit(b"").alias("content"), F.lit("xml").alias("kind"))
    held = spark.read.format("binaryFile").load(files).select("path", "content")
    empty = listed.join(held.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
    return held.union(empty).withColumn("kind", sniff(F.col("path"), F.col("content")))


def _json_files(spark: SparkSession, files: list[str], heads: list[bytes], context: int) -> DataFrame:
    """The first fault of each JSON file, if it has one, with its context: files of any size, in chunks.

    Keys of an object that spans chunks meet in a grouping by object and key; the second place of a key is the fault.
    """
    chunks = chunked(spark, files, heads, "json")
    found = found_in(chunks, "json", None)
    place = [F.col(c).alias(c) for c in ("line", "column")]
    keys = found.where("what = 'key'").select("doc", "scope", "raw", F.struct("number", "offset", *place).alias("at"))
    first = keys.groupBy("doc", "scope", "raw").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    name = F.concat(F.lit("Duplicate object key '"), F.col("raw").cast("string"), F.lit("'"))
    again = keys.join(first, ["doc", "scope", "raw"]).where("at > first").select("doc", F.struct("at.number", F.lit(0).alias("k"), "at.offset", "at.line", "at.column", name.alias("message")).alias("f"))
    said = found.where("what = 'fault'").select("doc", F.struct("number", F.lit(1).alias("k"), "offset", *place, F.col("raw").cast("string").alias("message")).alias("f"))
    sizes = found.where("what = 'chunk'").groupBy("doc").agg(F.sum("offset").alias("size"), F.greatest(F.sum("line"), F.lit(1)).alias("lines"))
    faults = said.union(again).groupBy("doc").agg(F.min("f").alias("f")).join(sizes, "doc").select("doc", "f.line", "f.column", "f.message", "size", "lines")
    names = F.broadcast(spark.createDataFrame([(i, f, _minified(h)) for i, (f, h) in enumerate(zip(files, heads, strict=True))], "doc int, path string, minified boolean"))
    faults = written(faults.join(names, "doc"), "json-faults")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            flags = zip(*(batch.column(c).to_pylist() for c in ("line", "minified", "size", "lines")), strict=True)
            for (doc, data, start), (line, minified, size, lines) in zip(loaded(batch, json_scan.MARK), flags, strict=True):
                if minified:
                    begin = max(0, int((line - 1) * (size / lines)) - _AROUND) - start.place.offset
                    part = data[max(0, begin) : max(0, begin + 2 * _AROUND)]
                    rows += [(doc, 0, start.number, part)] if part else []
                    continue
                at, number = 0, start.place.line
                while at <= len(data) - start.last and number <= line + context:  # nothing comes after the last line break
                    stop = data.find(b"\n", at)
                    stop = len(data) if stop < 0 else stop
                    if number >= line - context:
                        rows.append((doc, number, start.number, data[at:stop]))
                    at, number = stop + 1, number + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["doc", "line_number", "number", "text"])

    few = F.broadcast(faults.select("doc", "line", "minified", "size", "lines"))  # one row for each file of the caller's list
    parts = chunks.join(few, "doc").mapInArrow(pieces, "doc int, line_number long, number int, text binary")
    whole = parts.groupBy("doc", "line_number").agg(F.sort_array(F.collect_list(F.struct("number", "text"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    listed = whole.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line_number", text.alias("text")))).alias("shown"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lines = r.pop("shown") or []
                if r.pop("minified"):
                    r["context_lines"] = _around(lines[0]["text"]) if lines else []
                else:
                    r["context_lines"] = [{"line_number": x["line_number"], "text": x["text"].decode("utf-8", "replace").rstrip("\r"), "is_error_line": x["line_number"] == r["line"]} for x in lines]
                rows.append(r | {"kind": "json", "n": 0})
            yield pa.RecordBatch.from_pylist(rows, schema=_fields_schema())

    return faults.join(listed, "doc", "left").select("path", "line", "column", "size", "lines", "message", "minified", "shown").mapInArrow(shown, _FIELDS)


def _fields_schema() -> pa.Schema:
    line = pa.list_(pa.struct([("line_number", pa.int32()), ("text", pa.string()), ("is_error_line", pa.bool_())]))
    return pa.schema([("path", pa.string()), ("kind", pa.string()), ("n", pa.int32()), ("line", pa.int32()), ("column", pa.int32()), ("size", pa.int64()), ("lines", pa.int64()), ("message", pa.string()), ("context_lines", line)])


def validate(spark: SparkSession, paths: list[str] | str, context: int = 10) -> DataFrame:
    """path, kind, error_number, line, column, byte_offset, message, category, severity, tag_name, reference_tag, reference_line,
    context_lines.

    JSON files of any size are checked in chunks and have their first fault; an XML file is walked in one task and has all of its
    faults. A path that stands for no file is one fatal fault of its own. A tag mismatch inside the span of the last one kept is its
    consequence and is left out. byte_offset is an estimate from the line; files whose beginning has no line break show what is around
    it, cut between tags.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    found = {p: files_of(spark, p) for p in wanted}
    fixed = [(p, "xml", 0, 0, 0, 0, 1, f"File does not exist: {p}", []) for p, files in found.items() if not files]
    files = sorted({f for files in found.values() for f in files})
    heads = {f: head(spark, f, _MINIFIED) for f in files}
    as_json = [f for f in files if json_by_name_or_start(f, heads[f])]
    fixed += [(f, "json", 0, 1, 1, 0, 1, "Empty or whitespace-only JSON document", []) for f in as_json if not heads[f]]
    rows = _contents(spark, [f for f in files if f not in set(as_json)]).select("path", "kind", "content").mapInArrow(_faults(context), _FIELDS)
    if held := [f for f in as_json if heads[f]]:
        rows = rows.union(_json_files(spark, held, [heads[f] for f in held], context).select(rows.columns))
    return _judged(rows.union(spark.createDataFrame(fixed, _FIELDS)) if fixed else rows)


def validate_contents(documents: DataFrame, context: int = 10) -> DataFrame:
    """What ``validate`` returns, for documents that are rows of path, kind (xml or json) and content (binary), each row one of its own.

    The rows are dealt by path first: a table of many small documents may lie in a few parts of a file.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _judged(documents.select("path", "kind", "content").repartition(parts, "path").mapInArrow(_faults(context), _FIELDS))


def _judged(rows: DataFrame) -> DataFrame:
    """Faults (numbered from 0 in their document) with what their messages and lines tell."""
    message = F.col("message")
    place = byte_offset(F.greatest("line", F.lit(1)), F.col("size"), F.col("lines")).alias("byte_offset")
    rows = rows.select("path", "kind", (F.col("n") + 1).alias("error_number"), "line", "column", place, "message", reference_line(message).alias("reference_line"), "context_lines")
    return rows.withColumns({"category": category(message, F.col("kind")), "severity": severity(message, F.col("kind")), "tag_name": tag_name(message), "reference_tag": reference_tag(message)})


def file_info(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, filename, file_size, encoding, xml_version, root_element, namespace_count, line_count, last_modified of each file.

    Lines are counted by a reader that splits large files; the rest is read from the first 64 KB, without the files' content.
    Namespaces are those that the root declares. A file without a line break has one line.
    """
    wanted = [paths] if isinstance(paths, str) else list(paths)
    files = sorted({f for p in wanted for f in files_of(spark, p)})
    bare = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")
    heads = spark.createDataFrame([(f, bytearray(head(spark, f, 1 << 16))) for f in files], "path string, start binary")
    if not files:
        return heads.selectExpr("path", "path as filename", "cast(0 as long) as file_size", "'' as encoding", "'' as xml_version", "'' as root_element", "0 as namespace_count", "cast(1 as long) as line_count", "cast(null as timestamp) as last_modified")
    listed = spark.read.format("binaryFile").load(files).select(bare(F.col("path")).alias("path"), "modificationTime", "length")
    text = spark.read.option("lineSep", "\n").text(files).select(bare(F.col("_metadata.file_path")).alias("path"), (F.octet_length("value") + 1).cast("long").alias("n"))
    counted = text.groupBy("path").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    text = F.col("start").cast("string")
    body = F.regexp_replace(text, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    root = F.regexp_extract(body, r"<([A-Za-z_:][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", 1)
    declared = F.regexp_extract(body, r"<[A-Za-z_:][^\s/>]*((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", 1)
    version = F.regexp_extract(F.decode(F.substring("start", 1, 256), "ISO-8859-1"), r"""version\s*=\s*["']([^"']+)["']""", 1)
    out = heads.withColumn("path", bare(F.col("path"))).join(listed, "path", "left").join(counted, "path", "left")
    ends = F.col("bytes") > F.col("length")  # the last line has no line break
    return out.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.coalesce("length", F.lit(0)).cast("long").alias("file_size"), encoding(F.col("start"), guess=True).alias("encoding"),
        F.when(version == "", "1.0").otherwise(version).alias("xml_version"), F.regexp_extract(root, "([^:]*)$", 1).alias("root_element"), F.regexp_count(declared, F.lit(r"\sxmlns(:[\w.-]+)?\s*=")).cast("int").alias("namespace_count"),
        F.greatest(F.coalesce(F.col("rows") - F.when(ends, 1).otherwise(0), F.lit(0)), F.lit(1)).cast("long").alias("line_count"), F.col("modificationTime").alias("last_modified"),
    )


def summary(errors: DataFrame) -> DataFrame:
    """Errors by severity and category."""
    return errors.groupBy("severity", "category").agg(F.count("*").alias("n"))
