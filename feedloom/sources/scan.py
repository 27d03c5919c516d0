"""Records of XML and JSON feeds of any size, in parallel within each file, with what lies before a fault."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.plans.tables import counted_broadcast, written
from feedloom.sources import json_scan, xml_scan
from feedloom.sources.ranges import chunks_of, loaded, started

_FOUND = pa.schema(
    [("doc", pa.int32()), ("number", pa.int32()), ("i", pa.int32()), ("what", pa.string()), ("raw", pa.binary()), ("owner", pa.int32()), ("ends", pa.bool_()), ("declared", pa.binary()),
     ("scope", pa.int64()), ("line", pa.int64()), ("column", pa.int64()), ("offset", pa.int64())]
)
_FOUND_DDL = "doc int, number int, i int, what string, raw binary, owner int, ends boolean, declared binary, scope long, line long, column long, offset long"
#: Rows that a task returns at a time, and bytes after which it does so earlier.
_ROWS, _BYTES = 2000, 4 << 20


def _walked(walk: Callable[[bytes, Any], Any], mark: bytes):
    """What each chunk gives; values are numbered within their chunk, the part of one that goes on has the next number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for doc, data, start in loaded(batch, mark):
                i = 0
                rows.append({"doc": doc, "number": start.number, "i": -1, "what": "chunk", "line": data.count(b"\n"), "offset": len(data)})
                for f in walk(data, start).found():
                    rows.append({"doc": doc, "number": start.number, "i": i, "what": f.what, "raw": f.data, "owner": f.owner, "ends": f.ends, "declared": f.declared, "scope": f.scope, "line": f.place.line, "column": f.place.column, "offset": f.place.offset})
                    i += f.what == "value"
                    size += len(f.data)
                    if len(rows) >= _ROWS or size >= _BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return run


def chunked(spark: SparkSession, files: list[str], heads: list[bytes], kind: str) -> DataFrame:
    """doc, data, start: the chunks of files of one kind with the state that each begins in; ``doc`` numbers the files."""
    scan = json_scan if kind == "json" else xml_scan
    return started(chunks_of(spark, files, scan.MARK, scan.effect, heads), scan.BEGIN, scan.step)


def found_in(chunks: DataFrame, kind: str, rule: Callable | None) -> DataFrame:
    """What ``chunked`` files give, a written table; with a row for each chunk that has its bytes (offset) and line breaks (line)."""
    scan = json_scan if kind == "json" else xml_scan
    return written(chunks.mapInArrow(_walked(lambda data, start: scan.Walk(data, start, rule), scan.MARK), _FOUND_DDL), "found")


def raw_values(found: DataFrame) -> DataFrame:
    """doc, number, i, raw, declared: whole values, those put together from the parts that several chunks hold too."""
    whole = found.where("what = 'value'").select("doc", "number", "i", "raw", F.lit(b"").alias("declared"))
    parts = found.where("what = 'part'").groupBy("doc", "owner").agg(
        F.sort_array(F.collect_list(F.struct("number", "raw", "declared"))).alias("parts"), F.max("ends").alias("ends"), F.max(F.when(F.col("number") == F.col("owner"), F.col("i"))).alias("i")
    )
    raw = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["raw"]))
    return whole.union(parts.where("ends").select("doc", F.col("owner").alias("number"), "i", raw.alias("raw"), F.get("parts", F.lit(0))["declared"].alias("declared")))


def _numbered(values: DataFrame) -> DataFrame:
    """``values`` with rec_idx, their place among those of their document. One row for each chunk meets in a window; values stay where they are."""
    counts = values.groupBy("doc", "number").agg((F.max("i") + 1).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = written(counts.select("doc", "number", before.alias("before")), "chunk-places")
    return values.join(counted_broadcast(places), ["doc", "number"]).withColumn("rec_idx", F.col("before") + F.col("i"))


def _flat(value: Any, prefix: str) -> Iterator[tuple[str, str]]:
    stack = [(value, prefix)]
    while stack:
        v, at = stack.pop()
        if isinstance(v, dict):
            stack += [(x, f"{at}_{k}" if at else k) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(x, at) for x in reversed(v)]
        else:
            yield at, "" if v is None else str(v)


def json_fields(raw: bytes) -> tuple[dict[str, str], str]:
    """The leaves of a record, names joined by _, the last of a name; and these as JSON."""
    fields = dict(_flat(json.loads(raw.decode("utf-8", "replace")), ""))
    return fields, json.dumps(fields)


def _dict_of(node: xml_scan.Node) -> Any:
    """An element as text, or where it has attributes or children as a dict of these, repeated ones as a list, and its text."""
    out: dict[str, Any] = {f"@{k}": v for k, v in node.attributes.items()}
    several: set[str] = set()
    for child in node.children:
        value = _dict_of(child)
        if child.name not in out:
            out[child.name] = value
        elif child.name in several:
            out[child.name].append(value)
        else:
            out[child.name] = [out[child.name], value]
            several.add(child.name)
    text = node.text[0].strip()
    if not out:
        return text
    return out | {"#text": text} if text else out


def _by_path(value: dict, prefix: str = "") -> dict[str, Any]:
    """Leaves by path, names joined by a slash; of a list with dicts the values of each path as a list."""
    out: dict[str, Any] = {}
    for name, v in value.items():
        path = f"{prefix}{name}"
        if isinstance(v, dict):
            out |= _by_path(v, path + "/")
        elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
            lists: dict[str, list] = {}
            for x in v:
                for k, y in (_by_path(x, path + "/") if isinstance(x, dict) else {path: x}).items():
                    lists.setdefault(k, []).append(y)
            out |= lists
        else:
            out[path] = v
    return out


def _leaf(value: Any) -> str | None:
    if value is None or isinstance(value, _Written):
        return value
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class _Written(str):
    """A number as it is written."""


def json_by_path(raw: bytes) -> tuple[dict[str, str | None], str]:
    """A JSON record by path, numbers as they are written, lists as JSON; a value that is no object is the field ``value``."""
    text = raw.decode("utf-8", "replace")
    value = json.loads(text, parse_float=_Written, parse_int=_Written)
    fields = {k: _leaf(v) for k, v in _by_path(value if isinstance(value, dict) else {"value": value}).items()}
    if any(v and v.startswith("[") for v in fields.values()):  # in lists numbers stay numbers
        plain = _by_path(json.loads(text) if isinstance(value, dict) else {"value": json.loads(text)})
        fields |= {k: _leaf(v) for k, v in plain.items() if isinstance(v, list)}
    return fields, text


def xml_by_path(raw: bytes) -> tuple[dict[str, str | None], str]:
    """An XML record by path; attributes are @name, text beside them #text."""
    root, _ = xml_scan.tree_of(raw)
    value = _dict_of(root)
    return {k: _leaf(v) for k, v in _by_path(value if isinstance(value, dict) else {"#text": value} if value else {}).items()}, raw.decode("utf-8", "replace")


def parsed(values: DataFrame, parse: Callable[[bytes], tuple[dict[str, str], str]]) -> DataFrame:
    """doc, number, i, fields, raw, ok of ``values``; a value that does not parse is not ok."""
    schema = pa.schema([("doc", pa.int32()), ("number", pa.int32()), ("i", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("raw", pa.string()), ("ok", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                raw = xml_scan.joined(row["raw"], row["declared"]) if row["declared"] else row["raw"]
                try:
                    fields, text = parse(raw)
                except (ValueError, RecursionError):
                    fields, text = None, None
                rows.append({"doc": row["doc"], "number": row["number"], "i": row["i"], "fields": None if fields is None else list(fields.items()), "raw": text, "ok": fields is not None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return values.mapInArrow(run, "doc int, number int, i int, fields map<string,string>, raw string, ok boolean")


def records_of(spark: SparkSession, files: list[str], heads: list[bytes], kind: str, rule: Callable, parse: Callable) -> tuple[DataFrame, DataFrame]:
    """Records (doc, rec_idx, fields, raw) before the first fault of each file, and these faults (doc, line, column, message)."""
    found = found_in(chunked(spark, files, heads, kind), kind, rule)
    records = written(parsed(raw_values(found), parse), "records")
    said = F.struct("number", "i", F.col("line").alias("line"), F.col("column").alias("column"), F.col("raw").cast("string").alias("message"))
    bad = F.struct("number", "i", F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("column"), F.lit("Record is not valid").alias("message"))
    faults = found.where("what = 'fault'").select("doc", said.alias("f")).union(records.where("not ok").select("doc", bad.alias("f"))).groupBy("doc").agg(F.min("f").alias("f"))
    faults = written(faults.select("doc", "f.*"), "faults")
    ends = F.broadcast(faults.select("doc", F.struct("number", "i").alias("end")))  # one row for each file of the caller's list
    kept = records.where("ok").join(ends, "doc", "left").where(F.col("end").isNull() | (F.struct("number", "i") < F.col("end")))
    return _numbered(kept).select("doc", "rec_idx", "fields", "raw"), faults.select("doc", "line", "column", "message")
