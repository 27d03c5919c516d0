"""Feed sources: record detection on a file head, XML and JSON records, and the flat wide table."""

from __future__ import annotations

import codecs
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.plans.tables import shared_dir, written
from feedloom.sources import json_scan, scan, xml_scan
from feedloom.sources.encodings import SAMPLE, guessed_encoding

#: Element names of records, in lower case.
RECORD_NAMES = ("job", "position", "item", "entry", "opening", "vacancy")
HEAD = 5 << 20


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or pattern stands for, under the names that Spark's readers give them, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], [*(fs.globStatus(where) or [])]
    while found:
        status = found.pop()
        if status.isDirectory():
            found.extend(s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith((".", "_")))
        else:
            out.append(status.getPath().toString())
    return sorted(out)


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of the first file, and no others, through the file system that Spark has for it."""
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _events(data: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        parser.feed(data)
        yield from parser.read_events()
    except ElementTree.ParseError:  # what came before the fault, or before the head ends
        yield from ()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def detect_xml_element(spark: SparkSession, path: str) -> str:
    """The element that most likely is the record: many with children, at a small depth; ``job`` if there is none."""
    n, depth_of, stack = Counter(), {}, []
    for kind, element in _events(head(spark, path)):
        if kind == "start":
            if stack:
                stack[-1][1] = True
            stack.append([_local(element.tag), False])
        else:
            name, has_children = stack.pop()
            if has_children and 1 <= len(stack) <= 3:
                n[name] += 1
                depth_of[name] = min(depth_of.get(name, 9), len(stack))
    return max(n, key=lambda k: (n[k] / (depth_of[k] + 0.1), k), default="job")


_TOKEN = re.compile(r"""[ \t\r\n]*+(?:("[^"\\]*+(?:\\.[^"\\]*+)*+")|([{}\[\],:])|([^\s"{}\[\],:]++))""", re.S)
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def _list_items(text: str) -> Iterator[str]:
    """The path of each map or list that is an item of a list, up to the end of the first value, a fault or the cut."""
    stack: list[tuple[str, bool]] = []  # path, is a list
    want, key, at = "value", "", 0
    while (m := _TOKEN.match(text, at)) is not None:
        at = m.end()
        string, mark, word = m.groups()
        if mark in ("}", "]"):
            if not stack or stack[-1][1] != (mark == "]") or want not in ("comma", "first item" if mark == "]" else "first key"):
                return
            stack.pop()
            want = "comma"
        elif want == "comma" and mark == ",":
            want = "value" if stack[-1][1] else "key"
        elif want in ("key", "first key") and string:
            try:
                want, key = "colon", json.loads(string, strict=False)
            except ValueError:
                return
        elif want == "colon" and mark == ":":
            want = "value"
        elif want in ("value", "first item") and mark in ("{", "["):
            path, in_list = stack[-1] if stack else ("", False)
            name = "item" if in_list else key
            own = f"{path}.{name}" if path else name
            if in_list:
                yield own
            stack.append((own, mark == "["))
            want = "first item" if mark == "[" else "first key"
        elif want in ("value", "first item") and (string or word and _SCALAR.fullmatch(word)):
            want = "comma"
        else:
            return
        if not stack:
            return


def detect_json_path(spark: SparkSession, path: str) -> str:
    """The list with most maps or lists as its items, as names joined by dots and ``item``; ``item`` if there is none."""
    data = head(spark, path)
    text = codecs.getincrementaldecoder(json.detect_encoding(data))("replace").decode(data)  # a character that the cut halves is left out
    found = Counter(_list_items(text))
    return max(found, key=lambda k: found[k], default="item")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Records of clean XML; the reader splits large files by records."""
    options = {"rowTag": row_tag, "attributePrefix": "@", "valueTag": "#text", "inferSchema": "false", "ignoreNamespace": "true", "mode": "PERMISSIVE"}
    return spark.read.format("xml").options(**options).load(path)


def _json_rule(record_path: str) -> json_scan.Rule:
    at, items = json_scan.at_path(record_path), json_scan.at_path(f"{record_path}.item")

    def rule(levels: list, name: str | None, kind: str) -> bool:
        return (at(levels, name, kind) and (kind != "[" or record_path.endswith("item"))) or items(levels, name, kind) or (record_path == "item" and not levels and kind == "{")

    return rule


def json_values(spark: SparkSession, path: str, record_path: str = "item") -> DataFrame:
    """file, rec_idx, raw of the values at a path such as ``positions.item``, up to the first fault of each file.

    A path that ends at a list stands for its items, and ``item`` for a document that is one object as well.
    """
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    found, _ = scan.records_of(spark, files, [_first_bytes(spark, f) for f in files], "json", _json_rule(record_path), _one_line)
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(files)), "doc int, file string")), "doc").select("file", "rec_idx", "raw")


def _one_line(raw: bytes) -> tuple[dict[str, str], str]:
    """A value that is an object on one line; another value as the field ``value`` of one."""
    text = raw.decode("utf-8", "replace").strip()
    json.loads(text)
    text = text.replace("\r", " ").replace("\n", " ")  # no string holds a line break
    return {}, text if text.startswith("{") else f'{{"value": {text}}}'


def read_json(spark: SparkSession, path: str, record_path: str = "item") -> DataFrame:
    """Records of JSON documents under a path such as ``positions.item``, with the columns of all of them; large files are split."""
    lines = f"{shared_dir(spark)}/json-lines-{uuid.uuid4().hex}"
    json_values(spark, path, record_path).select("raw").write.text(lines)
    return spark.read.option("primitivesAsString", True).json(lines)


def _flat(schema: T.StructType, c: Column | None, prefix: str, xml: bool) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for f in schema.fields:
        own = F.col(f"`{f.name}`") if c is None else c[f.name]
        path, kind = f"{prefix}{f.name}", f.dataType
        if isinstance(kind, T.StructType):
            out += _flat(kind, own, path + "/", xml)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for name, inner in _flat(kind.elementType, None, "", xml):
                out.append((f"{path}/{name}", _listed(_inside(own, name), xml)))
        elif isinstance(kind, T.ArrayType):
            out.append((path, _listed(own, xml)))
        else:
            out.append((path, own.cast("string")))
    return out


def _inside(items: Column, path: str) -> Column:
    """The values at a path of the items of a list; items without it add nothing."""

    def get(x: Column) -> Column:
        for name in path.split("/"):
            x = x[name]
        return x

    return F.filter(F.transform(items, get), lambda x: x.isNotNull())


def _listed(values: Column, xml: bool) -> Column:
    """A list as JSON text; in XML a single element is a plain value, in JSON a list stays one."""
    text = F.to_json(values)
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)).cast("string")).when(F.size(values) > 1, text) if xml else F.when(values.isNotNull(), text)


def flatten(records: DataFrame, xml: bool = False) -> DataFrame:
    """The wide table of records: one text column for each path, names joined by a slash."""
    return records.select(*[c.alias(p) for p, c in _flat(records.schema, None, "", xml)])


def schema_tree(paths: list[str]) -> dict:
    """Paths as a nested dict; a leaf is an empty one."""
    tree: dict = {}
    for path in sorted(paths):
        node = tree
        for part in path.split("/"):
            node = node.setdefault(part, {})
    return tree


def _first_bytes(spark: SparkSession, path: str, size: int = 512) -> bytes:
    """The first bytes of a file, and of one that is compressed what they hold."""
    data = head(spark, path, 4 * size)
    if data[:2] == b"\x1f\x8b":
        return data[:2] + zlib.decompressobj(31).decompress(data, size)
    return data[:size]


def _is_json(start: bytes) -> bool:
    """Whether a feed is JSON by its first character, in any of its encodings."""
    text = start.removeprefix(b"\x1f\x8b").replace(b"\0", b"").lstrip(b"\xef\xbb\xbf\xff\xfe \t\r\n")
    return text[:1] in (b"{", b"[")


def scan_feeds(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """source_idx, rec_idx, fields, raw of the records of feeds in any mix of XML and JSON, plain or gzip; and their faults.

    Format is told by content. Files are cut into chunks that are read in parallel. XML is read on after a fault, as far as its
    tags tell records; JSON up to the first fault, of which faults (source_idx, line, column, message) has a row.
    """
    named = [(i, f) for i, p in enumerate(paths) for f in files_of(spark, p)]
    files = sorted({f for _, f in named})
    starts = {f: _first_bytes(spark, f) for f in files}
    records = spark.createDataFrame([], "file string, rec_idx long, fields map<string,string>, raw string")
    faults = spark.createDataFrame([], "file string, line long, column long, message string")
    kinds = (("json", json_scan.in_lists, scan.json_fields), ("xml", xml_scan.named(RECORD_NAMES), xml_scan.record_of))
    for kind, rule, parse in kinds:
        own = [f for f in files if _is_json(starts[f]) == (kind == "json")]
        if own:
            names = F.broadcast(spark.createDataFrame(list(enumerate(own)), "doc int, file string"))
            found, bad = scan.records_of(spark, own, [starts[f] for f in own], kind, rule, parse)
            records = records.unionByName(found.join(names, "doc").drop("doc"))
            faults = faults.unionByName(bad.join(names, "doc").drop("doc"))
    # Files of a source are numbered one after another.
    sources = F.broadcast(spark.createDataFrame(named, "source_idx int, file string"))
    placed = records.join(sources, "file")
    if len(named) > len(paths):
        counts = placed.groupBy("source_idx", "file").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source_idx").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = placed.join(F.broadcast(counts.select("source_idx", "file", before.alias("before"))), ["source_idx", "file"]).withColumn("rec_idx", F.col("rec_idx") + F.col("before"))
    return placed.select("source_idx", "rec_idx", "fields", "raw"), faults.join(sources, "file").select("source_idx", "file", "line", "column", "message")


def scan_jobs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of ``scan_feeds``."""
    return scan_feeds(spark, paths)[0]


def leaves_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the leaves of JSON documents; a list adds its size under ``/size()``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(v, at: str) -> Iterator[tuple[str, str | None]]:
            if isinstance(v, dict):
                for k, x in v.items():
                    yield from walk(x, f"{at}/{k}" if at else k)
            elif isinstance(v, list):
                yield f"{at}/size()", str(len(v))
                for i, x in enumerate(v):
                    yield from walk(x, f"{at}[{i}]")
            else:
                yield at, None if v is None else str(v)

        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = list(walk(json.loads(data), ""))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["path", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "path string, value string")


def sniff(path: Column, content: Column) -> Column:
    """json or xml by suffix, else by the first character after a byte order mark."""
    start = F.ltrim(F.regexp_replace(F.substring(content, 1, 4096).cast("string"), "^﻿?\\s*", ""))
    by_name = F.when(path.rlike(r"(?i)\.json$"), "json").when(path.rlike(r"(?i)\.(xml|xsd|xsl|xslt|svg|xhtml)$"), "xml")
    return F.coalesce(by_name, F.when(F.substring(start, 1, 1).isin("{", "["), "json").otherwise("xml"))


def json_by_name_or_start(path: str, start: bytes) -> bool:
    """What ``sniff`` tells, of a path and first bytes at hand."""
    if re.search(r"(?i)\.json$", path):
        return True
    return not re.search(r"(?i)\.(xml|xsd|xsl|xslt|svg|xhtml)$", path) and _is_json(start)


def encoding(content: Column, guess: bool = False) -> Column:
    """Encoding by byte order mark, then by the XML declaration, then with ``guess`` by what the first bytes look like, else utf-8."""
    mark = F.hex(F.substring(content, 1, 4))
    said = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), r"""encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", 1))
    marks = F.when(mark.isin("0000FEFF"), "utf-32-be").when(mark == "FFFE0000", "utf-32-le").when(mark.startswith("EFBBBF"), "utf-8-sig").when(mark.startswith("FFFE"), "utf-16-le").when(mark.startswith("FEFF"), "utf-16-be")
    told = F.coalesce(marks, F.nullif(said, F.lit("")))
    return F.coalesce(told, guessed_encoding(F.when(told.isNull(), F.substring(content, 1, SAMPLE))) if guess else F.lit(None), F.lit("utf-8"))


def staged_name(kind: Column, key: Column, suffix: str = "") -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws(":", kind, key), 256), 1, 16), F.lit(suffix))


#: Elements that the builder looks at to find its records, and how deep they lie at most.
BUILDER_ELEMENTS, BUILDER_DEPTH = 15_000, 3


def detect_record_path(spark: SparkSession, path: str) -> str:
    """The full path of the element with children that is found most often, the shallower of equals; /root/item if none."""
    found: Counter[str] = Counter()
    stack: list[str] = []
    parents: list[bool] = []
    begun = 0
    for kind, element in _events(head(spark, path)):
        if kind == "start":
            begun += 1
            if begun > BUILDER_ELEMENTS:
                break
            if parents:
                parents[-1] = True
            stack.append(_local(element.tag))
            parents.append(False)
        else:
            if parents.pop() and len(stack) <= BUILDER_DEPTH:
                found["/" + "/".join(stack)] += 1
            stack.pop()
    order = sorted(found, key=lambda p: (-found[p], p.count("/")))
    return next((p for p in order if found[p] > 1), order[0] if order else "/root/item")


def builder_fields(raw: bytes) -> dict[str, str]:
    """Leaves of a record by path, attributes as path@name, and each first one by its bare name too."""
    out: dict[str, str] = {}
    root = xml_scan.parsed(raw)
    stack: list[tuple[xml_scan.Node, str, bool]] = [(root, "", False)]
    while stack:
        node, prefix, seen = stack.pop()
        if seen:  # after all that is in it
            if not node.children:
                out.setdefault(node.name, node.text[0].strip())
            continue
        for name, value in node.attributes.items():
            out[f"{prefix}@{name}"] = value
            out.setdefault(name, value)
        if not node.children:
            out[prefix.rstrip("/") or node.name] = node.text[0].strip()
        for child in reversed(node.children):
            stack += [(child, "", True), (child, f"{prefix}{child.name}/", False)]
    return out


def read_records(spark: SparkSession, path: str, record_path: str | None = None) -> DataFrame:
    """rec_idx and fields of the records of XML files: elements at a full path, or (//a/b) whose path ends in these names.

    Without a path it is detected. Files are cut into chunks that are read in parallel, and read on after faults as far as their tags
    tell records; rec_idx goes on from file to file, in order of names.
    """
    rule = xml_scan.at_path(record_path or detect_record_path(spark, path))
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(path)
    found, _ = scan.records_of(spark, files, [_first_bytes(spark, f) for f in files], "xml", rule, lambda raw: (builder_fields(raw), ""))
    if len(files) == 1:
        return found.select("rec_idx", "fields")
    counts = found.groupBy("doc").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(F.broadcast(counts.select("doc", before.alias("before"))), "doc").select((F.col("rec_idx") + F.col("before")).alias("rec_idx"), "fields")


def records_preview(records: DataFrame, limit: int = 100) -> tuple[list[str], DataFrame]:
    """Names of all fields, simple ones first, and the first rows with a column col_0, col_1 ... for each."""
    names = [r["k"] for r in records.select(F.explode(F.map_keys("fields")).alias("k")).distinct().collect()]
    names.sort(key=lambda n: (n.count("/"), n.count("@"), n))
    return names, records.orderBy("rec_idx").limit(limit).select(*[F.try_element_at("fields", F.lit(n)).alias(f"col_{i}") for i, n in enumerate(names)])


def read_wide(spark: SparkSession, out: str) -> DataFrame:
    """A wide table with the columns of all feeds that were added to it; null where a feed did not have one."""
    return spark.read.option("mergeSchema", True).parquet(out)


def wide_table(spark: SparkSession, path: str, kind: str, out: str, record: str | None = None) -> list[str]:
    """Add a feed to the table of id, raw_content and a text column for each path under ``out``; the feed's paths come back.

    Each record is read and parsed once; paths are found by an aggregate over what was parsed. The table may have other feeds, whose
    columns stay as they are, and ids go on from theirs: ``read_wide`` reads all. Ids number records in order, file by file. A path that
    differs from an earlier one by case alone, or is id or raw_content, has a column with a trailing _.
    """
    files = files_of(spark, path)
    if kind == "xml":
        rule, parse = xml_scan.named(((record or detect_xml_element(spark, path)).lower(),)), scan.xml_by_path
    elif kind == "json":
        rule, parse = _json_rule(record or detect_json_path(spark, path)), scan.json_by_path
    else:
        raise ValueError(f"no table from {kind!r}")
    if not files:
        raise FileNotFoundError(path)
    found, _ = scan.records_of(spark, files, [_first_bytes(spark, f) for f in files], kind, rule, parse)
    held = written(found, "wide-records")
    counts = held.groupBy("doc").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    old = read_wide(spark, out) if files_of(spark, out) else None
    top = old.agg(F.max("id")).first()[0] if old is not None else None
    begin = -1 if top is None else top
    number = (F.lit(begin + 1) + F.col("before") + F.col("rec_idx")).alias("id")
    paths = sorted(r["k"] for r in held.select(F.explode(F.map_keys("fields")).alias("k")).distinct().collect())
    there = old.columns if old is not None else ["id", "raw_content"]
    columns, taken, used = [], {c.lower() for c in there}, {"id", "raw_content"}
    for p in sorted(paths, key=lambda p: p not in there):
        name = p
        while name in used or (name.lower() in taken and name not in there):
            name += "_"
        taken.add(name.lower())
        used.add(name)
        columns.append(F.try_element_at("fields", F.lit(p)).alias(name))
    placed = held.join(F.broadcast(counts.select("doc", before.alias("before"))), "doc")
    placed.select(number, F.col("raw").alias("raw_content"), *columns).write.mode("append").parquet(out)
    return paths


def read_sources(spark: SparkSession, path: str) -> list[dict]:
    """The sources that a list names: JSON objects, or lines (# comments) of addresses and paths; each source once, by its key."""
    text = head(spark, path, 64 << 20).decode("utf-8-sig")
    if path.lower().endswith(".json"):
        listed = json.loads(text)
    else:
        lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
        listed = [{"type": "url", "url": x} if x.startswith(("http://", "https://")) else {"type": "file", "path": x} for x in lines]
    found: dict[str, dict] = {}
    for source in listed:
        found.setdefault(source_key(source), source)
    return list(found.values())


def source_key(source: dict) -> str:
    """What tells sources apart: the address, the path, or host and remote path."""
    kind = source.get("type", "url")
    if kind in ("url", "secure_api"):
        return source.get("url", "")
    if kind == "file":
        return source.get("path", "")
    return f"sftp://{source.get('host')}{source.get('remote_path')}" if kind == "sftp" else "unknown"
