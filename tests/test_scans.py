"""Feeds and documents in chunks: the same answer at any cut, and what lies before a fault."""

import gzip
import json
import pickle
import random
from xml.etree import ElementTree
from xml.parsers import expat

import pytest
from pyspark.sql import functions as F

from feedloom.operators import merge, validate
from feedloom.operators.xml_faults import xml_faults
from feedloom.sources import feeds, json_scan, ranges, xml_scan


def walked(scan, data, size, rule):
    """(start, what it gives) of each chunk of about ``size`` bytes."""
    parts = ranges.cut_whole(data, scan.MARK, size)
    saved = [(len(data), ranges._saved(p if p.endswith(scan.MARK) else p + scan.MARK, scan.effect)) for p in parts]
    starts = [pickle.loads(x) for x in ranges.fold(saved, scan.BEGIN, scan.step)]
    return [(s, list(scan.Walk(p, s, rule).found())) for p, s in zip(parts, starts, strict=True)]


def json_fault(data, size):
    faults, keys = [], {}
    for start, found in walked(json_scan, data, size, None):
        for f in found:
            if f.what == "fault":
                faults.append((start.number, 1, f.place, f.data.decode()))
            elif f.what == "key":
                keys.setdefault((f.scope, f.data), []).append((start.number, 0, f.place))
    faults += [(*sorted(at)[1], f"Duplicate object key '{k.decode()}'") for (_, k), at in keys.items() if len(at) > 1]
    return min(faults)[2:] if faults else None


def scanned(scan, data, size, rule):
    """Raw values in order, those that go over several chunks put together."""
    out, parts = [], {}
    for start, found in walked(scan, data, size, rule):
        for f in found:
            if f.what == "value":
                out.append((start.number, len(out), f.data))
            elif f.what == "part":
                parts.setdefault(f.owner, []).append((start.number, f.data, f.ends, f.declared))
        if scan is json_scan and any(f.what == "fault" for f in found):
            break
    for owner, of in parts.items():
        if any(p[2] for p in of):
            raw = b"".join(p[1] for p in sorted(of))
            out.append((owner, 1 << 30, xml_scan.joined(raw, sorted(of)[0][3]) if scan is xml_scan else raw))
    rows = [x[2] for x in sorted(out)]
    if scan is json_scan:  # what does not parse is a fault
        sound = [validate.json_faults(x) == [] for x in rows]
        rows = rows[: sound.index(False)] if False in sound else rows
    return rows


def mutated(draw, data, marks):
    out = bytearray(data)
    for _ in range(draw.randint(1, 2)):
        k = draw.randrange(len(out))
        kind = draw.random()
        if kind < 0.4:
            out[k : k + 1] = b""
        elif kind < 0.8:
            out[k:k] = draw.choice(marks)
        else:
            out = out[: k + 1]
        out = out or bytearray(b" ")
    return bytes(out)


def some_json(draw, depth=0):
    kind = draw.random()
    if depth > 4 or kind < 0.25:
        return draw.choice([1, -2.5e10, "a,b", 'x"y,\\', "é,ü", True, None, "", ",", 0, "[{,}]", "\\\\,"])
    if kind < 0.6:
        return [some_json(draw, depth + 1) for _ in range(draw.randint(0, 4))]
    return {draw.choice(["a", "b", "k,1", 'é",', "items", "c"]): some_json(draw, depth + 1) for _ in range(draw.randint(0, 4))}


def items_of_lists(value, in_list=False):
    if isinstance(value, dict) and in_list:
        yield value
    else:
        for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            yield from items_of_lists(v, isinstance(value, list))


def once(pairs):
    if len(dict(pairs)) != len(pairs):
        raise ValueError
    return dict(pairs)


@pytest.mark.parametrize("seed", range(6))
def test_json_is_the_same_at_any_cut(seed):
    draw = random.Random(seed)
    for _ in range(40):
        data = json.dumps(some_json(draw), ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 1])).encode()
        if draw.random() < 0.6:
            data = mutated(draw, data, [b",", b'"', b"{", b"]", b"\\", b"x", b"\n", b":", b"}", b"1", b'"a":1,', b'"a,b"'])
        try:
            value, good = json.loads(data.decode("utf-8", "replace"), object_pairs_hook=once, parse_constant=lambda c: once([(1, 1), (1, 1)])), True
        except ValueError:
            value, good = None, False
        fault = json_fault(data, 1 << 30)
        assert (fault is None) == good and (fault and (fault[0].line, fault[0].column, fault[1])) == json_scan.first_fault(data)
        for size in (1, 7, 30):
            assert json_fault(data, size) == fault
        for rule in (json_scan.in_lists, *map(json_scan.at_path, ("item", "items.item", "a", "item.a", ""))):
            rows = scanned(json_scan, data, 1 << 30, rule)
            if good and rule is json_scan.in_lists:
                assert [json.loads(r.decode("utf-8", "replace")) for r in rows] == list(items_of_lists(value))
            for size in (1, 7, 30):
                assert scanned(json_scan, data, size, rule) == rows


def some_xml(draw, depth=0):
    name = draw.choice(["job", "a", "b", "Item", "g:x", "g:job"])
    attributes = "".join(x for x in (' k="v>w"', " q='x\"y>'", ' e=""', ' g:z="1"', ' xmlns:h="u:h"') if draw.random() < 0.2)
    if depth > 4 or draw.random() < 0.2:
        return f"<{name}{attributes}/>"
    body = "".join(draw.choice([some_xml(draw, depth + 1), some_xml(draw, depth + 1), "text &amp; é", "<!-- c > <job> -->", "<![CDATA[ <a> > ]]>", "<?p <b>?>"]) for _ in range(draw.randint(0, 4)))
    return f"<{name}{attributes}>{body}</{name}>"


@pytest.mark.parametrize("seed", range(4))
def test_xml_is_the_same_at_any_cut(seed):
    draw = random.Random(seed)
    rules = (xml_scan.named(("job", "item")), lambda p: p[-1].lower() in ("job", "item")), (xml_scan.at_path("/r/job"), lambda p: p == ["r", "job"]), (xml_scan.at_path("//a/b"), lambda p: p[-2:] == ["a", "b"]), (xml_scan.at_path("a"), lambda p: p[-1] == "a")
    for _ in range(60):
        data = (draw.choice(["", '<?xml version="1.0"?>\n', '<!DOCTYPE r [<!ENTITY x "y>">]>']) + '<r xmlns:g="u:g">' + "".join(some_xml(draw) for _ in range(draw.randint(0, 5))) + "</r>\n").encode()
        if draw.random() < 0.5:
            data = mutated(draw, data, [b"<", b">", b'"', b"'", b"</a>", b"<a>", b"<!--", b"]]>", b"<job>", b"/"])
        try:
            root = ElementTree.fromstring(data)
        except ElementTree.ParseError:
            root = None
        for rule, plain in rules:
            rows = xml_scan.values(data, rule)
            for size in (1, 9, 40, 1 << 30):
                assert scanned(xml_scan, data, size, rule) == rows
            fields = [xml_scan.fields_of(r) for r in rows]
            if root is None:
                continue
            expected, stack = [], [(root, [])]
            while stack:
                e, path = stack.pop()
                path = [*path, e.tag.rpartition("}")[2]]
                if plain(path):
                    expected.append(e)
                else:
                    stack += [(c, path) for c in reversed(e)]
            alike = [ElementTree.fromstring(r) for r in rows]
            assert [(x.tag, x.attrib, [c.tag for c in x.iter()]) for x in alike] == [(x.tag, x.attrib, [c.tag for c in x.iter()]) for x in expected]
            firsts = []
            for e in expected:
                own: dict = {}
                for c in e:
                    own.setdefault(c.tag.rpartition("}")[2], "".join(c.itertext()).strip())
                firsts.append(own)
            assert fields == firsts


def test_files_in_many_chunks(spark, tmp_path, monkeypatch):
    """Files of one line, cut by Spark's reader and by chunks, give what one parse gives, in order."""
    monkeypatch.setattr(ranges, "CHUNK", 3000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        jobs = [{"id": i, "t": f'a,"{i}', "x": {"y": [1, {"z": "é,"}]}, "long": "w, " * (1500 if i % 97 == 0 else 3)} for i in range(600)]
        (tmp_path / "a b.json").write_text(json.dumps({"note": "x,y", "now": {"positions": jobs}}))
        text = "".join(f"<job n='>'><id>{i}</id><g:t>{'v&gt; ' * (800 if i % 89 == 0 else 3)}</g:t><!-- > --></job>" for i in range(600))
        (tmp_path / "a.xml").write_text(f"<s xmlns:g='u:g'><jobs>{text}</jobs></s>")
        (tmp_path / "c.xml.gz").write_bytes(gzip.compress(f"<s xmlns:g='u:g'>{text}</s>".encode()))
        (tmp_path / "d").write_bytes(gzip.compress(json.dumps([jobs]).encode()))
        (tmp_path / "e.xml").write_bytes("<s><job><id>ü</id></job></s>".encode("utf-16"))
        names = ["a b.json", "a.xml", "c.xml.gz", "d", "e.xml"]
        records, faults = feeds.scan_feeds(spark, [str(tmp_path / n) for n in names])
        rows = {}
        for r in records.orderBy("source_idx", "rec_idx").collect():
            rows.setdefault(r["source_idx"], []).append((r["rec_idx"], r["fields"]))
        assert faults.count() == 0 and [[i for i, _ in rows[s]] for s in range(4)] == [list(range(600))] * 4
        expected = [(i, {"id": str(i), "t": j["t"], "x_y": "1", "x_y_z": "é,", "long": j["long"]}) for i, j in enumerate(jobs)]
        assert rows[0] == rows[3] == expected
        assert rows[1] == rows[2] and all(f == {"id": str(i), "t": ("v> " * (800 if i % 89 == 0 else 3)).strip()} for i, f in rows[1]) and rows[4] == [(0, {"id": "ü"})]
        chunks = ranges.chunks_of(spark, feeds.files_of(spark, str(tmp_path / "a b.json")), b",", json_scan.effect, [b"{"])
        assert chunks.select("block").distinct().count() > 3 and chunks.count() > 20
        read = feeds.read_json(spark, str(tmp_path / "a b.json"), "now.positions.item")
        assert {int(r["id"]): r["t"] for r in read.select("id", "t").collect()} == {j["id"]: j["t"] for j in jobs}
        found = feeds.read_records(spark, str(tmp_path / "a.xml"), "/s/jobs/job").orderBy("rec_idx").collect()
        assert [(r["rec_idx"], r["fields"]["id"], r["fields"]["@n"]) for r in found] == [(i, str(i), ">") for i in range(600)]

        twice = json.dumps({"k": jobs, "a": 1, "b": {"a": 1}})[:-1] + ',\n "a": 2}'
        (tmp_path / "twice.json").write_text(twice)
        (tmp_path / "cut.json").write_text(json.dumps(jobs, indent=1)[:60_000])
        (tmp_path / "bad.json").write_text(json.dumps(jobs, indent=1).replace('"id": 400,', '"id": 4 00,'))
        (tmp_path / "flat.json").write_text(json.dumps(jobs).replace('"id": 400,', '"id": 0400,'))
        for name in ("twice.json", "cut.json", "bad.json", "flat.json"):
            line, column, message = json_scan.first_fault((tmp_path / name).read_bytes())
            got = validate.validate(spark, str(tmp_path / name), 2).collect()
            assert [(r["line"], r["column"], r["message"]) for r in got] == [(line, column, message)]
            whole = validate.validate_contents(spark.createDataFrame([(name, "json", (tmp_path / name).read_bytes())], "path string, kind string, content binary"), 2).first()
            assert got[0]["context_lines"] == whole["context_lines"] and got[0]["byte_offset"] == whole["byte_offset"] and got[0]["category"] == whole["category"]
        assert twice.splitlines()[1].index('"a"') == 1 and validate.validate(spark, str(tmp_path / "twice.json")).first()["line"] == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_are_numbered_where_they_are(spark, tmp_path, monkeypatch):
    """The places of chunks go to the records; before, the records were shuffled and sorted by chunk unless adaptive execution saw to it."""
    monkeypatch.setattr(ranges, "CHUNK", 900)
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "t": "x" * (i % 70)} for i in range(400)]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": -i, "t": "y"} for i in range(50)]) + "]")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        records = feeds.scan_jobs(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
        plan = records._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["source_idx"], r["rec_idx"], r["fields"]["id"]) for r in records.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [(0, i, str(i)) for i in range(400)] + [(1, i, str(-i)) for i in range(50)]
    assert not any(x in plan for x in ("SortMergeJoin", "Sort ", "hashpartitioning"))


def test_a_failed_feed_stays_alone(spark, tmp_path):
    jobs = [{"id": i, "t": "x"} for i in range(5)]
    (tmp_path / "cut.json").write_text(json.dumps(jobs)[:-20])
    (tmp_path / "bad.json").write_text('[{"id": 10}, {"id": 11, "n": 01}, {"id": 12}]')
    (tmp_path / "between.json").write_text('{"a": [{"id": 20}, {"id": 21}] "b": [{"id": 22}]}')
    (tmp_path / "cut.xml").write_text("<s><job><id>30</id></job><job><id>31</id><t>&nope; <b>x</t></job><job><id>32</i")
    (tmp_path / "good.xml").write_text("<s><job><id>40</id></job></s>")
    (tmp_path / "empty.json").write_text("")
    names = ["cut.json", "bad.json", "between.json", "cut.xml", "empty.json", "good.xml"]
    sources = [{"type": "file", "path": str(tmp_path / n)} for n in names]
    figures = merge.merge(spark, sources, str(tmp_path / "out.json"))
    each = {k.rsplit("/", 1)[1]: v for k, v in figures["feeds"].items()}
    assert {k: (v["status"], v["parsed"]) for k, v in each.items()} == {"cut.json": ("failed", 4), "bad.json": ("failed", 1), "between.json": ("failed", 2), "cut.xml": ("ok", 2), "empty.json": ("ok", 0), "good.xml": ("ok", 1)}
    assert each["between.json"]["error"] == "Expected ',' or '}', got 'b' at line 1, column 32" and "missing closing match" in each["cut.json"]["error"]
    assert (figures["successful_feeds"], figures["failed_feeds"], figures["jobs_written"], figures["well_formed"]) == (3, 3, 10, True)
    with pytest.raises(FileNotFoundError):
        feeds.read_records(spark, str(tmp_path / "none.xml"), "/a")


def test_json_faults():
    deep = "[" * 20_000
    # Messages with their places.
    cases = {
        '{"k":{"a":1},"b":{"a":1,"a":2}}': (1, 25, "Duplicate object key 'a'"), "[" + "1" * 5000 + "]": (1, 2, "Token buffer limit exceeded"), deep: (1, 20_001, "Unclosed structure: missing closing match for '['"), deep + "]" * 20_000: None,
        deep + '{"x":1,"x":2}' + "]" * 20_000: (1, 20_008, "Duplicate object key 'x'"), "[" + "1" * 4097 + "]": None, '["a\tb"]': (1, 4, "Control characters must be escaped in string literals"), '["\\q"]': (1, 4, "Invalid escape character: '\\q'"),
        '["\\u12g4"]': (1, 7, "Invalid hex digit in unicode escape sequence: 'g'"), '{"a": nul}': (1, 7, "Invalid token 'nul'"), '{"é": "x"\n "b"}': (2, 2, "Expected ',' or '}', got 'b'"), "[1,\n]": (2, 1, "Trailing comma inside array is not allowed"),
        '{"a":1,}': (1, 8, "Trailing comma inside object is not allowed"), '{"a"}': (1, 5, "Expected ':', got '}'"), '{"a":}': (1, 6, "Expected value, got '}'"), "{1}": (1, 2, "Invalid token '1'") and (1, 2, "Expected object key or '}', got '1'"), "[,]": (1, 2, "Expected array element or ']', got ','"),
        "": (1, 1, "Empty or whitespace-only JSON document"), " \n": (1, 1, "Empty or whitespace-only JSON document"), "1 2": (1, 3, "Unexpected token '2' after valid JSON document"), "}": (1, 1, "Unexpected token '}' at start of document"), '"abc': (1, 1, "Unclosed string at end of document"),
        '{"a":': (1, 6, "Unclosed structure: missing closing match for '{'"), "[NaN]": (1, 2, "Invalid token 'NaN'"), '[1"a"]': (1, 3, "Unexpected '\"' in document"), "[1}": (1, 3, "Expected ',' or ']', got '}'"), "-0.5e+3": None, "01": (1, 1, "Invalid token '01'"),
    }
    assert {k: json_scan.first_fault(k.encode()) for k in cases} == cases


def test_xml_faults():
    # Messages with their places.
    cases = {
        "<r>&a; &b; <c x=1/></r>": [(1, 4, "Entity 'a' not defined"), (1, 8, "Entity 'b' not defined"), (1, 15, "AttValue: \" or ' expected")],
        '<r><!-- <a xmlns="rel"> --><![CDATA[ <b xmlns="x"> ]]></r>': [],
        "<r>&a;\n&b;\n<c x=1/>\n</r>": [(1, 4, "Entity 'a' not defined"), (2, 1, "Entity 'b' not defined"), (3, 4, "AttValue: \" or ' expected")],
        "<!DOCTYPE r [<!ENTITY q 'x'>]><r a='&q;'>&q;&#65;</r>": [],
        "<a xmlns='rel'><b/></a>": [(1, 4, "xmlns: URI rel is not absolute")],
        "<a><p:b p:c='1' xmlns:p='u:p'/><p:d/></a>": [(1, 32, "Namespace prefix p is not defined")],
        "<a>\n<b>\n<c></b>\n</a>": [(3, 4, "Opening and ending tag mismatch: c line 3 and b")],
        "<a>é<b x='1' x='2' y/></a>": [(1, 14, "Attribute x redefined"), (1, 20, "Specification mandates value for attribute y")],
        "<a><b": [(1, 4, "Couldn't find end of Start Tag b line 1"), (1, 1, "Premature end of data in tag b line 1")],
        "<a/><!-- -- -->x": [(1, 5, "Double hyphen within comment"), (1, 16, "Extra content at the end of the document")],
    }
    assert {k: xml_faults(k.encode()) for k in cases} == cases
    assert xml_faults("<?xml version='1.0' encoding='ISO-8859-1'?><a>é</a>".encode("latin-1")) == [] and xml_faults("<a>é</a>".encode("utf-16")) == []
    assert xml_faults(b"<a>\xff</a>")[0][2].startswith("Input is not proper UTF-8") and "Unsupported encoding" in xml_faults(b"<?xml version='1.0' encoding='no'?><a/>")[0][2]


@pytest.mark.parametrize("seed", range(3))
def test_xml_faults_agree_with_a_parser(seed):
    """A document has a fault where another parser says so."""
    draw = random.Random(seed)
    for _ in range(3000):
        text = draw.choice(["<r><a x='1'>t</a><b/><!-- c --><![CDATA[x]]></r>", "<r a='&amp;' b=\"2\"><a><a/>&lt;</a></r>"])
        for _ in range(draw.randint(0, 2)):
            i = draw.randrange(len(text))
            text = text[:i] + (text[i + 1 :] if draw.random() < 0.5 else draw.choice(list("<>&/'\"=ab! -;#]")) + text[i:])
        parser, good = expat.ParserCreate(namespace_separator=" "), True
        try:
            parser.Parse(text.encode(), True)
        except expat.ExpatError:
            good = False
        assert (xml_faults(text.encode()) == []) == good, text


def test_validation_ends_no_task(spark):
    texts = ["[" + "1" * 5000 + "]", "[" * 20_000, "<a>" * 20_000, '{"k":{"a":1},"b":{"a":1,"a":2}}', "<r>&a; &b; <c x=1/></r>"]
    df = spark.createDataFrame([(str(i), "xml" if t[0] == "<" else "json", bytearray(t.encode())) for i, t in enumerate(texts)], "path string, kind string, content binary")
    found = validate.validate_contents(df).groupBy("path").agg(F.count("*").alias("n"), F.min("column").alias("c")).orderBy("path").collect()
    assert [(r["path"], r["n"], r["c"]) for r in found] == [("0", 1, 2), ("1", 1, 20_001), ("2", 1, 1), ("3", 1, 25), ("4", 3, 4)]


def test_short_documents_are_validated_in_batches(spark):
    """Faults leave a task many at a time, are numbered in it without a shuffle of them, and the rows are spread before."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("cast(id AS string) AS path", "'xml' AS kind", "cast('<r>\n<a><b>\n</c></a>\n</r>&' AS binary) AS content")
    found = validate.validate_contents(rows)
    assert sum(x.count("Exchange hashpartitioning(path") for x in [found._jdf.queryExecution().executedPlan().toString()]) == 1
    sizes = [b.num_rows for b in validate._faults(2)(iter(rows.toArrow().to_batches()))]
    assert max(sizes) == validate._ROWS and len(sizes) < 10
    said = found.where("path = '7'").orderBy("error_number").select("error_number", "line", "category", "tag_name", "reference_tag").collect()
    assert [r["error_number"] for r in said] == list(range(1, len(said) + 1)) and tuple(said[0]) == (1, 3, "Tag Mismatch", "c", "b") and len(said) > 1


def test_short_chunks_match_brackets_as_long_ones_do():
    rng = random.Random(5)
    for _ in range(4000):
        data = "".join(rng.choice('{}[]",:\\a1 ') for _ in range(rng.randrange(1, 40))).encode()
        for in_string in (False, True):
            index, matched = json_scan.Index(data, in_string), json_scan._matched(data, in_string)
            assert all(index.closing(x) == matched.get(x) for x in index.depth[0].tolist() if data[x : x + 1] in b"{[")


def test_a_table_grows_by_feeds(spark, tmp_path):
    """Two feeds with different paths in one table; each record is parsed once, columns come from what was parsed."""
    (tmp_path / "a.xml").write_text("<r><job id='1'><t>A</t><loc><city>X</city></loc><tag>p</tag><tag k='v'>q</tag></job><job><t x='y'>B</t>mixed<e/></job></r>")
    (tmp_path / "b.json").write_text('{"jobs": [{"t": "C", "n": 1.50, "ok": true, "no": null, "l": [1, "x"], "o": [{"p": 1}, {"p": [2], "q": "z"}, 3]}, {"T": "D", "loc": {"city": "Y"}}, 7]}')
    out = str(tmp_path / "t")
    assert feeds.wide_table(spark, str(tmp_path / "a.xml"), "xml", out, "job") == sorted(["@id", "t", "loc/city", "tag", "tag/#text", "tag/@k", "t/#text", "t/@x", "e"])
    assert feeds.wide_table(spark, str(tmp_path / "b.json"), "json", out, "jobs.item") == sorted(["t", "n", "ok", "no", "l", "o", "o/p", "o/q", "T", "loc/city", "value"])
    rows = {r["id"]: {k: v for k, v in r.asDict().items() if v is not None and k not in ("id", "raw_content")} for r in feeds.read_wide(spark, out).collect()}
    assert rows == {
        0: {"@id": "1", "t": "A", "loc/city": "X", "tag": '["p"]', "tag/#text": '["q"]', "tag/@k": '["v"]'}, 1: {"t/@x": "y", "t/#text": "B", "e": ""},
        2: {"t": "C", "n": "1.50", "ok": "true", "l": '[1, "x"]', "o": "[3]", "o/p": "[1, [2]]", "o/q": '["z"]'}, 3: {"T_": "D", "loc/city": "Y"}, 4: {"value": "7"},
    }
    raw = {r["id"]: r["raw_content"] for r in feeds.read_wide(spark, out).select("id", "raw_content").collect()}
    assert raw[1] == "<job><t x='y'>B</t>mixed<e/></job>" and raw[4] == "7" and len(raw) == 5


def test_encodings_are_told_apart(spark):
    texts = {
        "cp1252": "Développeur d’études à Genève, où l’été fût très agréable: coûts élevés, ça va", "cp1251": "Инженер по качеству в Москве, опыт работы от трёх лет, «гибкий график»", "koi8_r": "Инженер по качеству в Москве, опыт работы от трёх лет и гибкий график",
        "cp1250": "Inżynier w Łodzi, źródło energii, świetne miejsce pracy, ćwiczenia", "shift_jis": "東京でソフトウェア開発者を募集しています。経験者歓迎です", "euc_jp": "東京でソフトウェア開発者を募集しています。経験者歓迎です", "gb18030": "我们正在北京招聘软件工程师，欢迎有经验的人员申请",
        "big5": "我們正在臺北招聘軟體工程師，歡迎有經驗的人員申請", "euc_kr": "서울에서 소프트웨어 개발자를 모집합니다", "cp1253": "Μηχανικός λογισμικού στην Αθήνα με εμπειρία", "cp1255": "מהנדס תוכנה בתל אביב עם ניסיון", "cp1256": "مهندس برمجيات في القاهرة مع خبرة",
        "utf-8": "Développeur", "utf-16-le": "é", "utf-16-be": "é", "utf-32-le": "é", "utf-32-be": "é",
    }
    rows = [(k, bytearray(f"<job><title>{v}</title><t>engineer</t></job>".encode(k))) for k, v in texts.items()]
    rows += [("null", None), ("utf-8", bytearray(b"")), ("utf-8", bytearray("é".encode() * 40_000)), ("utf-8-sig", bytearray(b"\xef\xbb\xbf\xff")), ("x-own", bytearray(b"<?xml version='1.0' encoding='x-own'?>"))]
    found = spark.createDataFrame(rows, "name string, content binary").coalesce(1).select("name", feeds.encoding(F.col("content"), guess=True).alias("e")).collect()
    assert [(r["name"], r["e"]) for r in found] == [(k, "utf-8" if c is None else k) for k, c in rows]
