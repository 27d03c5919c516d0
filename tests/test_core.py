"""Predicates, statistics, transforms, dedup, feeds, templates, validation and streaming on small inputs."""

import gzip
import json
import random
import sqlite3
from datetime import datetime
from urllib.parse import quote, unquote

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.functions import transforms as T
from feedloom.functions.compat import loose_real, strip
from feedloom.operators import convert, dedup, merge, predicates, stats, template, validate
from feedloom.plans import catalogue, tables
from feedloom.sources import feeds, sinks
from feedloom.streaming.ingest import earlier, ingest

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "12abc", "1,000", "-5.5kg", "1e3x", "abc", "inf", "nan", "0x10", ".5", " 7", "Engineer", "engineer II", "a%b", "a_b", r"a\b", "100", "99", "ABC", "x,y"]


@pytest.mark.parametrize("operator,where", [("Equals", "v = ?"), ("Not Equals", "v <> ? OR v IS NULL"), ("Contains", "v LIKE '%' || ? || '%'"), ("Starts With", "v LIKE ? || '%'"), ("Ends With", "v LIKE '%' || ?")])
@pytest.mark.parametrize("value", ["abc", "a%b", "_", r"a\b", "ENG", "100"])
def test_text_filters_match_sqlite(spark, operator, where, value):
    db = sqlite3.connect(":memory:")
    db.execute("create table t (id integer, v text)")
    db.executemany("insert into t values (?, ?)", enumerate(TEXTS))
    want = {r[0] for r in db.execute(f"select id from t where {where}", (value,))}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, v string")
    assert {r["id"] for r in predicates.select(df, ["v"], [{"field": "v", "operator": operator, "value": value}]).collect()} == want


def test_numbers_match_sqlite(spark):
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice("0123.eE+-ax_ \t") for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    want = [r[0] for t in texts for r in sqlite3.connect(":memory:").execute("select cast(? as real)", (t,))]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string").coalesce(1).orderBy("i").select(loose_real(F.col("v")).alias("x")).collect()]
    assert got == want


def test_other_filters(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, v string")
    ids = lambda *f, **k: {r["id"] for r in predicates.select(df, ["v"], list(f), **k).collect()}
    one = lambda o, v="": {"field": "v", "operator": o, "value": v}
    everything = set(range(len(TEXTS)))
    assert ids(one("Exists")) == everything - {0, 1} and ids(one("missing")) == {0, 1}
    assert ids(one("In List", "abc, ,99")) == {6, 18} and ids(one("Not In List", "abc,99")) == everything - {6, 18}
    assert ids(one("In List", ",")) == set() and ids(one("Not In List", "")) == everything
    assert ids(one("Regex", "^eng")) == {12, 13} and ids(one("Regex", "(")) == set() and ids(one("Regex", r"(?P<x>1)0(?P=x)|00")) == {3, 17}
    assert ids(one("Greater Than", "nan")) == set() and 1 in ids(one("Less Than", "5")) and 0 not in ids(one("Less Than", "5"))
    assert ids({"field": "no", "operator": "Equals", "value": "1"}) == set() and ids(one("Odd", "1")) == ids({"field": "", "operator": "x"}) == everything
    assert ids(term="abc") == {2, 6, 19} and ids(term=" ") == everything and ids(term="abc", match="Exact Match", field="v") == {6} and ids(term="a", field="no") == set()


def test_stats_count_empty_and_null(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("", "x"), (None, "x"), ("bb", "x")], "p string, q string")
    p, q = stats.all_field_stats(df, ["p", "q"]).orderBy("field_idx").collect()
    assert (p["total"], p["present"], p["missing"], p["unique_count"], p["duplicate_count"], p["min_length"], p["max_length"], p["avg_length"], p["completion_rate"]) == (5, 3, 2, 2, 1, 0, 2, 1.0, 60.0)
    assert (q["present"], q["unique_count"], q["duplicate_count"]) == (3, 1, 2)
    assert stats.group_by(df, ["none"], ["p"]) is None
    assert {tuple(r) for r in stats.group_by(df, ["p"], ["p"]).collect()} == {("a", 2), ("", 1), ("[Missing]", 1), ("bb", 1)}
    assert {tuple(r) for r in stats.field_values(df, "p").collect()} == {("a", 2), ("[Empty]", 1), ("bb", 1)}
    assert {tuple(r) for r in stats.duplicate_summary(df, ["p", "q"]).collect()} == {("p", 1, 2), ("q", 1, 3)}
    assert stats.all_field_stats(df.limit(0), ["p"]).count() == 0 and stats.summary(df, ["p", "q"]).first()["duplicates"] == 0


def test_transforms_match_python(spark):
    texts = ["", "  héllo wörld ", "O'Neil mc-donald x2y", "a b/c&~*+", "a%20b+%zz%C3%A9", "2024-02-29", "12/31/2023", "xAxA", "日本 語", "\t\n"]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "i int, v string, w string")

    def got(name, *args):
        return [r["x"] for r in df.orderBy("i").select(T.apply(F.col("v"), [{"function": name, "args": args}], df.columns).alias("x")).collect()]

    for a, b in (("1", "3"), ("-3", "-1"), ("2", ""), ("-50", "4"), ("5", "2"), ("x", "2")):
        want = texts if a == "x" else [t[int(a) : int(b) if b else None] for t in texts]
        assert got("substring", a, b) == want
    assert got("title_case") == [t.title() for t in texts] and got("upper") == [t.upper() for t in texts] and got("strip") == [t.strip() for t in texts]
    assert got("url_encode") == [quote(t) for t in texts] and got("url_decode") == [unquote(t) for t in texts]
    assert got("replace", "A", "$") == [t.replace("A", "$") for t in texts] and got("replace", "", "-") == [t and t.replace("", "-") for t in texts]
    assert got("default", "z") == [t if t.strip() else "z" for t in texts] and got("tokenize", " ", "1")[1] == "" and got("tokenize", " ", "9") == [""] * len(texts)
    assert got("date_format", "%Y-%m-%d", "%d.%m.%Y")[5] == "29.02.2024" and got("date_format", "%m/%d/%Y", "%y")[6] == "23" and got("date_format", "%Y-%m-%d", "%d")[0] == ""
    assert got("regex_replace", "(x)(A)", r"\2\1")[7] == "AxAx" and got("regex_replace", "(", "x") == texts and got("regex_replace", "^", "x")[0] == "" and got("lower") == [t.lower() for t in texts] and got("nothing") == texts and got("substring", "1", "2", "3") == texts
    dates = ["2024-02-29", " 2024-02-29 ", "1/2/2023", "01/02/2023", "2023-2-30", "", "20240229"]
    for given in ("%Y-%m-%d", "%m/%d/%Y", "%Y%m%d"):
        want = []
        for d in dates:
            try:
                want.append(datetime.strptime(d.strip(), given).strftime("%d.%m.%Y"))
            except ValueError:
                want.append(d)
        made = spark.createDataFrame(list(enumerate(dates)), "i int, v string").orderBy("i").select(T.date_format(F.col("v"), given, "%d.%m.%Y").alias("x"))
        assert [r["x"] for r in made.collect()] == want
    assert got("concat", "-", "$w", "lit", "$no")[0] == "b-lit-" and got("contains", "A", "y", "n")[7] == "y"
    sizes = spark.range(1).select(T.file_size(F.lit(512)), T.file_size(F.lit(-1)), T.human_size(F.lit(1536)), T.duration(F.lit(3723)), T.duration(F.lit(0.4)), T.speed(F.lit(0))).first()
    assert tuple(sizes) == ("512 B", "0 B", "1.5 KB", "1h 2m 3s", "0.4s", "0.00 MB/s")
    assert spark.range(1).select(strip(F.lit(None).cast("string"))).first()[0] is None


def test_sizes_round_by_all_digits(spark):
    """The shortest text of a double can be a tie where the double is none; true ties go to the even digit."""
    rng = random.Random(2)
    near = [4551113121562623, 1310720, 3932160, *(int((rng.randrange(10**10) + 0.005) * 1048576) + rng.randrange(2) for _ in range(2000))]
    got = spark.createDataFrame([(b,) for b in near], "b long").coalesce(1).select("b", T.speed(F.col("b")).alias("speed"), T.human_size(F.col("b")).alias("size")).collect()
    assert [r["speed"] for r in got] == [f"{b / 1048576:.2f} MB/s" for b in near]
    assert [r["size"] for r in got[1:3]] == ["1.2 MB", "3.8 MB"]
    assert spark.range(1).select(T.duration(F.lit(0.25))).first()[0] == "0.2s"


def greedy(rows):
    seen, kept = set(), []
    for i, keys in rows:
        if not seen & keys:
            kept.append(i)
            seen |= keys
    return kept


def test_first_wins_equals_the_sequential_form(spark):
    rng = random.Random(6)
    for n, spread in ((150, 40), (150, 400)):
        rows = [(0, i, {"ID": f"A{rng.randrange(spread)}", "u_rl": f"u{rng.randrange(spread)} " if rng.random() < 0.7 else " ", "guid": None}, f"<a>{i}</a>") for i in range(n)]
        df = spark.createDataFrame(rows, "source_idx int, rec_idx long, fields map<string,string>, raw string")
        want = greedy([(i, {("id", f["ID"])} | ({("url", f["u_rl"].strip())} if f["u_rl"].strip() else set())) for _, i, f, _ in rows])
        kept = dedup.first_wins(df)
        assert sorted(r["rec_idx"] for r in kept.collect()) == want
        assert dedup.first_wins(df, known=dedup.registered(kept)).count() == 0
    same = spark.createDataFrame([(0, 0, {"t": "x"}, "<a  b='1'/>"), (0, 1, {"t": "x"}, '<a b="1"></a>')], "source_idx int, rec_idx long, fields map<string,string>, raw string")
    assert [r["rec_idx"] for r in dedup.first_wins(same).collect()] == [0] and dedup.first_wins(same.limit(0)).count() == 0


XML = """<jobs_feed><job id="1"><title>A</title><location><city>X</city><state>Y</state></location><tags>p</tags><tags>q</tags></job>
<job id="2"><title>B</title><location><city>Z</city></location><tags>p</tags></job></jobs_feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.json").write_text('{"now": {"positions": [{"title": "C", "company": {"name": "N"}, "skills": ["s"]}, {"title": null, "id": 7}]}}')
    (tmp_path / "c.xml.gz").write_bytes(gzip.compress(b"<source><item><id>3</id><position>in</position></item><other/><JOB><id>4</id></JOB><item><broken>"))
    a, b, c = (str(tmp_path / n) for n in ("a.xml", "b.json", "c.xml.gz"))
    assert feeds.detect_xml_element(spark, a) == "job" and feeds.detect_json_path(spark, b) == "now.positions.item"
    wide = feeds.flatten(feeds.read_xml(spark, a, "job"), xml=True)
    assert sorted(wide.columns) == ["@id", "location/city", "location/state", "tags", "title"]
    assert [tuple(r) for r in wide.select("`@id`", "`location/city`", "tags").orderBy("`@id`").collect()] == [("1", "X", '["p","q"]'), ("2", "Z", "p")]
    rows = feeds.flatten(feeds.read_json(spark, b, "now.positions.item"))
    assert {(r["title"], r["company/name"], r["skills"], r["id"]) for r in rows.collect()} == {("C", "N", '["s"]', None), (None, None, None, "7")}
    jobs = sorted(((r["source_idx"], r["rec_idx"], r["fields"]) for r in feeds.scan_jobs(spark, [c, b, a]).collect()), key=str)
    assert [(j[0], j[1]) for j in jobs] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert jobs[0][2] == {"id": "3", "position": "in"} and jobs[2][2] == {"title": "C", "company_name": "N", "skills": "s"}
    assert feeds.schema_tree(["a/b", "a", "c"]) == {"a": {"b": {}}, "c": {}}
    kinds = {r["path"].rsplit("/", 1)[1]: (r["k"], r["e"]) for r in spark.read.format("binaryFile").load([a, b]).select("path", feeds.sniff(F.col("path"), F.col("content")).alias("k"), feeds.encoding(F.col("content")).alias("e")).collect()}
    assert kinds == {"a.xml": ("xml", "utf-8"), "b.json": ("json", "utf-8")}
    convert.convert(spark, a, "xml", str(tmp_path / "o"), "csv", "job")
    assert convert.csv_rows(spark, str(tmp_path / "o")).count() == 2
    convert.convert(spark, b, "json", str(tmp_path / "x"), "xml")
    assert any(p.suffix == ".xml" or p.name.startswith("part") for p in (tmp_path / "x").iterdir())
    (tmp_path / "d.json").write_text('{"now": {"positions": [{"title": "D", "company": {"name": "N"}}]}}')
    found = {(r["path"], r["kind"]) for r in convert.difference(convert.json_paths(spark, b), convert.json_paths(spark, str(tmp_path / "d.json"))).collect()}
    assert ("now/positions/size()", "Item count changed") in found and ("now/positions[0]/title", "Value mismatch") in found and ("now/positions[0]/skills[0]", "Removed") in found
    sinks.merged_xml(feeds.scan_jobs(spark, [a]), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m" / "1-records")).count() == 2
    assert "&lt;b&gt;" in sinks.html_report("<b>", {"n": 1}, wide.select("title"))


def test_template(spark, tmp_path):
    text = "<feed><jobs><job><t>{{ title }}</t><d><![CDATA[{{body}}]]></d><x>{{gone}}</x><off>{{title}}</off></job></jobs><by>{{who}}</by></feed>"
    df = spark.createDataFrame([("A & <b>", "x]]>y"), (None, "{{who}}")], "col string, body string").coalesce(1)
    assert template.check(text) is None and template.check("<a>") and template.check(" ") and template.names(text) == ["title", "body", "gone", "who"]
    assert template.auto_match(["Job Title", "body"], ["title", "body"]) == {"title": "Job Title", "body": "body"}
    before, record, after = template.repeating(text, ["title", "body"])
    assert record.startswith("<job>") and record.endswith("</job>") and before + record + after == text
    template.build(df, text, {"title": "col", "body": "body"}, str(tmp_path / "f"), static={"who": "me & co"}, headers={"provider": "p"}, disabled=["off"])
    got = "".join(r["value"] for d in ("0-open", "1-records", "2-close") for r in spark.read.text(str(tmp_path / "f" / d)).collect())
    assert got == "<feed><provider>p</provider><jobs><job><t>A &amp; &lt;b&gt;</t><d><![CDATA[x]]]]><![CDATA[>y]]></d><x></x></job><job><t></t><d><![CDATA[{{who}}]]></d><x></x></job></jobs><by>me &amp; co</by></feed>"
    with pytest.raises(ValueError, match="nope"):
        template.render(df, record, {"title": "nope"})


def whole(spark, path):
    return "".join(r["value"] + "\n" for d in ("0-open", "1-records", "2-close") for r in spark.read.text(f"{path}/{d}").collect())


def test_template_blocks(spark, tmp_path):
    text = "<feed><jobs><job><t>{{ title }}</t><campaign><id>{{cid}}</id></campaign></job></jobs></feed>"
    df = spark.createDataFrame([("A & B", 7, "x<y"), ("C", 8, None)], "col string, cid int, `my pay` string").coalesce(1)
    column, static = (lambda v: {"source_type": "column", "value": v}), (lambda v: {"source_type": "static", "value": v})
    template.build(
        df, text, {"title": "col", "cid": "cid"}, str(tmp_path / "f"), static={"who": "me"}, headers={"provider": static("p&q"), "part": column("cid"), "islast": column("none")},
        transforms={"title": [{"function": "concat", "args": ["-", "$col", "$who", "$my pay"]}]}, campaign=[{"name": " n ", **column("my pay")}, {"name": ""}],
        salary={"enabled": True, "fields": {"min": column("cid"), "type": static("yearly")}}, awm={"enabled": False},
    )
    got = whole(spark, tmp_path / "f").replace("\n", "")
    head = "<provider>p&amp;q</provider><providerurl></providerurl><isfullfeed></isfullfeed><part>7</part><islast></islast>"
    first = "<job><t>A &amp; B-me-x&lt;y</t><campaign><id>7</id><customfields><customfield><name>n</name><value>x&lt;y</value></customfield></customfields></campaign><salary><min>7</min><max></max><type>yearly</type><currency></currency></salary></job>"
    assert got.startswith(f"<feed>{head}<jobs>{first}<job><t>C-me-</t>") and validate.xml_faults(got.encode()) == []
    awm = template.render(df, "<job><t>{{title}}</t></job>", {"title": "col"}, campaign=[{"name": "n", **static("v")}], awm={"enabled": True, "fields": {"email": static("a@b")}})
    assert df.select(awm).first()[0] == "<job><t>A &amp; B</t><campaign><customfields><customfield><name>n</name><value>v</value></customfield></customfields></campaign><awm><method></method><format></format><email>a@b</email><apikey></apikey></awm></job>"
    assert template.auto_match(["Employer", "Zip Code", "Start"], ["company", "postalcode", "title"]) == {"company": "Employer", "postalcode": "Zip Code"}


def test_builder_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><jobs><job id='1'><t>A</t><p><c>X</c></p></job><job id='2'><t>B</t></job></jobs><subjob><t>no</t></subjob></feed>")
    path = str(tmp_path / "a.xml")
    assert feeds.detect_record_path(spark, path) == "/feed/jobs/job"
    for wanted in (None, "/feed/jobs/job", "//job", "jobs/job"):
        rows = [r["fields"] for r in feeds.read_records(spark, path, wanted).orderBy("rec_idx").collect()]
        assert rows == [{"@id": "1", "id": "1", "t": "A", "p/c": "X", "c": "X"}, {"@id": "2", "id": "2", "t": "B"}]
    names, rows = feeds.records_preview(feeds.read_records(spark, path))
    assert names == ["c", "id", "t", "@id", "p/c"] and rows.columns == ["col_0", "col_1", "col_2", "col_3", "col_4"] and [r["col_2"] for r in rows.collect()] == ["A", "B"]
    (tmp_path / "b.xml").write_text("<a/>")
    assert feeds.detect_record_path(spark, str(tmp_path / "b.xml")) == "/root/item"


def test_wide_table_and_exports(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    paths = feeds.wide_table(spark, str(tmp_path / "a.xml"), "xml", str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(paths) == ["@id", "location/city", "location/state", "tags", "title"] and set(table.columns) == {"id", "raw_content", *paths} and "<title>A</title>" in table.where("title = 'A'").first()["raw_content"]
    rows, n = predicates.preview(table, paths, filters=[{"field": "title", "operator": "In List", "value": "A,B"}])
    assert n == 2 and rows.columns == ["_row_id", "_raw_content", *paths] and [r["title"] for r in rows.collect()] == ["A", "B"]
    for what, fmt in (("query", "csv"), ("query", "json"), ("stats", "csv"), ("stats", "json"), ("stats", "html"), ("duplicates", "json")):
        sinks.export_analysis(table, paths, what, fmt, str(tmp_path / f"{what}-{fmt}"), field="tags")
    listed = json.loads(whole(spark, tmp_path / "query-json"))
    assert {r["title"] for r in listed} == {"A", "B"} and {"Record ID", "Raw XML/JSON Content"} < set(listed[0]) and json.loads(whole(spark, tmp_path / "duplicates-json")) == []
    assert next((tmp_path / "query-csv").glob("part*.csv")).read_bytes().startswith(b"\xef\xbb\xbfRecord ID,") and len(json.loads(whole(spark, tmp_path / "stats-json"))) == len(paths)
    with pytest.raises(ValueError, match="html"):
        sinks.export_analysis(table, paths, "duplicates", "html", str(tmp_path / "x"))
    assert "location/city" in spark.read.text(str(tmp_path / "stats-html")).first()[0]


def test_merge_of_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.xml").write_text("<s><job><id>1</id><t>two\nlines</t><t>last</t></job><job><id>2</id></job></s>")
    (tmp_path / "d" / "a.xml").write_text("<s><item><id> 2\t</id></item><item><id>3</id></item></s>")
    (tmp_path / "feeds.txt").write_text(f"# list\n{tmp_path}/a.xml\n\n{tmp_path}/d/a.xml\n{tmp_path}/a.xml\n{tmp_path}/gone.xml\n")
    sources = feeds.read_sources(spark, str(tmp_path / "feeds.txt"))
    assert [s["path"][len(str(tmp_path)) :] for s in sources] == ["/a.xml", "/d/a.xml", "/gone.xml"] and feeds.source_key({"type": "sftp", "host": "h", "remote_path": "/p"}) == "sftp://h/p"
    figures = merge.merge(spark, sources, str(tmp_path / "out.xml"), state=str(tmp_path / "known"))
    assert [figures[k] for k in ("total_feeds", "successful_feeds", "failed_feeds", "jobs_parsed", "jobs_written", "duplicates_removed", "well_formed")] == [3, 2, 1, 4, 3, 1, True]
    assert "two\nlines" in whole(spark, tmp_path / "out.xml") and validate.xml_faults(whole(spark, tmp_path / "out.xml").encode()) == []
    assert merge.merge(spark, sources, str(tmp_path / "again.xml"), state=str(tmp_path / "known"))["jobs_written"] == 0
    figures = merge.merge(spark, sources, str(tmp_path / "out.json"))
    assert json.loads(whole(spark, tmp_path / "out.json")) == [{"id": "1", "t": "last"}, {"id": "2"}, {"id": "3"}] and figures["well_formed"]
    merge.write_statistics(spark, figures, str(tmp_path / "figures"))
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "figures")).collect()))["jobs_written"] == 3
    (tmp_path / "out.xml" / "1-records" / "part-bad.txt").write_text("<job>")
    assert not merge.well_formed(spark, str(tmp_path / "out.xml"))


def test_documents_of_any_format(spark, tmp_path):
    rows = [("<a x='1'>t<b>1</b><b>2</b><b/><c> </c><d>q</d></a>", {"a": {"b": ["1", "2", None], "c": "", "d": "q", "@x": "1", "#text": "t"}}), ("<a/>", {"a": None}), ("<a>", None)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x string").coalesce(1)
    made = [r["j"] for r in df.select(convert.xml_to_json("x").alias("j")).collect()]
    assert [j and json.loads(j) for j in made] == [j for _, j in rows]
    back = spark.createDataFrame([(made[0],), ('[{"k": 1}, {"k": "<"}]',), ('{"a": 1, "b": [2, 3]}',)], "j string").coalesce(1)
    assert [r[0] for r in back.select(convert.json_to_xml("j")).collect()] == ['<a x="1">t<b>1</b><b>2</b><b /><c /><d>q</d></a>', "<root><item><k>1</k></item><item><k>&lt;</k></item></root>", "<root><a>1</a><b>2</b><b>3</b></root>"]
    (tmp_path / "a.xml").write_text("<f><j><t>A</t></j><j><t>B</t></j></f>")
    (tmp_path / "b").write_text("<f><j><t>" + "C" * 60 + "</t></j><n/></f>")
    found = {(r["path"], r["kind"], r["new_value"]) for r in convert.diff_documents(spark, str(tmp_path / "a.xml"), str(tmp_path / "b")).collect()}
    assert ("f/n", "Added", None) in found and ("f/j/t", "Added", "C" * 45 + "...") in found and ("f/j/size()", "Removed", None) in found
    (tmp_path / "c.csv").write_text("k,v\n1,x\n2,y\n")
    assert {tuple(r) for r in convert.document_paths(spark, str(tmp_path / "c.csv")).collect()} >= {("rows/size()", "2"), ("rows[1]/v", "y")}
    kinds = spark.createDataFrame([("a.TXT", b"<"), ("a", b" \n<x"), ("a", b"[1"), ("a", b"k,v"), ("a.json", b"")], "p string, c binary")
    assert [r[0] for r in kinds.coalesce(1).select(convert.sniff_format(F.col("p"), F.col("c"))).collect()] == ["csv", "xml", "json", "csv", "json"]


def test_validation(spark, tmp_path):
    cases = {
        "ok.xml": ("<r><!-- c --></r>", None), "tags.xml": ("<c>\n<title>x</author>\n</c>", "Tag Mismatch"), "entity.xml": ("<c>&bad;</c>", "Invalid Entity"), "cdata.xml": ("<c><![CDATA[x</c>", "Malformed CDATA"), "empty.xml": ("", "Unexpected EOF"),
        "twice.xml": ("<?xml version='1.0'?>\n<?xml version='1.0'?><c/>", "Duplicate Declaration"), "cut.xml": ("<c><b>", "Unexpected EOF"), "ok.json": ('{"k": [1]}', None), "open.json": ('{"key": "value"', "Tag Mismatch"),
        "comma.json": ('{"key": "value",}', "Invalid Attribute"), "between.json": ('{"key": "val" "key2": 1}', "Malformed XML"), "again.json": ('{"k": 1, "k": 2}', "Invalid Attribute"), "token.json": ('{"key": value}', "Malformed XML"), "list.json": ("[1, 2, ]", "Invalid Attribute"),
    }
    for name, (text, _) in cases.items():
        (tmp_path / name).write_text(text)
    rows = {}
    for r in validate.validate(spark, str(tmp_path)).collect():
        rows.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert {n: rows[n][0]["category"] if n in rows else None for n in cases} == {n: c for n, (_, c) in cases.items()}
    first = rows["tags.xml"][0]
    assert (first["line"], first["tag_name"], first["reference_tag"], first["reference_line"], first["error_number"], first["severity"]) == (2, "author", "title", 2, 1, "Fatal") and first["context_lines"][1]["is_error_line"]
    assert rows["empty.xml"][0]["severity"] == "Fatal" and validate.summary(validate.validate(spark, str(tmp_path))).count() >= 2


def test_validation_messages(spark):
    # Messages, with category, tag, reference tag and line.
    rows = [
        ("Opening and ending tag mismatch: jobs line 3 and job", "Tag Mismatch", "job", "jobs", 3), ("Input is not proper UTF-8, indicate encoding !", "Invalid Encoding", None, None, None), ("Entity 'x' not defined", "Invalid Entity", "x", None, None),
        ("undefined entity &y;", "Invalid Entity", "y", None, None), ("CDATA not finished", "Malformed CDATA", None, None, None), ("Premature end of data in tag a", "Unexpected EOF", None, None, None), ("Extra content at the end of the document", "Unexpected EOF", None, None, None),
        ("XML declaration allowed only at the start of the document", "Duplicate Declaration", None, None, None), ("Namespace prefix dc is not defined", "Namespace Error", "dc", None, None), ("xmlChar 0x1b out of range", "Illegal Character", "U+1B", None, None),
        ("Attribute id redefined", "Invalid Attribute", "id", None, None), ("Tag b was not closed", "Malformed XML", "b", None, None), ("whatever", "Malformed XML", None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, m string").orderBy("i")
    m = F.col("m")
    got = df.select(m, validate.category(m, F.lit("xml")), validate.tag_name(m), validate.reference_tag(m), validate.reference_line(m)).collect()
    assert [tuple(r) for r in got] == rows


def test_validation_of_files(spark, tmp_path):
    flat = "<r>" + "<x>1</x>" * 300 + "</y>"
    files = {"a.xml": b"<?xml version='1.1'?>\n<n:r xmlns:n='http://n' xmlns='u'>\n<n:x/>\n</n:r>", "flat.xml": flat.encode(), "none.xml": b"", "bad.xml": b"<r>\xe9\xfc</r>", "low.xml": b"<r>\x02</r>", "dup.xml": b"<r a='1' a='2'/>", "pre.xml": b"<p:r/>", "q.json": b"[1,\n2]\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    errors = validate.validate(spark, [str(tmp_path), str(tmp_path / "missing.xml")])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in errors.where("error_number = 1").collect()}
    assert {n: (r["category"], r["severity"]) for n, r in rows.items()} == {
        "a.xml": ("Malformed XML", "Warning"), "flat.xml": ("Tag Mismatch", "Fatal"), "none.xml": ("Unexpected EOF", "Fatal"), "bad.xml": ("Invalid Encoding", "Fatal"), "low.xml": ("Illegal Character", "Fatal"),
        "dup.xml": ("Invalid Attribute", "Fatal"), "pre.xml": ("Namespace Error", "Error"), "missing.xml": ("Other", "Fatal"),
    }
    assert len(rows["flat.xml"]["context_lines"]) > 1 and sum(c["is_error_line"] for c in rows["flat.xml"]["context_lines"]) == 1
    assert rows["dup.xml"]["tag_name"] == "a" and rows["missing.xml"]["line"] == 0
    info = {r["filename"]: r for r in validate.file_info(spark, str(tmp_path)).collect()}
    assert (info["a.xml"]["root_element"], info["a.xml"]["namespace_count"], info["a.xml"]["xml_version"], info["a.xml"]["line_count"]) == ("r", 2, "1.1", 3)
    assert (info["none.xml"]["line_count"], info["q.json"]["line_count"], info["flat.xml"]["line_count"], info["flat.xml"]["xml_version"]) == (1, 2, 1, "1.0") and info["flat.xml"]["file_size"] == len(flat)
    for fmt in ("csv", "json", "html", "txt"):
        sinks.validation_report(validate.file_info(spark, str(tmp_path)), errors, str(tmp_path / f"report-{fmt}"), fmt)
    whole = lambda fmt: "\n".join(r["value"] for r in spark.read.text([str(tmp_path / f"report-{fmt}" / d) for d in ("0-open", "1-records", "2-close")]).collect())
    listed = json.loads("".join(r["value"] for d in ("0-open", "1-records", "2-close") for r in spark.read.text(str(tmp_path / "report-json" / d)).collect()))
    assert {x["filename"]: x["error_count"] for x in listed}["q.json"] == 0 and next(x for x in listed if x["filename"] == "dup.xml")["errors"][0]["category"] == "Invalid Attribute"
    assert "Tag Mismatch" in whole("html") and "&lt;" not in whole("html").split("<table>")[0]
    part = next((tmp_path / "report-csv").glob("part*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfError#,Severity,Line,Column,ByteOffset,Category,Message")
    assert "not proper UTF-8" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report-txt")).collect())
    with pytest.raises(ValueError, match="report"):
        sinks.validation_report(info, errors, str(tmp_path / "x"), "pdf")
    assert [r["message"].lower() for r in sinks.sorted_errors(errors, "message", True).collect()] == sorted((r["message"].lower() for r in errors.collect()), reverse=True)


def test_streaming_ingest(spark, tmp_path):
    schema = "source_idx int, rec_idx long, fields map<string,string>"
    for k in range(2):
        spark.createDataFrame([(0, 10 * k + i, {"id": str(i + k)}) for i in range(4)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "known"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["rec_idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 13]
    one, many = (earlier(spark, str(tmp_path / "known"), n)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 2000))
    assert len(many) - len(one) < 20 and earlier(spark, str(tmp_path / "known"), 1).count() == 4


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLES])
def test_catalogue_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "pages"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_json_path_beyond_the_head(spark, tmp_path):
    def detected(text):
        path = tmp_path / "f.json"
        path.write_text(text, encoding="utf-8")
        return feeds.detect_json_path(spark, str(path))

    row = json.dumps({"title": 'é "x" [{' * 20, "tags": ["a", {"b": []}]}, ensure_ascii=False)
    large = '{"now": {"n": 1, "positions": [' + ",".join([row] * (feeds.HEAD // len(row) + 1000)) + "]}}"
    assert len(large.encode()) > feeds.HEAD and detected(large) == "now.positions.item"
    assert detected(large[:100_000]) == detected("\ufeff" + large[:100_000]) == "now.positions.item"
    assert detected('{"a": [1, 2], "b": [[], {}], "c": [{}') == "b.item" and detected("[{}, {}]") == "item" and detected("<a/>") == "item"


def test_first_wins_keeps_a_record_of_nulls(spark):
    rows = [(0, 0, {"id": "1"}, "<a/>"), (0, 1, None, None), (0, 2, None, None), (0, 3, {"x": "y"}, None), (0, 4, {"x": "z"}, None)]
    df = spark.createDataFrame(rows, "source_idx int, rec_idx long, fields map<string,string>, raw string")
    assert {r["rec_idx"] for r in dedup.first_wins(df).collect()} == {0, 1, 3, 4}
    assert {r["rec_idx"] for r in dedup.first_wins(df.drop("raw")).collect()} == {0, 1, 3, 4}


@pytest.mark.parametrize("size", [20_000, 80_000])
def test_strip_takes_linear_time(spark, size):
    text = "a" + " " * size + "b"
    df = spark.createDataFrame([(f"　\x1f {text}  \t\x85",), (None,), (" \xa0",)], "x string").coalesce(1)
    assert [r[0] for r in df.select(strip(F.col("x"))).collect()] == [text, None, ""]


def test_one_file_is_joined_without_a_sort(spark, tmp_path, monkeypatch):
    """The task that writes a file takes the rows as they come; before, it sorted all of them."""
    rows = spark.range(0, 3000, 1, 23).select(F.when(F.col("id") % 5 > 0, F.concat(F.lit("é "), "id")).alias("value"))

    def refused(*_):
        raise AssertionError("a sort in one task")

    monkeypatch.setattr(type(rows), "sortWithinPartitions", refused)
    sinks.one_file(["[", rows.where("value is null or value <> ''"), "", rows.limit(0), "]"], f"file:{tmp_path}/new dir/a b.txt")
    lines = [f"é {i}" if i % 5 else "" for i in range(3000)]
    assert (tmp_path / "new dir/a b.txt").read_text() == "\n".join(["[", *lines, "", "]", ""])
    assert [p.name for p in (tmp_path / "new dir").iterdir() if not p.name.startswith(".")] == ["a b.txt"]


def test_json_file_rows_are_not_sorted_again(spark, tmp_path, monkeypatch):
    """The items of an array in one file come as the rows lie; before, they were written and sorted by their place."""
    plans, whole_file = [], sinks.whole_file

    def seen(session, path, parts, write):
        plans.extend(p._jdf.queryExecution().executedPlan().toString() for p in parts if not isinstance(p, str))
        whole_file(session, path, parts, write)

    monkeypatch.setattr(sinks, "whole_file", seen)
    rows = spark.range(0, 3000, 1, 23).select(F.when(F.col("id") > 300, F.format_string('{"é,": %d}', "id")).alias("value"))
    for name, kept in (("some", rows.where("value is not null")), ("nulls", rows), ("none", rows.limit(0))):
        sinks.json_array(kept, f"{tmp_path}/{name}.json", as_file=True)
    items = "\n,".join(f'{{"é,": {i}}}' for i in range(301, 3000))
    assert (tmp_path / "some.json").read_text() == f"[\n{items}\n]\n" and (tmp_path / "none.json").read_text() == "[\n]\n"
    assert json.loads((tmp_path / "nulls.json").read_text()) == [{"é,": i} for i in range(301, 3000)]
    assert len(plans) == 3 and not any(x in plan for plan in plans[:2] for x in ("Sort", "Exchange"))


def test_ranges_of_a_sort_are_bounded(spark, monkeypatch):
    """A task sorts a bounded number of rows, however adaptive execution would merge the ranges."""
    monkeypatch.setattr(tables, "SORT_ROWS", 1000)
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("id"))
    for df in (rows, rows.where("id < 1"), rows.limit(0)):
        ranges = [[r["id"] for r in part] for part in tables.in_order(df, "id").rdd.glom().collect()]
        assert [i for part in ranges for i in part] == sorted(r["id"] for r in df.collect()) and max(map(len, ranges), default=0) < 4000


def test_files_written_whole(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 7).select(F.col("id"), F.concat(F.lit('q "'), "id", F.lit(", é")).alias("t, x"), F.when(F.col("id") % 3 == 0, F.lit("")).alias("e"))
    sinks.export(rows, str(tmp_path / "a.csv"), "csv", as_file=True)
    data = (tmp_path / "a.csv").read_bytes()
    assert data.count(b"\xef\xbb\xbf") == 1 and data.startswith(b"\xef\xbb\xbfid,") and data.count(b"\n") == 2001
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "a.csv"))
    assert [(r[0], r[1]) for r in back.collect()] == [(str(i), f'q "{i}, é') for i in range(2000)]
    sinks.export(rows.orderBy(F.desc("id")), str(tmp_path / "a.json"), "json", as_file=True)
    assert [r["id"] for r in json.loads((tmp_path / "a.json").read_text())] == list(range(1999, -1, -1))
    with pytest.raises(FileExistsError):
        sinks.export(rows, str(tmp_path / "a.json"), "json", as_file=True)
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.one_file(["[", rows.select((F.lit(1) / (F.col("id") - 1500)).cast("string").alias("value")), "]"], str(tmp_path / "b.json"))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.csv", "a.json"]
    errors = spark.createDataFrame([(1, "Fatal", 2, 3, "Tag Mismatch", "m")], "error_number int, severity string, line int, column int, category string, message string")
    assert [r[0] for r in sinks.error_lines(errors).collect()] == ["1\tFatal\t2\t3\tTag Mismatch\tm"] and sinks.output_preview(spark.read.text(str(tmp_path / "a.csv")).limit(2)) and len(sinks.output_preview(spark.range(500).select(F.col("id").cast("string").alias("value")), 100)) == 100
