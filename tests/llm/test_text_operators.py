"""Language identification, quality rules, license scan, WARC and HTML on small and odd inputs."""

import gzip
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from feedloom.llm import common, html, langid, licenses, minhash, mixing, quality, warc

SF = "/root/testdata/sf0.01"


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 9, 30):
        code = langid.codewords(n)
        near = min((code[a] != code[b]).sum() for a, b in combinations(range(n), 2))
        assert near >= (2 ** (n - 2) if n <= 7 else code.shape[1] // 4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.where(langid.held_out()).withColumnRenamed("lang", "truth").withColumn("score", F.lit("clash")), model)
    right, n = found.agg(F.avg((F.col("truth") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_language_flags_mixed_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null")
    model = langid.fit(docs.where(~langid.held_out()))
    rng, by = random.Random(9), {}
    for r in docs.where(langid.held_out()).collect():
        if len(r["text"].split()) >= 60:
            by.setdefault(r["lang"], []).append(r["text"].split())
    mixed = []
    for _ in range(200):
        x, y = rng.sample(sorted(by), 2)
        mixed.append(" ".join(rng.choice(by[x])[:60] + rng.choice(by[y])[:60]))
    clean = [" ".join(words) for texts in by.values() for words in texts]
    assert model.predict(mixed)[2].mean() > 0.9 and model.predict(clean)[2].mean() < 0.02
    langs, score, unsure = model.predict(["a", "", None, "1 2"])
    assert unsure.tolist() == [True, False, False, False] and score[0] < 0.95 and langs[1:] == ["und"] * 3


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (None, "123 !?", "de"), (6, "the the the " * 60_000, None), (6, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[3, None] == got[4, ""] == got[None, "123 !?"] == ("und", 0.0)
    assert got[6, "the"][0] == got[6, rows[5][1]][0] == "en" and got[2, rows[1][1]][0] == "de"
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(docs.limit(0), nothing).count() == 0
    one = langid.fit(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify(docs, one).collect()} == {"und", "de"}
    assert langid.keep_identified(docs).columns == docs.columns and langid.keep_identified(docs).count() == 4


def test_language_without_labels_or_neighbours(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, "123 !?", None), (3, None, None), (4, "Katze", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} == {1, 4}
    for texts in (["abc def", "x", "", "yz"], ["x", "1", "é"]):
        together, owner, _ = langid._grams(texts)
        for i, text in enumerate(texts):
            assert [g[owner == i].tolist() for g in together] == [g.tolist() for g in langid._grams([text])[0]]


def repeated(words):
    n = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i in range(len(words) - 2) for k in range(3) if n[tuple(words[i : i + 3])] > 1})


def test_quality_measures(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "x y z x y z", "a b a b a b", "\n\nA\na\nA\n \t", "# $ | <b>", "é\x0b😀 é"] + ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s", "z") for i, t in enumerate(texts)] + [(0, None, None, "z")], "doc_id long, text string, source string, words string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        words, lines = [w for w in re.split(r"[ \t-\r]+", t or "") if w], [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines)) and got[i]["n_repeat_words"] == repeated(words)
        assert got[i]["base_failed"] == (len(words) < 50 or 2 * got[i]["n_repeat_words"] > len(words))
    assert quality.judge(docs).count() == len(texts) + 1 and quality.judge(docs.limit(0)).count() == 0


def test_quality_lines(spark):
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    menu = "Home About 2024 " + own(40)
    docs = [(i, f"{menu.replace('2024', str(i))}\n{own(60)}", "h") for i in range(40)]  # frequent, but not depleted
    docs += [(100 + i, f"{menu}\n{own(12)}", "h") for i in range(10)]  # depleted
    docs += [(200 + i, own(70), "h") for i in range(30)] + [(300 + i, docs[0][1], "other") for i in range(50)]  # exact copies count once
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    kept = {r["doc_id"] for r in quality.judge(df).where("kept").collect()}
    assert kept == {i for i, _, _ in docs if not 100 <= i < 200}
    out = {r["doc_id"]: r for r in quality.filter_quality(df).collect()}
    assert set(out) == kept and out[3]["text"] == docs[3][1].split("\n")[1] and out[3]["n_chars"] == len(out[3]["text"])
    assert out[200]["text"] == docs[50][1] and out[300]["text"] == docs[0][1]


def test_quality_lines_by_table_and_by_text(spark, monkeypatch):
    rng = random.Random(14)
    common = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    own = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(45))
    rows = [(i, "\n".join([own(), *rng.choices(common, k=rng.randrange(0, 9)), " ", "END "]), rng.choice(["x", "x", "x", "y", None])) for i in range(500)]
    rows += [(1000 + i, *rows[0][1:]) for i in range(30)] + [(None, None, None)]
    held = {}
    for _, text, source in rows:
        for line in {" ".join(x.split()) for x in (text or "").lower().split("\n")} - {""}:
            held.setdefault((source, line), set()).add(text)
    often = {k for k, texts in held.items() if len(texts) > quality.LINE_DOCS}
    assert 20 < len(often) < len(held)
    want, rest = {}, {}
    for i, text, source in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if (source, " ".join(x.lower().split())) not in often]
        n, gone = len((text or "").split()), len((text or "").split()) - len(" ".join(left).split())
        want[i] = (gone, n >= 50 and 2 * repeated((text or "").split()) <= n and n - gone >= 0.5 * n)
        rest[i] = "\n".join(left)
    assert 100 < sum(k for _, k in want.values()) < 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (quality.LOOKUP_LINES, 0):
        monkeypatch.setattr(quality, "LOOKUP_LINES", limit)
        assert {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in quality.judge(docs).collect()} == want
        assert {r["doc_id"]: r["text"] for r in quality.filter_quality(docs).collect()} == {i: rest[i] for i, (_, k) in want.items() if k}


def test_license_places_and_blocks(spark):
    filler = "lorem ipsum dolor " * 50
    mit = next(t for k, _, t in licenses.DEFAULT_TEMPLATES if k == "mit")
    texts = [None, "", "Under THE mit, license! under the MIT license", "Apache License\nVersion 2.0", filler + mit + " " + filler, filler + mit[:60], "GNU General Public License, version 3. This work is licensed under the", "CC-BY-NC", "permission to copy"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r["doc_id"]: r for r in licenses.summarise(licenses.scan(docs)).collect()}
    assert [got[i]["labels"] for i in range(9)] == ["", "", "mit", "apache-2", "mit", "", "gpl-3", "cc-by-nc", ""]
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (2, 0, 4, 8) and got[0]["first_word"] is None
    assert got[4]["score"] == 1.0 and got[4]["base_labels"] == "" and got[5]["score"] == 0.0 and licenses.scan(docs.limit(0)).count() == 0


def test_license_join_is_exact():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(90)]
    templates = [(f"t{i}", f"f{i}", " ".join(rng.choice(vocabulary[: 5 + 8 * (i % 9)]) for _ in range(rng.randrange(3, 150)))) for i in range(30)]
    index = licenses.Index.build(templates, {w.encode(): rng.randrange(9) for w in vocabulary}, 0.75)
    for _ in range(100):
        words = [rng.choice(vocabulary + ["x"] * 60).encode() for _ in range(rng.randrange(0, 400))]
        want = []
        for label, _, text in templates:
            wanted, stride = {w.encode() for w in text.split()}, 32
            while stride < len(text.split()):
                stride *= 2
            for start in range(0, len(words), stride):
                block = words[start : start + 2 * stride]
                if len(wanted & set(block)) >= 0.75 * len(wanted):
                    want.append((start, start + len(block), label))
        assert sorted(m[:3] for m in index.matches(words)) == sorted(want)


def test_license_templates_are_found_at_every_offset():
    rng = random.Random(3)
    half = [f"w{i}" for i in range(32)]
    templates = [("short", "a", "one two three"), ("twice", "b", " ".join(half + half[:30])), ("long", "c", " ".join(f"v{rng.randrange(300)}" for _ in range(1600)))]
    index = licenses.Index.build(templates, {}, 0.9)
    for label, _, text in templates:
        for offset in [*range(0, 130), 511, 2047, 2049, 5000]:
            words = [b"x"] * offset + text.encode().split() + [b"x"] * 40
            assert label in {m[2] for m in index.matches(words)}


def test_license_base_places_against_brute_force():
    rng = random.Random(4)
    words = "under the mit license apache version 2 cc by nc".encode().split()
    for _ in range(300):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for phrase in rng.sample(list(licenses.PHRASES), 2):
            at = rng.randrange(len(own) + 1)
            own[at:at] = phrase.encode().split()
        want = [(i, k) for i in range(len(own)) for p, k in licenses.PHRASES.items() if own[i : i + len(p.split())] == p.encode().split()]
        assert sorted(licenses._places(own)) == sorted(want)


def test_warc_restores_pages_that_expand(spark):
    rows = [(i, "http://a/", str(i % 4) + " " * 3_000_000) for i in range(24)]  # a payload of 3 MB is stored in 3 kB
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {i: (3_000_001, None if i >= 20 else 20 + i % 4) for i in range(24)}
    batch = pa.RecordBatch.from_pydict({"size": [3, 3, None, 9, 1, 2]})
    assert [c.column("size").to_pylist() for c in common.text_chunks(batch, "size", 6)] == [[3, 3, None], [9], [1, 2]]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>same</p>"), (4, "http://a/4", "<p>same</p>"), (2, "http://b/\r\nx", None), (3, None, ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n\r\n\r\né😀"), (None, "n", "<p>same</p>"), (4, "again", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(1, 11, "revisit", 4), (4, 11, "response", None), (4, 11, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (5, len(rows[4][2].encode()), "response", None), (-1, 11, "revisit", 4)], key=repr)
    empty = next(r for r in warc.round_trip(pages).collect() if r["page_id"] == 3)
    assert empty["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.round_trip(pages.limit(0)).count() == 0
    warc.archive(pages, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    warc.export(warc.restore(spark, f"{tmp_path}/a"), f"{tmp_path}/warc")
    assert warc.read_files(spark, f"{tmp_path}/warc/part*").count() == len(rows)
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part*"))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data[:0]) + gzip.compress(data))
    assert warc.read_files(spark, f"{tmp_path}/x.warc.gz").select("fields").count() == len(rows)


def test_html_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><script>if(a<b)"</p>"</script></head><body><header>Site</header><nav><li>Menu</nav>
    <div class="cookie-notice">We use</div><main><article><header><h1>A &amp; B</h1></header><p>One&nbsp;two <b>three<br>four<p>Five</p><aside>Side</aside>
    <div id="comments"><p>Nice!</p></div><ul><li>x<li>y</ul><form>Mail</form><!-- gone --></article></main><div class="ad">Buy</div><footer>&copy; z</footer>"""
    assert [t for p, t in html.lines_of(page) if p == html.MAIN] == ["A & B", "One two three four", "Five", "x", "y"]
    assert html.lines_of("") == [] and html.lines_of("a < b & c") == [(html.LOOSE, "a < b & c")] and html.lines_of("<p title='>'>q</p") == [(html.LOOSE, "q</p")]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_alignment_is_longest():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        at = html.shared_places(a, b)
        assert len(at) == longest(a, b) and at == sorted(at) and longest([a[i] for i in at], b) == len(at)


def test_html_differencing(spark):
    shell = "<body><p>Welcome to our site</p><p>{}</p><p>{}</p><p>All rights kept</p></body>"
    rows = [(i, f"http://h/{i}", shell.format(f"story {i} " * 9, f"more {i} " * 9)) for i in range(6)]
    rows += [(10, "http://c/1", shell.format("copy", "text")), (11, "http://c/2", shell.format("copy", "text")), (12, None, None), (13, "http://[bad", "<article>ok</article>"), (14, "http://a/x", "<p>nav</p><article><p>Lead</p><p>Same</p></article>"), (15, "http://a/y", "<article><p>Other</p><p>Same</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract(df.coalesce(1)).collect()}
    assert got[2] == " ".join(["story 2"] * 9) + "\n\n" + " ".join(["more 2"] * 9)
    assert got[10] == got[11] == "Welcome to our site\n\ncopy\n\ntext\n\nAll rights kept"
    assert (got[12], got[13], got[14], got[15]) == ("", "ok", "Lead\n\nSame", "Other\n\nSame") and html.extract(df.limit(0)).count() == 0


def test_html_differencing_inside_articles(spark):
    shell = "<body><nav>Menu</nav><article><p>Share this story</p><p>{}</p><p>All our stories are free</p></article></body>"
    rows = [(i, f"http://h/{i}", shell.format(f"story {i} " * 9)) for i in range(4)]
    rows += [(10 + i, f"http://c/{i}", shell.format("one long text " * 9) + f"<p>{i}</p>") for i in range(2)]  # copies stay whole
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df.coalesce(1)).collect()}
    assert [got[i] for i in range(4)] == [" ".join([f"story {i}"] * 9) for i in range(4)]
    assert got[10] == got[11] == "Share this story\n\n" + " ".join(["one long text"] * 9) + "\n\nAll our stories are free"


def test_html_pairs_beyond_copies_and_borders(spark):
    shell = "<body><p>Welcome to our site</p><p>{}</p><p>All rights kept</p></body>"
    rows = [(i, f"http://h/{i:03}", shell.format("one story " * 9) + f"<p>{i}</p>") for i in range(100, 130)]  # a group of near copies
    rows += [(i, f"http://h/{i:03}", shell.format(f"other {i} " * 9)) for i in (130, 131)]
    rows += [(i, f"http://h/{i:03}", shell.format("last story " * 9) + f"<p>{i}</p>") for i in range(200, 230)]
    rows += [(300, "http://k/1", "<p>a long shell of many words that every page has</p><p>short one</p>"), (301, "http://k/2", "<p>a long shell of many words that every page has</p>" + "<p>" + "story " * 40 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r["page_id"]: r["text"] for r in html.extract(df.repartition(3)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert len(got) == len(rows)
        assert all(got[i] == " ".join(["one story"] * 9) + f"\n\n{i}" for i in range(100, 130))
        assert got[130] == " ".join(["other 130"] * 9) and got[131] == " ".join(["other 131"] * 9)
        assert all(got[i] == " ".join(["last story"] * 9) + f"\n\n{i}" for i in range(200, 230))
        assert got[300] == "short one" and got[301] == " ".join(["story"] * 40)


def _common(a, b):
    """Places in ``a`` of a longest common subsequence, from the table of lengths; the last lines of ``a`` stay out first."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


def _pages_in_one_list(rows):
    """Texts by page_id of (page_id, host, path, whether an article, lines), all pages in one sorted list."""

    def shared(page, other):
        """Places of the lines that go from ``page``; None for copies."""
        (_, _, _, article, a), (_, _, _, their, b) = page, other
        if a == b and article == their:
            return None
        # an article has a dropped menu before it, which two articles share
        gone = {i - article for i in _common(["menu"] * article + a, ["menu"] * their + b) if i >= article}
        both, own, others = (sum(len(x.split()) for x in part) for part in ([a[i] for i in gone], a, b))
        most = 2 * both >= own if article else 2 * both > max(own, others)
        return None if both == own or most else gone

    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    run, pairs, seen = [0], {}, {}
    for last, page in zip(rows, rows[1:], strict=False):
        gone = shared(page, last) if page[1] == last[1] else None
        run.append(run[-1] + (page[1] != last[1] or gone is not None))
        if gone is not None:
            pairs[page[1]] = pairs.get(page[1], 0) + 1
            for line in {page[4][i] for i in gone}:
                seen[page[1], line] = seen.get((page[1], line), 0) + 1
    out = {}
    for k, page in enumerate(rows):
        before = max((i for i in range(len(rows)) if run[i] < run[k]), default=None)
        after = min((i for i in range(len(rows)) if run[i] > run[k]), default=None)
        found = [shared(page, rows[i]) for i in (before, after) if i is not None and rows[i][1] == page[1]]
        gone = next((x for x in found if x is not None), set())
        often = {x for (h, x), n in seen.items() if h == page[1] and n >= 2 and 2 * n > pairs[h]}
        out[page[0]] = "\n\n".join(x for i, x in enumerate(page[4]) if i not in gone or page[3] and x not in often)
    return out


def test_html_equals_pages_in_one_list(spark):
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    rows = []
    for i in range(200):
        host, own = rng.randrange(4), [rng.choice(lines) for _ in range(rng.randrange(0, 9))]
        if rows and rng.random() < 0.4:  # a near copy
            own = [x for x in rows[-1][4] if rng.random() < 0.9]
        elif host == 3:  # a host whose articles have a frame; on the others only chance makes lines equal
            own = ["read more stories", *own, "write to us"]
        rows.append((i, f"h{host}", f"/{rng.randrange(50):02}", bool(i % 3), own))
    want = _pages_in_one_list(rows)
    frames = [want[i] for i, h, _, article, own in rows if h == "h3" and article and own[:1] == ["read more stories"]]
    assert sum("read more" not in x for x in frames) > 10
    made = []
    for i, host, path, article, own in rows:
        body = "".join(f"<p>{x}</p>" for x in own)
        made.append((i, f"http://{host}{path}", f"<nav>x</nav><article>{body}</article>" if article and own else f"<nav>x</nav>{body}" if article else body))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 7, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found = html.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(n + 1))
        got = {r["page_id"]: r["text"] for r in found.collect()}
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert got == want


def test_html_keeps_sentences_of_articles(spark):
    page = "<nav>Menu</nav><article><h1>{0}</h1><p>All stories are free</p><p>{0} begins here</p>{1}</article>"
    quotes = {i: "<p>A line that two articles quote</p>" * (i in (3, 4)) for i in range(9)}
    rows = [(i, f"http://h/{i}", page.format(f"story {i} of many words " * 3, quotes[i])) for i in range(9)]
    rows += [(20 + i, f"http://two/{i}", page.format(f"tale {i} of many words " * 3, "")) for i in range(2)]  # one pair, no second witness
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("two articles quote" in got[i]) == (i in (3, 4)) and "free" not in got[i] for i in range(9))
    assert all("All stories are free" in got[i] for i in (20, 21))


def test_html_aligns_long_pages():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        assert set(html.shared_places(a, b)) == _common(a, b)
    a = [1, 2] * 4000
    began = time.perf_counter()
    assert len(html.shared_places(a, a[1:])) == len(a) - 1
    assert time.perf_counter() - began < 1


def test_html_names_are_whole():
    kept = ['<div class="entry-header"><h1>T</h1></div>', '<p class="related-work">T</p>', '<p class="share-price">T</p>', '<h2 id="search">T</h2>', "<p><math><mi>T</mi></math></p>", '<div class="header">T</div>', '<section id="comment-history">T</section>']
    gone = ['<div class="cookie-notice">T</div>', '<div id="comments">T</div>', '<div class="big ad">T</div>', '<ul class="share_bar">T</ul>', '<div role="navigation">T</div>', "<form>T</form>", '<div class="reader-comments">T</div>']
    assert all((html.MAIN, "T") in html.lines_of(f"<article><p>a</p>{x}</article>") for x in kept)
    assert not any((html.MAIN, "T") in html.lines_of(f"<article><p>a</p>{x}</article>") for x in gone)
    assert html.lines_of("<p>a <!-- open") == [(html.LOOSE, "a")] and html.lines_of("<p>a <b") == [(html.LOOSE, "a <b")]


def test_html_takes_linear_time():
    n = 20_000
    for page in ("<a " * n, "<b>" * n + "</i>" * n, "<b>" * n + "<p></p>" * n, "<b><td>" + "<i>" * n + "</b>" * n, '<a "' * n, "<a '>" + '<a ">' * n, "<!--" * n, "<div>" * n + "x" + "</div>" * n, "<script>" * n, "&amp" * n):
        began = time.perf_counter()
        html.lines_of(page)
        assert time.perf_counter() - began < 3


def test_letters_table():
    assert langid._fold()[ord("É")] == ord("é") and langid._fold()[ord("3")] == 0 and isinstance(langid._fold(), np.ndarray)


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(11)
    own = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(70))
    rows = [(i if i else None, f"Menu of this page {'w ' * 5}\n{own()}" if i < 40 else own(), "h" if i < 100 else None, "en", len("x"), "s", -1.5, 2, ["e"], "z") for i in range(120)]
    rows += [(500, None, "h", None, 0, "s", 0.0, 0, [], "z"), (501, "", "h", "en", 0, "s", 0.0, 0, [], "z"), (502, "12 34", None, "en", 5, "s", 0.0, 0, [], "z"), rows[7]]
    names = "doc_id long, text string, source string, lang string, n_chars int, `a.b` string, score double, _n int, each array<string>, `row` string, lang_pred string, _size int, words string"
    docs = spark.createDataFrame([(*r, "l", 9, "w") for r in rows], names)
    plain = [f"`{c}`" for c in docs.columns]
    for stage in (langid.keep_identified, quality.filter_quality, mixing.mixed_documents, minhash.drop_near_duplicates):
        out = stage(docs)
        assert out.columns == docs.columns
        got = {(r[0], r[5], r[6], r[9], r[10], r[11], r[12]) for r in out.select(*plain).collect()}
        assert got and got <= {(r[0], r[5], r[6], r[9], "l", 9, "w") for r in rows}
        assert stage(docs.limit(0)).count() == 0
    removed = {r["doc_id"]: r for r in quality.filter_quality(docs).collect()}
    assert removed[3]["text"] == rows[3][1].split("\n")[1] and removed[3]["n_chars"] == len(removed[3]["text"]) and removed[50]["n_chars"] == 1


def test_every_label_is_learned(spark):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows = [(10 * k + i, " ".join([words[k]] * 5 + [f"{words[k]}{words[k]}"] * 4), f"lang{k}") for k in range(150) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs))
    assert found.where("lang = lang_pred").count() > 0.95 * len(rows)
