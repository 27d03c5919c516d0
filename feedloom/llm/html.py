"""Main text of web pages: nearest-URL page differencing on top of the page structure.

Every page becomes its visible text lines (block elements), each marked by where it stands: in dropped parts (menus, page
headers and footers, sidebars, forms, adverts, notices, comments, scripts; by element, role, or a class or id that names
such a part as a whole, never by a word within another name), inside the page's article or main element, or loose. The parse
is written once. Pages are ordered by host and URL path and cut into buckets at bounds that are taken from the keys, so a
large host spreads over many tasks. The lines of a pair of pages are aligned by their longest common subsequence, and shared
lines are deleted. Inside an article or main element that needs a second witness: at least two, and over half, of the host's
pairs of neighbours that are no copies share the line, so a sentence that two articles have by chance or as a quotation
stays. The structure is a second filter: dropped parts go, and beside an article or main element loose lines go. Reading a
page takes time in proportion to its length, whatever its tags.

Copies of one page must not delete each other, so a page is paired with the nearest page that is no copy of it. Neighbours
in order that are copies form a run; the pages of a run pair with the page before the run on their host, or if there is none
or it is a copy of theirs, with the page after it. A pass over line hashes finds what stands before and after each bucket
(the lines of four pages a bucket, found on the driver; there are as many buckets as shuffle partitions), so texts do not
depend on how the pages are dealt. The same pass counts the witnesses; the lines that may go from the articles of a host (fewer
than twice what an average pair shares) come as a row before its pages.

Only line hashes and compressed text travel. A task holds the pages of a run back only while its partner is still to come.
Defined results: a null html or one without text gives an empty text; a null url has an empty host and path; repeated rows
each come back; ties in the order are broken by page_id; only page_id, url and html are read; an empty table stays empty.
"""

from __future__ import annotations

import bz2
import html
import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise
from math import isqrt
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import save, small_batches, text_chunks, tidy

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*+>""", re.S)
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "select")
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_DROP = frozenset("nav aside footer form head button dialog menu".split())
#: Class names and ids of what is not main text, alone or between _AROUND words that a hyphen or underscore joins.
_DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices outbrain popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar".split())
_AROUND = frozenset("area bar block bottom box container global inner item left list main page panel primary reader right secondary section site thread top user widget wrapper".split())
#: Names that mean the page's parts, and so nothing within an article.
_PAGE_NAMES = frozenset("footer header masthead menu banner".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

_CELLS = frozenset(["td", "th"])
_BORDERS = frozenset(["td", "th", "table", "article", "main", "body"])

DROPPED, LOOSE, MAIN = 0, 1, 2
#: Keys of the sample from which each bucket's bound is taken; there is a bucket for each shuffle partition.
SAMPLED = 30
#: Counts of shared lines that a task holds before it hands them on.
HELD = 100_000


def _named(name: str, inside: bool) -> bool:
    """Whether a class or id, as a whole, names what is not main text."""
    parts = re.split("[-_]", name)
    known = [p for p in parts if p in _DROP_NAMES and not (inside and p in _PAGE_NAMES)]
    return bool(known) and all(p in _DROP_NAMES or p in _AROUND for p in parts)


def _boilerplate(name: str, rest: str, inside: bool) -> bool:
    if name in _DROP or name == "header" and not inside:
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value in _DROP_ROLES:
            return True
        if key == "class" and any(_named(v, inside) for v in value.split()):
            return True
        if key == "id" and name in ("div", "section", "ul", "ol", "table", "header") and _named(value, inside):
            return True
    return False


class _Open:
    """Open elements; what a closing tag or a block ends is found without walking through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # element, dropped, article or main
        self.at: dict[str, list[int]] = {}
        self.borders: list[int] = []
        self.blocks: list[int] = []

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def push(self, name: str, drops: bool, main: bool) -> None:
        k = len(self.stack)
        self.stack.append((name, drops, main))
        self.at.setdefault(name, []).append(k)
        if name in _BORDERS:
            self.borders.append(k)
        if name in _BLOCK or name in _CELLS:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Close all elements from the k-th on."""
        for name, _, _ in self.stack[k:]:
            self.at[name].pop()
        del self.stack[k:]
        for held in (self.borders, self.blocks):
            while held and held[-1] >= k:
                held.pop()

    def closed_by(self, name: str) -> int | None:
        """The element that a closing tag ends: inline ones do not reach out of a cell, table or article."""
        k = (self.at.get(name) or [-1])[-1]
        return None if k < 0 or name not in _BLOCK and self.borders and self.borders[-1] > k else k

    def ended_by(self, names: frozenset[str]) -> int | None:
        """The nearest block, if a block that opens ends it."""
        return self.blocks[-1] if self.blocks and self.stack[self.blocks[-1]][0] in names else None


def lines_of(page: str) -> list[tuple[int, str]]:
    """(place, line) of the visible text blocks of a page, in order; white space is one blank, references are decoded."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    elements, at, last = _Open(), 0, page.rfind(">")

    def flush() -> None:
        if held:
            line = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if line:
                dropped, inside = elements.state()
                out.append((DROPPED if dropped else MAIN if inside else LOOSE, line))

    def end(k: int) -> None:
        """Close the k-th element and what it holds; the text so far belongs to the innermost."""
        if len({e[1:] for e in elements.stack[max(k - 1, 0) :]}) > 1 or k == 0:
            flush()
        elements.cut(k)

    while at <= last and (m := _TAG.search(page, at)) is not None:  # after the last ">" there is text, or an open comment
        held.append(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            held.append(html.escape(m["cdata"]))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in _BLOCK:
                flush()
            elif name in _CELLS:
                held.append(" ")
            if (k := elements.closed_by(name)) is not None:
                end(k)
            continue
        if name in _RAW:
            if not m["rest"].endswith("/"):
                after = _RAW_END[name].search(page, at)
                at = after.end() if after else len(page)
            held.append(" ")
            continue
        if name in _BLOCK:
            flush()
        elif name == "br" or name in _CELLS:
            held.append(" ")
        if name in _VOID:
            continue
        if name in _BLOCK and (k := elements.ended_by(_CLOSES.get(name, _CLOSES["p"]))) is not None:
            elements.cut(k)
        dropped, inside = elements.state()
        drops = dropped or _boilerplate(name, m["rest"], inside)
        main = inside or name in ("article", "main") or 'role="main"' in m["rest"].lower()
        if (drops, main) != (dropped, inside):
            flush()
        elements.push(name, drops, main)
    held.append(re.sub(r"<!(?:--|\[CDATA\[).*", "", page[at:], flags=re.S))
    flush()
    return out


def shared_places(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; of several the one that leaves out the last of ``a``.

    Rows of the table of lengths are whole numbers, in which a zero bit marks where the length grows; every so many are kept
    and the others made again on the way back. Time is the product of the lines over the bits of a machine word.
    """
    both = set(a).intersection(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, step = (1 << len(b)) - 1, isqrt(len(at)) + 1

    def rows(row: int, first: int, end: int) -> Iterator[int]:
        for i in at[first:end]:
            met = row & where[a[i]]
            row = (row + met | row - met) & full
            yield row

    kept = [full, *(r for i, r in enumerate(rows(full, 0, len(at)), 1) if i % step == 0)]
    out, below = [], full  # the columns of ``b`` that are left
    for k in range(len(kept) - 1, -1, -1):
        held = [kept[k], *rows(kept[k], k * step, (k + 1) * step)]
        for i in range(len(held) - 1, 0, -1):
            grown = ~held[i] & below
            if grown.bit_count() > (~held[i - 1] & below).bit_count():
                out.append(at[k * step + i - 1])
                below = (1 << grown.bit_length() - 1) - 1
    return out[::-1]


def _place(url: str | None) -> tuple[str, str]:
    """Host and path."""
    try:
        split = urlsplit(url or "")
        return split.hostname or "", split.path
    except ValueError:
        return "", url or ""


def _key(host: str, path: str, page_id: int | None) -> tuple:
    return host, path, page_id is not None, 0 if page_id is None else page_id


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed pages: host, path, hash, place and words of each line, and the compressed lines that are not dropped."""
    for batch in batches:
        for part in text_chunks(batch, "html"):
            rows = []
            for url, page in zip(*(part.column(c).to_pylist() for c in ("url", "html")), strict=True):
                lines = lines_of(page or "")
                if any(p == MAIN for p, _ in lines):  # the article is all of the text
                    lines = [(DROPPED if p == LOOSE else p, t) for p, t in lines]
                hashes = [zlib.crc32(t.encode()) << 20 ^ zlib.adler32(t.encode()) for _, t in lines]
                kept = bz2.compress("\n".join(t for p, t in lines if p != DROPPED).encode())
                rows.append((*_place(url), hashes, [p for p, _ in lines], [t.count(" ") + 1 for _, t in lines], kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["page_id", "url", "host", "path", "hashes", "places", "words", "kept"])


def _bucketed(bounds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the bucket that their host, path and page_id lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("host", "path", "page_id")), strict=True)
            yield batch.append_column("bucket", pa.array([bisect_right(bounds.value, _key(*k)) for k in keys], pa.int32()))

    return run


def _gone(row: dict, other: dict) -> set[int] | None:
    """Places of the lines of ``row`` that ``other`` has too; None if the pages are copies.

    Loose text is a copy if over half of the larger page is shared, so a short page does not keep the shell of a longer
    one; an article if at least half of its own words are. What would lose every line is a copy as well.
    """

    def live(x: dict) -> int:
        return sum(w for w, p in zip(x["words"], x["places"], strict=True) if p != DROPPED)

    if row["hashes"] == other["hashes"]:
        return None
    gone = {i for i in shared_places(row["hashes"], other["hashes"]) if row["places"][i] != DROPPED}
    both, every = sum(row["words"][i] for i in gone), live(row)
    if both == every or (2 * both >= every if MAIN in row["places"] else 2 * both > max(every, live(other))):
        return None
    return gone


def _breaks(last: dict, now: dict) -> bool:
    """Whether ``now``, which follows ``last``, begins a run."""
    return last["host"] != now["host"] or _gone(now, last) is not None


def _narrow(row: dict | None) -> dict | None:
    return row and {k: row[k] for k in ("host", "hashes", "places", "words")}


def _shared(last: dict, now: dict) -> list[int] | None:
    """Hashes of the lines that a page has in common with the one before it; None if they are copies or of two hosts."""
    gone = _gone(now, last) if last["host"] == now["host"] else None
    return None if gone is None else sorted({now["hashes"][i] for i in gone})


class _Witnesses:
    """Counts of the pairs of neighbours on each host, and of those that share a line, handed on in parts."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int | None], int] = {}

    def add(self, host: str, shared: list[int] | None) -> None:
        for line in () if shared is None else (None, *shared):
            self.counts[host, line] = self.counts.get((host, line), 0) + 1

    def rows(self) -> list[tuple]:
        found = [(None, None, host, line, n) for (host, line), n in self.counts.items()]
        self.counts.clear()
        return found


_EDGES = {"bucket": pa.int32(), "edges": pa.binary(), "host": pa.string(), "line": pa.int64(), "n": pa.int64()}


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket of sorted rows: first and last page, the page after its first break and the one before its last.

    With them, as rows without a bucket, the counts of its ``_Witnesses``.
    """
    bucket = first = last = after = before = None
    seen = _Witnesses()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _EDGES.values(), strict=True)], names=list(_EDGES))

    def ended() -> pa.RecordBatch:
        return out([(bucket, pickle.dumps([_narrow(x) for x in (first, last, after, before)]), None, None, None)])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if first is not None:
                    yield ended()
                bucket, first, last, after, before = row["bucket"], row, None, None, None
            if last is not None:
                shared = _shared(last, row)
                seen.add(row["host"], shared)
                if shared is not None or last["host"] != row["host"]:
                    after, before = after or row, last
            last = row
        if len(seen.counts) > HELD:
            yield out(seen.rows())
    if first is not None:
        yield ended()
    if rows := seen.rows():
        yield out(rows)


def _around(edges: list[tuple[int, list]]) -> dict[int, tuple[dict | None, dict | None]]:
    """The page before the run in which each bucket begins, and the page after the run in which it ends, on the same host."""
    edges = sorted(edges, key=lambda e: e[0])
    out: dict[int, list] = {b: [None, None] for b, _ in edges}
    joined = [None] + [_breaks(x[1], y[0]) for (_, x), (_, y) in pairwise(edges)]
    before = None
    for i, (b, (first, last, _, broke)) in enumerate(edges):
        if joined[i]:
            before = edges[i - 1][1][1]
        out[b][0] = before = before if before and before["host"] == first["host"] else None
        before = broke or before
        before = before if before and before["host"] == last["host"] else None
    after = None
    for i in range(len(edges) - 1, -1, -1):
        b, (first, last, broke, _) = edges[i]
        if i + 1 < len(edges) and joined[i + 1]:
            after = edges[i + 1][1][0]
        out[b][1] = after = after if after and after["host"] == last["host"] else None
        after = broke or after
        after = after if after and after["host"] == first["host"] else None
    return {b: tuple(x) for b, x in out.items()}


def _text(row: dict, gone: set[int] | None) -> str:
    lines = bz2.decompress(row["kept"]).decode().split("\n") if row["kept"] else []
    lines = [x for x in lines if x]
    if gone:
        order = [i for i, p in enumerate(row["places"]) if p != DROPPED]
        lines = [x for i, x in zip(order, lines, strict=True) if i not in gone]
    return "\n\n".join(lines)


def _paired(around) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of the pages of sorted buckets, each against the page before or after its run.

    Before the pages of a host comes a row without a path, if the host has lines that may go from articles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = before = last = None
        known: tuple[str | None, frozenset[int]] = (None, frozenset())
        held: list[dict] = []  # of the present run, without a partner so far
        texts: list[tuple] = []
        kind = pa.int64()

        def out() -> pa.RecordBatch:
            columns = list(zip(*texts, strict=True)) or [[]] * 4
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            texts.clear()
            return made

        def done(row: dict, gone: set[int] | None) -> None:
            known_here = known[1] if known[0] == row["host"] else ()
            text = _text(row, {i for i in gone or () if row["places"][i] == LOOSE or row["hashes"][i] in known_here})
            texts.append((row["page_id"], row["url"], text, len(text)))

        def ended(after: dict | None) -> Iterator[pa.RecordBatch]:
            for row in held:
                done(row, _gone(row, after) if after and after["host"] == row["host"] else None)
                if len(texts) >= 500:
                    yield out()
            held.clear()

        for batch in batches:
            kind = batch.schema.field("page_id").type
            for part in text_chunks(batch, "kept", 1 << 20):
                for row in part.to_pylist():
                    if row["path"] is None:
                        if bucket is not None:
                            yield from ended(around.value[bucket][1])
                        known = row["host"], frozenset(row["hashes"])
                        continue
                    if row["bucket"] != bucket:
                        if bucket is not None:
                            yield from ended(around.value[bucket][1])
                        bucket, last = row["bucket"], None
                        before = around.value[bucket][0]
                    elif _breaks(last, row):
                        yield from ended(row)
                        before = last if last["host"] == row["host"] else None
                    gone = _gone(row, before) if before else None
                    if gone is None:
                        held.append(row)
                    else:
                        done(row, gone)
                    last = row
                yield out()
        if bucket is not None:
            yield from ended(around.value[bucket][1])
            yield out()

    return run


def _spread(bounds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a host, one for each bucket that may have a page of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            ends = [(bisect_left(bounds.value, (h,)), bisect_left(bounds.value, (h + "\0",)) + 1) for h in hosts]
            rows = batch.take(pa.array([i for i, (x, y) in enumerate(ends) for _ in range(x, y)], pa.int64()))
            yield rows.append_column("bucket", pa.array([k for x, y in ends for k in range(x, y)], pa.int32()))

    return run


def _bounds(parsed: DataFrame, buckets: int) -> list[tuple]:
    """The keys at which all buckets but the first begin: quantiles of a sample of SAMPLED keys a bucket."""
    keys, rows = parsed.select("host", "path", "page_id"), parsed.count()
    if rows > buckets * SAMPLED:
        keys = keys.where(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(rows // (buckets * SAMPLED))) == 0)
    found = sorted(_key(*r) for r in keys.collect())
    return [found[len(found) * i // buckets] for i in range(1, buckets)] if found else []


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by an empty line) and n_chars for every row of ``pages`` (page_id, url, html)."""
    pages = small_batches(pages.select("page_id", "url", "html"))
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    narrow = f"page_id {kind}, url string, host string, path string, hashes array<bigint>, places array<tinyint>, words array<int>"
    parsed = save(pages.mapInArrow(tidy(_parsed), f"{narrow}, kept binary"), "html-parsed")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = spark.sparkContext.broadcast(_bounds(parsed, buckets))

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "host", "path", "page_id", "url", "hashes")

    fields = f"{narrow}, kept binary, bucket int"
    found = save(ordered(parsed.drop("kept").mapInArrow(_bucketed(bounds), f"{narrow}, bucket int")).mapInArrow(_edges, "bucket int, edges binary, host string, line bigint, n bigint"), "html-edges")
    edges = sorted(((r["bucket"], pickle.loads(r["edges"])) for r in found.where("edges is not null").select("bucket", "edges").collect()), key=lambda e: e[0])
    around, seen = spark.sparkContext.broadcast(_around(edges)), _Witnesses()
    for (_, x), (_, y) in pairwise(edges):
        seen.add(y[0]["host"], _shared(x[1], y[0]))
    counts = found.where("edges is null").select("host", "line", "n")
    if rows := [r[2:] for r in seen.rows()]:
        counts = counts.unionByName(spark.createDataFrame(rows, counts.schema))
    counts = counts.groupBy("host", "line").agg(F.sum("n").alias("n"))
    pairs = counts.where("line is null").select("host", F.col("n").alias("pairs"))
    frequent = counts.where("line is not null and n >= 2").join(pairs, "host").where("2 * n > pairs").groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("hashes"))
    empty = {"page_id": kind, "url": "string", "path": "string", "places": "array<tinyint>", "words": "array<int>", "kept": "binary"}
    spread = frequent.mapInArrow(_spread(bounds), "host string, hashes array<bigint>, bucket int")
    heads = spread.select("*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    rows = ordered(parsed.mapInArrow(_bucketed(bounds), fields).unionByName(heads))
    return rows.mapInArrow(tidy(_paired(around)), f"page_id {kind}, url string, text string, n_chars long")
