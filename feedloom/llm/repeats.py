"""Removal of byte strings that occur twice or more, by a hash-compared suffix sort.

A window is a place and the ``length`` bytes from it on; it is repeated if another window anywhere holds the same bytes. Each
window has an anchor, the ANCHOR / 25 of its length whose hash is least in it (of equal ones the first), so equal windows have
equal anchors at the same offset. A piece is a stretch of neighbouring windows with one anchor, and its body the bytes they
cover. Windows can only be equal if their pieces' anchors are, so pieces whose anchor occurs once are finished; pieces with equal
bodies are one class, and of a class with several members all windows are repeated.

What remains are anchors with different bodies. Their windows are suffixes of the bodies, cut at ``length`` bytes, and are sorted:
prefix polynomial hashes of the bodies and a binary search over them give the common extension of two suffixes in a logarithmic
number of steps, and a mergesort compares by it. Neighbours in order with a common extension of ``length`` are equal windows.
Collisions are verified: for all neighbours the bytes of the common extension are compared and the next byte must be greater,
which proves order and equality; if it fails, the block is sorted again with another base.

No group meets in one task whole: occurrences are counted before they are shuffled, and an anchor with over ``GROUP`` different bodies
is not sorted but refined. Its windows are split by the side on which they have more room, and the anchor grows by half of the room
on that side; that halves the windows of a piece, and after log2(length) rounds at most a piece is one window and its body the key.

Between tasks texts are named by 80 bits and bodies by 128 (anchor and body); only different bodies with one and the same anchor could
be taken for each other, by 64 bits, which for 10 ** 12 pieces with up to 10 ** 6 bodies an anchor is expected 0.03 times.

Defined results: a null text is an empty one; texts of fewer than ``length`` bytes lose nothing; repeated rows are texts of their own, so each
of two equal texts of ``length`` bytes or more is removed whole; null doc_ids are kept; only doc_id and text are read; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import CHUNK_BYTES, save, small_batches, text_chunks, tidy

LENGTH = 200
#: Bytes of an anchor, in 25ths of the length.
ANCHOR = 8
#: Different bodies of an anchor that are sorted together; more are refined.
GROUP = 4096
#: Bits for the place of an anchor within the bytes of a chunk.
_PLACE = 20
_LONGEST = 350

_PIECES = "g long, v long, h long, place long"
_OPEN = "g long, v long, n long, h long, place long, body binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of an odd base and of its inverse."""
    draw = np.random.default_rng(base)
    odd = int(draw.integers(1 << 62)) * 4 + 3
    powers = []
    for step in (odd, pow(odd, -1, 1 << 64)):
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps))
    up, down = powers
    return draw.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + draw.integers(2, size=256, dtype=np.uint64), up, down


class Prefixes:
    """Prefix hashes of some bytes: ``of(at, size)`` is the same for the same bytes, wherever they are."""

    def __init__(self, data: np.ndarray, base: int = 0) -> None:
        values, up, self.down = _powers(1 << max(10, int(len(data) + 1).bit_length()), base)
        self.total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * up[: len(data)], out=self.total[1:])

    def of(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[at + size] - self.total[at]) * self.down[at]

    def all(self, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` values from each place on."""
    found, done, block, left = None, 0, 1, size
    while left:
        if left & 1:
            found = values if found is None else np.minimum(found[: len(values) - done], values[done:])
            done += block
        left >>= 1
        if left:
            values, block = np.minimum(values[:-block], values[block:]), 2 * block
    return found


def _parts(texts: pa.Array, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) together: short texts in one part, a long one in parts that share length - 1 bytes."""
    together: list[tuple[int, int, bytes]] = []
    for row, text in enumerate(texts):
        raw = text.as_py() or b""
        if len(raw) <= CHUNK_BYTES + length:
            together.append((row, 0, raw))
            continue
        for at in range(0, len(raw) - length + 1, CHUNK_BYTES):
            yield [(row, at, raw[at : at + CHUNK_BYTES + length - 1])]
    if together:
        yield together


def _pieces(length: int, whole: bool):
    """(g, v, h, place) of the pieces of each text, or g alone; place holds offset, mark of the text, windows, offset of the anchor."""
    k = max(1, length * ANCHOR // 25)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                h, mark = (chunk.column(c).to_numpy() for c in ("h", "mark"))
                for part in _parts(chunk.column("text"), length):
                    sizes = np.asarray([len(p[2]) for p in part])
                    data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
                    if len(data) < length:
                        continue
                    prefixes = Prefixes(data)
                    hashes = prefixes.all(k)
                    low = np.uint64((1 << _PLACE) - 1)
                    anchor = (_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
                    ends = np.cumsum(sizes)
                    of = np.repeat(np.arange(len(part)), sizes)[: len(anchor)]
                    at = np.flatnonzero(np.arange(len(anchor)) + length <= ends[of])
                    if not len(at):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (of[at[1:]] != of[at[:-1]])]))
                    m = np.diff(np.append(first, len(at)))
                    at = at[first]
                    g = hashes[anchor[at]].view(np.int64)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(g)], names=["g"])
                        continue
                    with np.errstate(over="ignore"):
                        v = _mixed(prefixes.of(at, m - 1 + length) + m.astype(np.uint64)).view(np.int64)
                    row, offset = np.asarray([p[0] for p in part])[of[at]], np.asarray([p[1] for p in part])[of[at]]
                    place = (offset + at - (ends - sizes)[of[at]]) << 32 | mark[row] << 16 | m << 8 | (anchor[at] - at)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(v), pa.array(h[row]), pa.array(place)], names=["g", "v", "h", "place"])

    return run


def _start(place: Column) -> Column:
    return F.shiftright(place, 32)


def _mark(place: Column) -> Column:
    return F.shiftright(place, 16).bitwiseAND(0xFFFF)


def _windows(place: Column) -> Column:
    return F.shiftright(place, 8).bitwiseAND(0xFF)


def _bodies(length: int):
    """The rows of ``open`` of each text, with their bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                lists = chunk.column("open")
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                rows = lists.flatten()
                place = rows.field("place").to_numpy()
                raw = [t.as_py() for t in chunk.column("text")]
                bodies = [raw[i][a : a + b] for i, a, b in zip(of.tolist(), (place >> 32).tolist(), ((place >> 8 & 0xFF) - 1 + length).tolist(), strict=True)]
                h = pa.array(chunk.column("h").to_numpy()[of])
                yield pa.RecordBatch.from_arrays([rows.field("g"), rows.field("v"), rows.field("n"), h, rows.field("place"), pa.array(bodies, pa.binary())], names=["g", "v", "n", "h", "place", "body"])

    return run


class SuffixSort:
    """Sorted suffixes of some bytes, up to ``length`` bytes of each, within given groups."""

    def __init__(self, data: np.ndarray, length: int, base: int = 0) -> None:
        self.data, self.length, self.prefixes = data, length, Prefixes(data, base)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, by binary search over prefix hashes."""
        shared = np.zeros(len(a), np.int64)
        step = 1 << (self.length.bit_length() - 1)
        while step:
            inside = np.flatnonzero(shared + step <= self.length)
            x, y = a[inside] + shared[inside], b[inside] + shared[inside]
            shared[inside[self.prefixes.of(x, step) == self.prefixes.of(y, step)]] += step
            step >>= 1
        return shared

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether each suffix at ``a`` comes before that at ``b``; equal ones as ``ties`` says."""
        shared = self.extension(a, b)
        equal = shared == self.length
        last = np.minimum(shared, self.length - 1)
        return np.where(equal, ties, self.data[a + last] < self.data[b + last])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The suffixes ``at``, which are given group by group, in order within each group: a mergesort from runs of one."""
        at = at.copy()
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(heads, len(group)))
        width = 1
        while (large := np.flatnonzero(sizes > width)).size:
            place = np.repeat(heads[large], sizes[large])
            local = np.arange(len(place)) - np.repeat(np.cumsum(sizes[large]) - sizes[large], sizes[large])
            end = place + np.repeat(sizes[large], sizes[large])
            own = local // width
            right = own % 2 == 1
            pair = place + (own // 2) * 2 * width
            other = np.where(right, pair, np.minimum(pair + width, end))  # the run to be merged with
            stop = np.where(right, pair + width, np.minimum(pair + 2 * width, end))
            me, low, high = at[place + local], other.copy(), stop.copy()
            while (seek := np.flatnonzero(low < high)).size:  # how many of the other run come before each suffix
                middle = (low[seek] + high[seek]) // 2
                first = self.before(at[middle], me[seek], right[seek])
                low[seek] = np.where(first, middle + 1, low[seek])
                high[seek] = np.where(first, high[seek], middle)
            merged = at.copy()
            merged[np.where(right, pair, place + own * width) + local - own * width + (low - other)] = me
            at, width = merged, 2 * width
        return at

    def verified(self, at: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """For each suffix but the first whether it equals the one before, or None if bytes show that the order is wrong."""
        near = np.flatnonzero(group[1:] == group[:-1])
        equal = np.zeros(len(at), bool)
        for part in np.array_split(near, max(1, len(near) * self.length // (4 << 20))):
            a, b = at[part], at[part + 1]
            shared = self.extension(a, b)
            rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
            differs = rows[a] != rows[b]
            true = np.where(differs.any(axis=1), differs.argmax(axis=1), self.length)
            last = np.minimum(true, self.length - 1)
            if (true != shared).any() or ((true < self.length) & (self.data[a + last] > self.data[b + last])).any():
                return None
            equal[part + 1] = true == self.length
        return equal


def _repeated(bodies: list[bytes], anchors: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """For each body whether each of its windows is a window of another one; anchors are told by number, ``offsets`` are theirs."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.asarray([len(b) for b in bodies])
    m = sizes - length + 1
    of = np.repeat(np.arange(len(bodies)), m)
    j = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    at = (np.cumsum(sizes) - sizes)[of] + j
    group = anchors[of] * (length + 1) + offsets[of] - j  # equal windows have equal anchors at the same offset
    by = np.argsort(group, kind="stable")
    base = 0
    while True:
        suffixes = SuffixSort(data, length, base)
        order = suffixes.sort(at[by], group[by])
        equal = suffixes.verified(order, group[by])
        if equal is not None:
            break
        base += 1
    hit = equal.copy()
    hit[:-1] |= equal[1:]
    back = np.zeros(len(data), bool)
    back[order] = hit
    return np.split(back[at], np.cumsum(m)[:-1])


def _sorted_windows(length: int):
    """(h, mark, start, windows): stretches of repeated windows in bodies that occur once; rows come in order of g and v."""

    def stretches(rows: list[tuple]) -> pa.RecordBatch | None:
        g, n, h, place = (np.asarray([r[i] for r in rows]) for i in (0, 2, 3, 4))
        found = _repeated([r[5] for r in rows], np.unique(g, return_inverse=True)[1].astype(np.int64), place & 0xFF, length)
        out = []
        for i in np.flatnonzero(n == 1).tolist():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], found[i], [False]]).astype(np.int8)))
            start, text, mark = int(place[i] >> 32), int(h[i]), int(place[i] >> 16 & 0xFFFF)
            out += [(text, mark, start + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h", "mark", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:2] == rows[-1][:2]:  # the body of another copy of the text
                    continue
                if size > CHUNK_BYTES and row[0] != rows[-1][0]:
                    if (out := stretches(rows)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows and (out := stretches(rows)) is not None:
            yield out

    return run


def _refined(length: int):
    """Pieces with the anchor grown by half of its room, to the left for windows with more room there, else to the right.

    The size of an anchor follows from its piece: it ends where the first window does, unless windows were split off before, so it
    is carried at the end of the body as two bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, n, h, place, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, d, size = place >> 8 & 0xFF, place & 0xFF, int.from_bytes(body[-2:], "big")
                body, room = body[:-2], length - size
                left = (room + 1) // 2
                right = room - left + 1
                for lo, hi, begin, grown in ((0, min(m, d - left + 1), d - left, size + left), (max(0, d - left + 1), m, d, size + right)):
                    if lo >= hi:
                        continue
                    # windows lo .. hi - 1 of the piece; the grown anchor is at begin
                    part, key = body[lo : hi - 1 + length], body[begin : begin + grown]
                    own = (place >> 32) + lo << 32 | place & 0xFFFF0000 | hi - lo << 8 | begin - lo
                    out.append((key + bytes([begin == d]), part, n, h, own, part + grown.to_bytes(2, "big")))
            if not out:
                continue
            keys, parts, n, h, place, body = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(keys)), pa.array(_hashes(parts)), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(place, pa.int64()), pa.array(body, pa.binary())], names=["g", "v", "n", "h", "place", "body"])

    return run


def _hashes(rows: tuple[bytes, ...]) -> np.ndarray:
    sizes = np.asarray([len(r) for r in rows])
    prefixes = Prefixes(np.frombuffer(b"".join(rows), np.uint8))
    with np.errstate(over="ignore"):
        return _mixed(prefixes.of(np.cumsum(sizes) - sizes, sizes) + sizes.astype(np.uint64)).view(np.int64)


def _stretch(pieces: DataFrame) -> DataFrame:
    return pieces.select("h", _mark(F.col("place")).alias("mark"), _start(F.col("place")).alias("start"), _windows(F.col("place")).alias("windows"))


def _classes(pieces: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal bodies of anchors with several occurrences, and those of anchors with different bodies (with their number)."""
    body = [F.min_by("body", "h").alias("body")] if "body" in pieces.columns else []
    classes = save(pieces.groupBy("g", "v").agg(F.sum("n").alias("n"), F.min_by("place", "h").alias("place"), F.min("h").alias("h"), *body), f"{name}-classes")
    several = save(classes.groupBy("g").agg(F.count("*").alias("bodies")).where("bodies > 1"), f"{name}-several")
    return classes, classes.join(several, "g")


def _with_bodies(docs: DataFrame, still: DataFrame, length: int) -> DataFrame:
    """``still`` with the bodies, from one row of each text."""
    lists = still.withColumn("mark", _mark(F.col("place"))).groupBy("h", "mark").agg(F.collect_list(F.struct("g", "v", "n", "place")).alias("open"))
    firsts = docs.groupBy("h", "mark").agg(F.min("doc_id").alias("doc_id"))
    named = save(lists.join(firsts, ["h", "mark"]), "repeats-lists")
    same = (docs.h == named.h) & (docs.mark == named.mark) & docs.doc_id.eqNullSafe(named.doc_id)
    return docs.join(named, same).select(docs.h, docs.text, "open").mapInArrow(tidy(_bodies(length)), _OPEN)


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int | None = None) -> DataFrame:
    """(h, mark, start, windows): stretches of repeated windows of the texts in ``docs`` (doc_id, text in bytes, h, mark)."""
    group = group or GROUP
    anchors = docs.select("text", "h", "mark").mapInArrow(tidy(_pieces(length, False)), "g long")
    often = save(anchors.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "repeats-anchors")
    pieces = docs.select("text", "h", "mark").mapInArrow(tidy(_pieces(length, True)), _PIECES)
    pieces = save(pieces.join(often, "g"), "repeats-pieces").withColumn("n", F.lit(1).cast("long"))
    found, still, turn = [], None, 0
    while True:
        classes, apart = _classes(pieces, f"repeats-{turn}")
        found.append(_stretch(pieces.where("n = 1").join(classes.where("n > 1").select("g", "v"), ["g", "v"])))
        if still is None:
            few, many = apart.where(F.col("bodies") <= group), save(apart.where(F.col("bodies") > group), "repeats-many")
            still = _with_bodies(docs, few, length)
            anchor = F.lit((length * ANCHOR // 25 or 1).to_bytes(2, "big"))
            hot = _with_bodies(docs, many, length).withColumn("body", F.concat("body", anchor)) if not many.isEmpty() else None
        else:
            few, many = apart.where(F.col("bodies") <= group), save(apart.where(F.col("bodies") > group).select("g", "v", "n", "h", "place", "body"), "repeats-many")
            still = few.select("g", "v", "n", "h", "place", F.expr("substring(body, 1, length(body) - 2)").alias("body"))
            hot = many if not many.isEmpty() else None
        found.append(still.repartition("g").sortWithinPartitions("g", "v").mapInArrow(tidy(_sorted_windows(length)), "h long, mark long, start long, windows long"))
        if hot is None:
            break
        pieces, turn = save(small_batches(hot).dropDuplicates(["g", "v"]).mapInArrow(tidy(_refined(length)), _OPEN), "repeats-refined"), turn + 1
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return save(out.distinct(), "repeats-spans")


def _without(length: int):
    """(doc_id, n_bytes, spans, kept) of each row."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                sizes, spans, kept = [], [], []
                for text, listed in zip(part.column("text"), part.column("listed").to_pylist(), strict=True):
                    raw, merged, at, pieces = text.as_py(), [], 0, []
                    for place in sorted(listed or []):
                        start, stop = place >> 32, (place >> 32) + (place & 0xFFFFFFFF) - 1 + length
                        if merged and start <= merged[-1]["stop"]:
                            merged[-1]["stop"] = max(stop, merged[-1]["stop"])
                        else:
                            merged.append({"start": start, "stop": stop})
                    for s in merged:
                        pieces.append(raw[at : s["start"]])
                        at = s["stop"]
                    pieces.append(raw[at:])
                    sizes.append(len(raw))
                    spans.append(merged)
                    kept.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, group: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop in bytes: removed, not touching each other) and kept (bytes) for every row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in this text or another row's.
    ``group`` bounds the bodies that are sorted together (by default GROUP). See the module for nulls, short and repeated texts.
    """
    if not 4 <= length <= _LONGEST:
        raise ValueError(f"length must be within 4 to {_LONGEST}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    named = small_batches(docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("h"), (F.crc32(text) % 65536).alias("mark")))
    spans = repeated_spans(named, length, group)
    listed = save(spans.groupBy("h", "mark").agg(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("windows"))).alias("listed")), "repeats-listed")
    joined = named.join(listed, ["h", "mark"], "left").select("doc_id", "text", "listed")
    return joined.mapInArrow(tidy(_without(length)), f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def repeat_digest(found: DataFrame) -> DataFrame:
    """Of ``without_repeats``: sizes, number of spans and a digest of what is kept."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
