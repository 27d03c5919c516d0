"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends. For each document an enhanced suffix
array (order, inverse order, common prefixes) is built over its words. The squares of a run of period q that lie furthest to
the right start at a suffix whose common prefix with the one q words on is exactly q, so both are in one interval of depth q
and in different children of it. For each interval the suffixes of all children but the largest are therefore looked at: a
suffix i is a branching square if the inverse order of i + q, or of i - q as its other half, is within the interval and
outside i's own child. Intervals are index ranges from nearest smaller values; no tree node is made. Each square is rotated to
the left as far as its period holds, which gives the run, and squares of one run are merged.

A run of at least ``least`` words and ``exponent`` periods shares least - least // exponent words or more with itself, one period
on; documents in which no stretch of so many words occurs twice have no run and are not sorted.

A task holds the words of a few texts (common.CHUNK_BYTES) or of one longer text at a time, some 100 bytes for each word and
4 for each word and doubling of its longest repeat. No row meets another one: there is no shuffle and no hot key.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has no words and no run; repeated rows and
null doc_ids each come back; of ties nothing depends on the order of rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import let, small_batches, text_chunks, tidy

#: A run has at least so many words and so many periods.
LEAST = 24
EXPONENT = 3
#: Suffixes of children that are looked at together.
_TOGETHER = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _common(least: int, exponent: int) -> int:
    """The least of length - period for length >= least and length >= exponent * period."""
    return max(1, least - least // exponent)


def _repeats_in(ids: np.ndarray, owner: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The owners that hold some ``size`` words twice, and by chance of hashes perhaps others."""
    n = len(ids)
    if n < size:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        value = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        total, base, done, block = np.zeros(n, np.uint64), np.uint64(0xD6E8FEB86659FD93), 0, 1
        power, left = base, size
        ahead = value * _MIX
        while left:  # the words from i + done on, by the binary digits of size
            if left & 1:
                total[: n - done] = total[: n - done] * power + ahead[done:]
                done += block
            left >>= 1
            if left:
                ahead[: n - block] = ahead[: n - block] * power + ahead[block:]
                power, block = power * power, block * 2
        total = (total ^ (total >> np.uint64(31))) * _MIX + owner.astype(np.uint64) * base
    whole = np.flatnonzero(np.arange(n) + size <= ends)
    keys = total[whole]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.unique(owner[whole][np.isin(keys, twice)]) if len(twice) else np.empty(0, np.int64)


class SuffixArray:
    """Suffixes of several texts in order, those of a text together: ``rank`` is the inverse order, ``common[k]`` the words that
    the suffixes at k - 1 and k share. ``levels[k]`` tells suffixes apart by their first 2 ** k words."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.n, self.starts, self.ends = len(ids), starts, ends
        first = np.unique(owner * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
        self.levels = [(np.cumsum(first[2]) - first[2])[first[1]].astype(np.int32)]
        while self._double():
            pass
        self.rank = self.levels[-1]
        self.order = np.empty(self.n, np.int32)
        self.order[self.rank] = np.arange(self.n, dtype=np.int32)
        self.common = np.concatenate([[0], self.forward(self.order[:-1], self.order[1:])]).astype(np.int32)

    def _double(self) -> bool:
        """One more level, by sorting what is not apart yet; False if everything is."""
        rank, size = self.levels[-1], 1 << (len(self.levels) - 1)
        active = np.flatnonzero(np.bincount(rank, minlength=self.n)[rank] > 1)
        if not len(active):
            return False
        ahead = active + size
        second = np.where(ahead < self.ends[active], rank[np.minimum(ahead, self.n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (self.n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        place = np.arange(len(active))
        new_key = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
        new_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        rank = rank.copy()
        rank[active] = old + (new_key - new_old)
        self.levels.append(rank)
        return True

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` share."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        end_a, end_b, shared = self.ends[a], self.ends[b], np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x, y = self.levels[k], a + shared, b + shared
            inside = (x < end_a) & (y < end_b)
            same = inside & (level[np.minimum(x, self.n - 1)] == level[np.minimum(y, self.n - 1)])
            shared += np.where(same, 1 << k, 0)
        return shared

    def backward(self, a: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far a repetition with ``period`` that holds from ``a`` on reaches to the left of it."""
        at, start = a.astype(np.int64), self.starts[a]
        for k in range(len(self.levels) - 1, -1, -1):
            x = at - (1 << k)
            level = self.levels[k]
            same = (x >= start) & (level[np.maximum(x, 0)] == level[np.maximum(x, 0) + period])
            at = np.where(same, x, at)
        return a - at

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, low, high) for each k with common[k] > 0: the interval of that depth around it, by nearest smaller values."""
        mins = [self.common]
        while (2 << (len(mins) - 1)) <= self.n:
            half, low = 1 << (len(mins) - 1), mins[-1].copy()
            np.minimum(low[half:], mins[-1][:-half], out=low[half:])  # the 2 * half values up to each place
            mins.append(low)
        k = np.flatnonzero(self.common > 0)
        depth, before, after = self.common[k], k - 1, k + 1
        for level in range(len(mins) - 1, -1, -1):
            size, low = 1 << level, mins[level]
            before = np.where((before >= size - 1) & (low[np.maximum(before, 0)] >= depth) & (before >= 0), before - size, before)
            last = after + size - 1
            after = np.where((last < self.n) & (low[np.minimum(last, self.n - 1)] >= depth), after + size, after)
        return k, before, after - 1


def _squares(array: SuffixArray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of branching squares whose period fits ``exponent`` times into their text."""
    k, low, high = array.intervals()
    depth = array.common[k].astype(np.int64)
    text = array.order[k]
    fits = depth * exponent <= array.ends[text] - array.starts[text]
    k, low, high, depth = k[fits], low[fits], high[fits], depth[fits]
    by = np.lexsort((k, high, low))
    k, low, high, depth = k[by], low[by], high[by], depth[by]
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    sizes = np.diff(np.append(heads, len(k)))
    of = np.repeat(np.arange(len(heads)), sizes + 1)  # an interval has one child more than places between children
    child = np.insert(k, heads, low[heads])
    last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
    stop = np.append(child[1:], 0)
    stop[last] = high[heads] + 1
    width = stop - child
    first = np.append(0, last[:-1] + 1)
    most = np.maximum.reduceat(width, first)
    largest = np.flatnonzero(width == most[of])
    small = np.ones(len(child), bool)
    small[largest[np.unique(of[largest], return_index=True)[1]]] = False
    child, stop, width, of = child[small], stop[small], width[small], of[small]
    found = []
    cuts = np.searchsorted(np.cumsum(width), np.arange(_TOGETHER, int(width.sum()) + _TOGETHER, _TOGETHER), side="left") + 1
    for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
        w = width[a:b]
        if not len(w):
            continue
        each = np.repeat(np.arange(a, min(b, len(width))), w)
        place = child[each] + np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)
        i, d = array.order[place].astype(np.int64), depth[heads[of[each]]]
        lo, hi, own, end = low[heads[of[each]]], high[heads[of[each]]], child[each], stop[each]
        for at in (i + d, i - d):
            inside = (at >= array.starts[i]) & (at < array.ends[i])
            rank = array.rank[np.clip(at, 0, array.n - 1)]
            hit = inside & (rank >= lo) & (rank <= hi) & ((rank < own) | (rank >= end))
            found.append(np.stack([np.minimum(i, at)[hit], d[hit]]))
    start, period = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return start, period


def runs_of(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each text the runs (start, length, period) by start, then period; ``ids`` are the words of all texts, one after another."""
    none = np.empty((0, 3), np.int64)
    runs = [none] * len(sizes)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(ids):
        return runs
    chosen = _repeats_in(ids, owner, stops[owner], _common(least, exponent))
    if not len(chosen):
        return runs
    kept = np.isin(owner, chosen)
    ids, owner = ids[kept], owner[kept]
    stops = np.cumsum(sizes[chosen])
    place = np.searchsorted(chosen, owner)
    starts, ends = (stops - sizes[chosen])[place], stops[place]
    array = SuffixArray(ids, place, starts, ends)
    start, period = _squares(array, exponent)
    left = array.backward(start, period)
    begin, length = start - left, left + 2 * period
    long = (length >= least) & (length >= exponent * period)
    begin, length, period = begin[long], length[long], period[long]
    by = np.lexsort((period, length, begin))
    begin, length, period = begin[by], length[by], period[by]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])  # a stretch's smallest period is its period
    begin, length, period = begin[fresh], length[fresh], period[fresh]
    text = place[begin]
    by = np.lexsort((period, begin))
    begin, length, period, text = begin[by], length[by], period[by], text[by]
    table = np.stack([begin - starts[begin], length, period], axis=1)
    for t in np.unique(text).tolist():
        runs[chosen[t]] = table[text == t]
    return runs


def _found(least: int, exponent: int):
    """(doc_id, n_words, runs, collapsed) of each row."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                words = [(text or "").encode().split() for text in part.column("text").to_pylist()]
                sizes = np.asarray([len(w) for w in words], np.int64)
                names: dict[bytes, int] = {}
                ids = np.fromiter((names.setdefault(w, len(names)) for text in words for w in text), np.int64, int(sizes.sum()))
                found = runs_of(ids, sizes, least, exponent)
                texts = []
                for text, runs in zip(words, found, strict=True):
                    if len(runs):
                        kept = np.ones(len(text), bool)
                        for start, length, period in runs.tolist():
                            kept[start + period : start + length] = False
                        text = [text[i] for i in np.flatnonzero(kept).tolist()]
                    texts.append(b" ".join(text).decode())
                listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()] for runs in found], run_type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), listed, pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: in words, by start, then period) and collapsed for every row of ``docs``.

    A run has at least ``least`` words and ``exponent`` (two or more) of its smallest periods. ``collapsed`` is the text with one space
    between words, without the words of any run after its first period. See the module for nulls, ties and empty texts.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(_found(least, exponent)), schema)


def run_digest(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: the number of runs, the one with the greatest exponent (ties: smallest start, then period), and digests.

    Without a run start, length, period and exponent_milli are null; digests never are.
    """

    def before(a: Column, b: Column) -> Column:
        order = [b["length"] * a["period"] - a["length"] * b["period"], a["start"] - b["start"], a["period"] - b["period"]]
        return F.coalesce(*[F.when(o != 0, F.signum(o)) for o in order], F.lit(0)).cast("int")

    best = F.try_element_at(F.array_sort("runs", before), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    named = found.withColumn("best", best)
    milli = F.expr("best.length * 1000 div best.period")
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def plant_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the texts turns periodic at some word, decided by the crc32 of doc_id.

    With h that checksum and g = h div 10, texts with h % 10 = 0 and n > 0 words go on from word a = g % n as its p words repeated, p = 1 +
    (n - a) div (3 + g % 8). A null doc_id has no checksum, its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        spans = F.transform(F.array(F.named_struct(F.lit("n"), n, F.lit("a"), (g % n).cast("int"), F.lit("g"), g)), lambda s: F.named_struct(F.lit("a"), s["a"], F.lit("p"), (F.lit(1) + F.floor((s["n"] - s["a"]) / (F.lit(3) + s["g"] % 8))).cast("int")))
        turned = F.transform(spans, lambda s: F.transform(w, lambda x, i: F.when(i < s["a"], x).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"]))))
        return F.array_join(F.element_at(turned, 1), " ")

    planted = let(words, lambda w: F.when(F.size(w) > 0, periodic(w)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(planted, "text")).otherwise(F.col("text")).alias("text"))
