"""Language identification by error-correcting output codes.

Each learned language has a codeword; for each bit a binary classifier over hashed letter n-grams (smoothed log-odds of
the languages whose bit is one against the others) gives a margin, and loss-weighted decoding picks the codeword with the
smallest sum of weighted exponential losses. Up to seven languages get the exhaustive code (2 ** (n - 1) - 1 bits), more
get the seeded random code with the largest distance between codewords.

Fit: counts of n-grams for each language, summed by Spark over a bounded sample of labelled rows (``SAMPLE`` rows of each
label in expectation, chosen by a hash of the doc_id; every label is learned), and then, for each n-gram bucket, the share of
the languages whose bit is one. The driver holds the labels, their codewords and that table of buckets by bits.
Beyond ``COMPARED`` languages one seeded random code is taken, without a search for the largest distance.
Prediction: map-only, over whole texts.

Ambiguity: the bits in which the nearest two codewords differ have a lead, their weighted mean log-odds a letter towards the
nearest. A text is ambiguous if its lead is under the share ``SURE`` of the median lead of the sample rows of its language
(texts of two languages, whose bits cancel, are), or if its letters times its lead make less than ``EVIDENCE``.

Defined results: a null text, or one without any letter, is ``und`` with score 0; without labelled rows every text is
``und``; with one language every text with a letter is that language with score 1. Ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import counted_broadcast, free_name, save, small_batches, text_chunks, tidy

#: Bound of the fit: rows for each language in expectation.
SAMPLE = 4000
#: Languages whose counts a task holds before it hands them on.
HELD = 64
#: Languages up to which the most distant of several random codes is taken.
COMPARED = 2000
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Characters that are turned into n-grams at a time.
RUN = 1 << 18
#: A text is ambiguous below this share of the median lead of its language,
SURE = 0.6
#: or with less log-odds in all: odds of a thousand to one, where each letter counts in three n-grams.
EVIDENCE = 3 * float(np.log(1000))
#: Letters without evidence that every text is taken to have, so that a few letters give no certain score.
BLANK = 8
UNDETERMINED = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to its lower-case letter, or to 0 for what is no letter."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def _grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the buckets of all n-grams, with the text each position belongs to, and letters by text."""
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letters = _fold()[points]
    counts = np.bincount(owner[letters > 0], minlength=len(texts))
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # one separator after each word
    letters, owner = letters[keep].astype(np.uint64) + np.uint64(1), owner[keep]
    out, rolled = [], np.zeros(len(letters), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        shifted = np.ones(len(letters), np.uint64)
        inside = owner[order - 1 :] == owner[: len(owner) - order + 1]  # before a text there are separators, not its neighbour
        shifted[order - 1 :][inside] = letters[: len(letters) - order + 1][inside]
        rolled = (rolled + shifted) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        if order in ORDERS:
            out.append(((rolled * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return out, owner, counts


def _runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows, n-grams, owners (places in rows) and letters of runs of texts; a long text comes in several parts."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = min(len(text), at + RUN)
            while end < len(text) and not text[end].isspace() and end - at < 2 * RUN:
                end += 1
            rows.append(row)
            held.append(text[at:end])
            size += end - at
            if size > RUN:
                yield np.asarray(rows), *_grams(held)
                rows, held, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if rows:
        yield np.asarray(rows), *_grams(held)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): the n-grams of a task's rows."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in text_chunks(batch):
            langs = np.asarray(part.column("lang").to_pylist(), dtype=object)
            for rows, grams, owner, _ in _runs(part.column("text").to_pylist()):
                own = langs[rows]
                for lang in set(own.tolist()):
                    mine = (own == lang)[owner]
                    held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for g in grams:
                        held += np.bincount(g[mine], minlength=BUCKETS)
                if len(sums) > HELD:
                    yield from _summed(sums)
    yield from _summed(sums)


def _summed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, held in sums.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bucket", "n"])
    sums.clear()


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages; any two rows differ in many columns."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1 if (c + (1 << (n - 1))) >> (n - 1 - i) & 1 else -1 for c in range((1 << (n - 1)) - 1)] for i in range(n)], float)
    rng, best, far = np.random.default_rng(n), None, -1
    width = int(np.ceil(12 * np.log2(n)))
    for _ in range(50 if n <= COMPARED else 1):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if n > COMPARED:
            return code
        apart = (code.shape[1] - code @ code.T) / 2
        near = int((apart + np.eye(n) * width).min())
        if near > far:
            best, far = code, near
    return best


def _bits(code: dict[str, np.ndarray], bits: int):
    """(bucket, ones): for each bucket of a task, the sum of shares by bit of the languages whose bit is one, and of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, bits + 1))
        for batch in batches:
            ones = np.array([code[k] for k in batch.column("lang").to_pylist()], bool).reshape(batch.num_rows, bits + 1)
            np.add.at(sums, batch.column("bucket").to_numpy(), ones * batch.column("share").to_numpy()[:, None])
        at = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["bucket", "ones"])

    return run


class Model:
    """Languages in order, their codewords, and for each bucket the log-odds of each bit."""

    def __init__(self, langs: list[str], totals: np.ndarray | None = None, ones: np.ndarray | None = None) -> None:
        """``totals``: n-grams of each language; ``ones``: what ``_bits`` sums, for all buckets. Counts are smoothed by a half."""
        self.langs, self.code, self.floors = langs, codewords(len(langs)), np.zeros(len(langs))
        bits, n = self.code.shape[1], len(langs)
        self.odds, self.weights = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits)
        if bits:
            rest, high = 0.5 / (totals + 0.5 * BUCKETS), self.code > 0
            one = (ones[:, :-1] + rest @ high) / high.sum(axis=0)
            zero = (np.maximum(ones[:, -1:] - ones[:, :-1], 0) + rest @ ~high) / (~high).sum(axis=0)
            self.odds = (np.log(one) - np.log(zero)).astype(np.float32)
            # A bit weighs by how far apart its two sides are: the mean absolute log-odds over the languages' n-grams.
            mean = (ones[:, -1] + rest.sum()) / n
            weigh = (np.abs(self.odds) * mean[:, None]).sum(axis=0)
            self.weights = weigh / weigh.sum() if weigh.sum() else np.full(bits, 1 / bits)

    def decode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the nearest codeword, score, lead and letters of each text; of two languages at least."""
        n = len(texts)
        sums, letters = np.zeros((n, self.odds.shape[1])), np.zeros(n, np.int64)
        for rows, grams, owner, count in _runs(texts):
            np.add.at(letters, rows, count)
            filled = np.flatnonzero(count)
            if len(filled):
                starts = np.searchsorted(owner, filled)
                for g in grams:
                    np.add.at(sums, rows[filled], np.add.reduceat(self.odds[g], starts, axis=0))
        margin = np.clip(2 * sums / (letters + BLANK)[:, None], -30, 30)
        loss = (self.weights * np.exp(-margin)) @ (self.code > 0).T + (self.weights * np.exp(margin)) @ (self.code < 0).T
        order = np.argsort(loss, axis=1, kind="stable")
        first, second = np.take_along_axis(loss, order[:, :1], 1)[:, 0], np.take_along_axis(loss, order[:, 1:2], 1)[:, 0]
        near = self.code[order[:, 0]]
        apart = self.weights * (near != self.code[order[:, 1]])
        lead = (apart * near * sums).sum(axis=1) / np.maximum(apart.sum(axis=1), 1e-12) / np.maximum(letters, 1)
        return order[:, 0], np.where(letters > 0, second / (first + second), 0.0), lead, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        n = len(texts)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        if len(self.langs) == 1:
            letters = np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
            return [self.langs[0] if k else UNDETERMINED for k in letters], letters.astype(float), np.zeros(n, bool)
        near, score, lead, letters = self.decode(texts)
        unsure = (letters > 0) & ((lead < self.floors[near]) | (lead * letters < EVIDENCE))
        return [self.langs[k] if c else UNDETERMINED for k, c in zip(near, letters, strict=True)], score, unsure


def _leads(held):
    """(lang, lead) of labelled rows whose text has a letter, by the model that ``held`` broadcasts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                _, _, lead, letters = held.value.decode(part.column("text").to_pylist())
                found = pa.RecordBatch.from_arrays([part.column("lang"), pa.array(lead)], names=["lang", "lead"])
                yield found.filter(pa.array(letters > 0))

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows of ``labelled`` (doc_id, text, lang) with a text and a label; without any, one of no language."""
    rows = small_batches(labelled).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = save(rows.groupBy("lang").agg(F.count("*").alias("rows")), "lang-sizes")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    chosen = save(rows.join(counted_broadcast(sizes), "lang").where(drawn * F.col("rows") < sample).select("text", "lang"), "lang-sample")
    counted = save(chosen.mapInArrow(tidy(_counts), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "lang-counts")
    totals = save(counted.groupBy("lang").agg(F.sum("n").alias("total")), "lang-totals")
    found = dict(sorted((r["lang"], r["total"]) for r in totals.collect()))
    if len(found) < 2:
        return Model(list(found))
    code = np.concatenate([codewords(len(found)) > 0, np.ones((len(found), 1), bool)], axis=1)
    shares = counted.join(counted_broadcast(totals), "lang").select("lang", "bucket", (F.col("n") / (F.col("total") + 0.5 * BUCKETS)).alias("share"))
    bits = code.shape[1] - 1
    summed = shares.repartition("bucket").mapInArrow(tidy(_bits(dict(zip(found, code, strict=True)), bits)), "bucket int, ones array<double>").toArrow()
    ones = np.zeros((BUCKETS, bits + 1))
    ones[summed["bucket"].to_numpy()] = summed["ones"].combine_chunks().flatten().to_numpy().reshape(-1, bits + 1)
    model = Model(list(found), np.array(list(found.values()), float), ones)
    leads = chosen.mapInArrow(tidy(_leads(chosen.sparkSession.sparkContext.broadcast(model))), "lang string, lead double")
    medians = dict(leads.groupBy("lang").agg(F.median("lead")).collect())
    model.floors = np.array([SURE * medians.get(lang, 0.0) for lang in model.langs])
    return model


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the language, score (0 to 1) and ambiguity of ``text``, which alone decides, as columns ``names``.

    Columns of these names are replaced, all others come back; repeated rows each do.
    """
    docs = small_batches(docs.drop(*names))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                langs, score, unsure = held.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(unsure)], names=[*part.schema.names, "language of", "score of", "ambiguity of"])

    # Arrow functions do not take names with dots, so columns go by number.
    names_in = [c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)]
    fields = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names_in, docs.schema, strict=True))
    found = docs.toDF(*names_in).mapInArrow(tidy(run), f"{fields}, `language of` string, `score of` double, `ambiguity of` boolean")
    return found.toDF(*docs.columns, *names)


def held_out() -> Column:
    """Rows that the model never learns from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, and so a language; null, empty and letterless texts are rejected.

    Ambiguous texts stay, repeated rows each do, and every column comes back as it was, whatever its name. Without labels a
    text with a letter has a language, but no name for it. An empty table stays empty.
    """
    model = fit(docs.where(~held_out()))
    names = tuple(free_name(n, docs.columns) for n in ("lang_pred", "score", "ambiguous"))
    return identify(docs, model if model.langs else Model(["unnamed"]), names).where(F.col(names[0]) != UNDETERMINED).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
