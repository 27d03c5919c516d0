import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import repeats
from feedloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(n_bytes, spans, kept) of each text, from a count of all strings of that length."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(r), spans, bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])))
    return out


def rows_of(found):
    return [(r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in found.collect()]


def passages(seed, texts=60):
    """Texts that share stretches of others, at any place, with single letters changed; copies, and repeats of short strings."""
    draw = random.Random(seed)
    out = []
    for _ in range(texts):
        parts = []
        for _ in range(draw.randint(0, 4)):
            kind = draw.random()
            if kind < 0.4 and out:
                other = draw.choice(out)
                a = draw.randrange(len(other) + 1)
                parts.append(other[a : a + draw.randint(1, 120)])
            elif kind < 0.55:
                parts.append(draw.choice("aé") * draw.randint(1, 90))
            elif kind < 0.65:
                parts.append("".join(draw.choice("ab") for _ in range(draw.randint(1, 3))) * draw.randint(1, 30))
            else:
                parts.append("".join(draw.choice("abcdefgh é\n") for _ in range(draw.randint(1, 150))))
        text = "".join(parts)
        if text and draw.random() < 0.3:
            i = draw.randrange(len(text))
            text = text[:i] + "#" + text[i + 1 :]
        out.append(draw.choice(out) if out and draw.random() < 0.1 else text)
    return out


@pytest.mark.parametrize(("seed", "length", "group"), [(1, 40, None), (2, 25, 1), (3, 60, 2), (4, 12, 3), (5, 50, 1)])
def test_equals_count_of_all_strings(spark, seed, length, group):
    """With a bound of one to three bodies an anchor nearly every anchor is refined."""
    texts = passages(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sorted(rows_of(repeats.without_repeats(docs, length, group)))
    assert found == [(i, *r) for i, r in enumerate(brute(texts, length))]
    assert sum(len(r[2]) for r in found) > 10


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {d.doc_id: b for d, b in zip(docs, brute([d.text for d in docs], 200), strict=True)}
    for r in QUERIES["op13_suffix_dedup"](spark, SF).collect():
        n, spans, kept = expected.pop(r.doc_id)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
    assert not expected


def test_odd_rows(spark):
    draw = random.Random(9)
    own = ["".join(draw.choice("abcdefghij") for _ in range(300)) for _ in range(4)]
    rows = [(1, None), (2, ""), (None, own[0]), (None, own[0]), (None, own[1]), (5, own[2]), (5, own[2]), (5, own[3] + own[1][:100]), (7, own[3][:199]), (8, "x" * 201), (9, "y" * 200)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, h int, place int")
    expected = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 200), strict=True)]
    assert sorted(rows_of(repeats.without_repeats(docs)), key=str) == sorted(expected, key=str)
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="length"):
        repeats.without_repeats(docs, 1000)


def test_long_text_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 700)
    texts = passages(11, 40)
    texts += ["".join(texts[:20]), "".join(texts[5:25])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = docs.selectExpr("cast(text as binary) text", "xxhash64(text) h", "crc32(text) % 65536 mark").toArrow().to_batches()
    made = [b for b in repeats._pieces(40, True)(iter(pieces))]
    place = np.concatenate([b.column("place").to_numpy() for b in made])
    assert (place >> 8 & 0xFF).sum() == sum(max(0, len(t.encode()) - 39) for t in texts)  # every window is in one piece


@pytest.mark.parametrize("seed", range(3))
def test_suffix_sort(seed):
    draw = np.random.default_rng(seed)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    at = draw.permutation(2900)
    group = np.sort(draw.integers(0, 7, 2900))
    suffixes = repeats.SuffixSort(data, 100)
    order = suffixes.sort(at, group)
    raw = bytes(data)
    for g in range(7):
        assert [raw[i : i + 100] for i in order[group == g]] == sorted(raw[i : i + 100] for i in at[group == g])
    equal = suffixes.verified(order, group)
    same = [k > 0 and group[k] == group[k - 1] and raw[order[k] :][:100] == raw[order[k - 1] :][:100] for k in range(2900)]
    assert equal.tolist() == same


def test_collisions_are_seen(monkeypatch):
    """Where hashes lie, the block is sorted again with another base."""
    draw = random.Random(2)
    bodies = [bytes(draw.choice(b"ab") for _ in range(60)) for _ in range(30)]
    bodies += bodies[:5]
    tried, real = [], repeats.Prefixes.of

    def lies(self, at, size):
        return np.zeros(len(at), np.uint64) if self.base == 0 else real(self, at, size)

    def made(self, data, base=0):
        tried.append(base)
        self.base = base
        init(self, data, base)

    init = repeats.Prefixes.__init__
    monkeypatch.setattr(repeats.Prefixes, "__init__", made)
    monkeypatch.setattr(repeats.Prefixes, "of", lies)
    found = repeats._repeated(bodies, np.zeros(35, np.int64), np.full(35, 20), 40)
    assert tried == [0, 1]
    assert [f.all() for f in found[:5] + found[30:]] == [True] * 10


def test_collisions_of_equal_hash_never_pass():
    """Thue-Morse strings collide for bases modulo 2 ** 64 when their bytes have fixed values; the order is right all the same."""
    word = [0]
    for _ in range(9):
        word += [1 - x for x in word]
    a = bytes(97 + x for x in word)
    b = bytes(98 - x for x in word)
    found = repeats._repeated([a, b], np.zeros(2, np.int64), np.full(2, 300), 350)
    windows = [x[i : i + 350] for x in (a, b) for i in range(len(x) - 349)]
    group = [300 - i for x in (a, b) for i in range(len(x) - 349)]
    seen = Counter(zip(windows, group, strict=True))
    assert np.concatenate(found).tolist() == [seen[w, g] > 1 for w, g in zip(windows, group, strict=True)]
