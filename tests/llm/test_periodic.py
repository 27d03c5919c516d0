import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from feedloom.llm import periodic
from feedloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(words, least, exponent):
    """Every maximal stretch of each period, the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed)))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(200):
        texts = []
        for _ in range(draw.randint(1, 5)):
            n, kinds = draw.randint(0, 70), draw.choice([1, 2, 3, 6])
            words = [draw.randrange(kinds) for _ in range(n)]
            if n and draw.random() < 0.5:
                a = draw.randrange(n)
                p = 1 + (n - a) // (3 + draw.randrange(8))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least, exponent = draw.choice([(24, 3), (6, 3), (4, 2), (2, 2), (9, 4)])
        found = periodic.runs_of(np.asarray(sum(texts, []), np.int64), np.asarray([len(t) for t in texts]), least, exponent)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t, least, exponent) for t in texts]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()]
    assert sorted(found) == sorted(brute_row(d.doc_id, d.text) for d in docs)
    assert sum(r[1] > 0 for r in found) > 10


def test_odd_rows(spark):
    run = "a b c " * 9
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, run, None), (None, run, None), (5, run + "d", "x"), (5, "w\x00 é é " * 12, "x"), (6, "z " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    found = [tuple(r) for r in periodic.run_digest(periodic.periodic_runs(docs)).collect()]
    expected = []
    for doc_id, text, _ in rows[:-1]:
        words = (text or "").encode().split()
        runs = brute_runs(words, 24, 3)
        expected.append((doc_id, len(runs)))
    assert sorted((r[:2] for r in found if r[0] != 6), key=str) == sorted(expected, key=str)
    assert [r for r in found if r[0] == 6][0][:6] == (6, 1, 0, 30_000, 1, 30_000_000)
    assert periodic.run_digest(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_planted_periods(spark):
    docs = spark.createDataFrame([(i, " ".join(str(j % 41) for j in range(i))) for i in range(120)] + [(None, "a b")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in periodic.plant_periods(docs).collect()}
    for i in range(120):
        h, words = zlib.crc32(str(i).encode()), [str(j % 41) for j in range(i)]
        if h % 10 == 0 and i:
            a = h // 10 % i
            p = 1 + (i - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(i)]
        assert found[i] == " ".join(words)
    assert found[None] == "a b"
