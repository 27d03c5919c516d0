import random
from itertools import combinations

import pyarrow as pa
import pytest

from feedloom.llm import minhash


def brute(docs):
    """doc_id to (set size, smallest reachable doc_id), comparing every pair of texts."""
    sets = {}
    for row, (_, text) in enumerate(docs):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[row] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    up = {r: r for r in sets}

    def find(r):
        while up[r] != r:
            r = up[r]
        return r

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for r, (i, _) in enumerate(docs):
        least[find(r)] = min(least.get(find(r), i), i)
    return sorted((i, len(sets[r]), least[find(r)]) for r, (i, _) in enumerate(docs))


def near_texts(seed, n_groups=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.randrange(30, 160))] + (passage if g % 2 else [])
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if c == 1 else "\n ".join(own))
    texts += [" ".join([word() for _ in range(4)] + passage) for _ in range(30)]
    return texts + ["", " \t", "one", "one", "One two", "one two three four", "a b c d e", "A B C D E", "x" * 300, "é è ü " * 9]


@pytest.mark.parametrize("tile", [512, 5])
def test_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    docs = list(enumerate(near_texts(tile)))
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in docs], "doc_id long, text string, node string, `key` string")
    rows = minhash.near_duplicates(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])


def test_nulls_repeats_and_nothing(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (5, None), (None, None), (2, "a b")], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert rows == sorted([(3, 36, 3, True), (3, 36, 3, True), (-1, 36, 3, False), (5, 0, 5, True), (-1, 0, None, False), (2, 1, 2, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    text, near = " ".join(map(str, range(40))), " ".join(map(str, range(41)))
    rows = [(1, text), (None, near), (None, text), (1, near), (1, text), (7, None), (7, None), (8, "..."), (None, "a b c"), (None, "a b c")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, h string, root string")
    kept = minhash.drop_near_duplicates(df)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == df.columns and len(got) == 5
    assert sum(t in (text, near) for _, t in got) == 1 and got.count((7, None)) == 2 and got.count((None, "a b c")) == 1
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_letters_do_not_cancel():
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[x ^ flip] for x in thue) for flip in (0, 1)]
    a, b = minhash.shingle_sets(pa.array(words))
    assert a.tolist() != b.tolist()
    assert minhash.shingle_sets(pa.array(["A" * 300]))[0].tolist() == minhash.shingle_sets(pa.array(["a" * 300]))[0].tolist()
