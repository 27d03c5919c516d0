import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import bpe, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = tokenizers.Tokenizer.from_file(PATH)


def expected(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


def hard_texts():
    rng = random.Random(5)
    letters = ["a", "ab", "é", "ß", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "12", "!", "...", "#", "日本", "😀", "<|endoftext|>", "the", " the", "\r\n"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(120)]
    out += ["a" * 70_000, "=" * 9_001, " " * 9_000 + "x", "\n" * 6_000, "日本語" * 9_000, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "x'" * 5_000, "<|endoftext|>" * 700]
    out += [" ".join(rng.choice(["word", "it's", "naïve", "42", "a" * 5000, "-" * 3000, "don't  stop"]) for _ in range(800)) for _ in range(3)]
    out += ["word " * 9_000, "  " + "ab " * 20_000 + " \n ", ("x" * 2047 + " ") * 20]
    return out


def test_leaves_join_exactly():
    c = bpe.codec(PATH)
    for text in hard_texts():
        cut = bpe.leaves(text, c, leaf=700, unsplit=64)
        assert "".join(p for _, p in cut) == text
        assert bpe.join_tree([(k, bpe.encode_leaf(k, p, c)) for k, p in cut], c) == expected(text)
        if len(text) < 5000:
            assert c.encode(text) == expected(text)


def test_encode_decode_rows(spark):
    texts = [None, "", "a", *hard_texts()]
    texts += texts[-2:]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {(r["doc_id"] or 0): r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i]["ids"], "<u2").tolist() == expected(t)
        assert got[i]["decoded"] == REFERENCE.decode(expected(t), skip_special_tokens=False) == (t or "")
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = bpe.digests(bpe.encode(docs, PATH), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = expected(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_digests_in_one_worker(spark):
    """Long, empty, null and repeated texts: the same rows as digests of the encoded texts."""
    texts = [None, "", *hard_texts(), "long text " * 9000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[-2:])], "doc_id long, text string")
    assert sorted(bpe.encoded_digests(docs, PATH).collect()) == sorted(bpe.digests(bpe.encode(docs, PATH), PATH).collect())
    assert bpe.encoded_digests(docs.limit(0), PATH).count() == 0


def slow_best_fit(sizes, length):
    rooms, out = [], []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [r for r in rooms if r >= sizes[i]]
        if not fits:
            rooms.append(length - sizes[i])
        else:
            rooms[rooms.index(min(fits))] -= sizes[i]
    return sorted(length - r for r in rooms)


def test_best_fit_matches_a_linear_search():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(0, 90))]
        packed = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for s in packed for i in s) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in s) for s in packed) == slow_best_fit(sizes, 64)


def test_pack_is_lossless(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    texts = [None, "", *[t for t in hard_texts() if len(t) < 9_000], "same text here", "same text here"]
    docs = spark.createDataFrame([(7 if t == "same text here" else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack(docs, PATH, length=256).collect()
    pieces = {}
    for r in rows:
        ids, at = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        assert len(ids) == len(at) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256
        assert (ids[r["n_tokens"] :] == 50256).all()
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert at[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((p, ids[a:b].tolist()))
    for i, t in enumerate(texts):
        if t != "same text here" and i != 7:
            assert [x for _, p in sorted(pieces.get(i, [])) for x in p] == expected(t)
    assert sum(len(p) for _, p in pieces[7]) == sum(len(expected(t)) for i, t in enumerate(texts) if i == 7 or t == "same text here")
    assert packing.pack(docs.limit(0), PATH).count() == 0
