"""The pipeline against a brute-force version, and embedding links against all pairs."""

import importlib.util
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from feedloom.llm import embedding
from feedloom.llm.common import connected_components
from tests.llm.test_minhash import brute


def test_stages_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src1", 0), (900_002, "12 34", "en", None, 5), (900_003, "short text", None, "src2", 10)], source.schema)
    docs = source.union(odd)
    stages = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "source_mixing", "bpe_encoding"]

    named = stages["language_id"](spark, docs, "")
    assert named.columns == docs.columns and {r["doc_id"] for r in named.collect()} == {r["doc_id"] for r in docs.collect()} - {900_001, 900_002}

    good = stages["quality_rules"](spark, named, "")
    want = set()
    for r in named.collect():  # hosts here are too small for frequent lines
        words = [w for w in re.split(r"[ \t-\r]+", r["text"]) if w]
        n = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = len({i + k for i in range(len(words) - 2) for k in range(3) if n[tuple(words[i : i + 3])] > 1})
        if len(words) >= 50 and 2 * repeated <= len(words):
            want.add(r["doc_id"])
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want

    alone = stages["near_dedup"](spark, good, "")
    least = brute([(r["doc_id"], r["text"]) for r in good.collect()])
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(i for i, _, c in least if i == c)

    mixed = stages["source_mixing"](spark, alone, "")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    out = stages["bpe_encoding"](spark, mixed, "")
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in mixed.collect())

    blank = spark.createDataFrame([(900_001, None, "en", "src1", 0), (None, "", None, None, None), (900_001, None, "en", "src1", 0)], source.schema)
    empty = Counter({(900_001, 0): 2, (None, 0): 1})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in stages["bpe_encoding"](spark, blank, "").collect()) == empty
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        assert name == "bpe_encoding" or stage(spark, blank, "").columns == docs.columns


@pytest.mark.parametrize("size,dense", [(40, 1 / 16), (7, 2), (9, -1)])
def test_embedding_links_equal_all_pairs(spark, monkeypatch, size, dense):
    monkeypatch.setattr(embedding, "TILE_BYTES", size * 8 * 24)
    monkeypatch.setattr(embedding, "_DENSE", dense)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 24))
    rows = [(i, (base[i % 30] + rng.standard_normal(24) * (0.05 if i % 7 else 0.35)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] * 24), (304, [None] + [1.0] * 23), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (5, rows[5][1]), (None, [3.0, 6.1]), (307, [7.0]), (308, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash")).repartition(3)
    valid = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if valid[i] and valid[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    want = sorted(((v, links[i], least.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.near_vectors(df).collect()), key=repr) == want
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)] + [(500, 501), (501, 500)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert {i for i in roots if i < 500} == set(range(1, 101)) and {roots[i] for i in range(1, 101)} == {0} and roots[501] == 500 and 500 not in roots


def test_registered_queries():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert ("pipeline" in names) == (importlib.util.find_spec("corpus_pipeline") is not None)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
