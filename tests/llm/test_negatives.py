import math
import random

import duckdb
import numpy as np
import pytest

from feedloom.llm import negatives
from feedloom.llm.oracles import ORACLES
from feedloom.llm.queries import QUERIES

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """All pairs, in whole numbers."""
    kept = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, (a, kind, x) in enumerate(kept):
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for j, (b, other, y) in enumerate(kept) if j != i and len(x) == len(y)]
        for score, b, _ in sorted(s for s in scored if s[2] == kind)[:5]:
            near = sorted((s, c) for s, c, other in scored if other != kind and 80 * -score <= 100 * -s <= 100 * -score)[:5]
            out += [(a, b, k, c, -score, -s) for k, (s, c) in enumerate(near, 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    expected = duckdb.sql(ORACLES["op12_hard_negatives"]).project(", ".join(COLUMNS)).fetchall()
    assert found(QUERIES["op12_hard_negatives"](spark, path)) == sorted(expected) != []


def test_ties_repeats_and_rows_without_part(spark):
    draw = random.Random(3)
    rows = [(i, i % 3, [draw.choice([-0.5, 0.25, 0.5]) for _ in range(4)]) for i in range(600)]
    rows += [(7, 1, [0.5, 0.5, 0.5, 0.5])] * 3 + [(100, 1, [0.25, 0.5, 0.5, 0.5])]
    rows += [(None, 1, [0.5] * 4), (200, None, [0.5] * 4), (300, 1, None), (400, 1, []), (500, 1, [0.5, None, 0.5, 0.5]), (601, 1, [math.nan] * 4), (602, 1, [math.inf] * 4)]
    rows += [(700, 1, [0.5]), (701, 1, [0.25]), (702, 2, [0.25]), (703, 1, [1e30] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(negatives.hard_negatives(frame.repartition(5))) == brute([r for r in rows if r[0] != 703])
    assert found(negatives.hard_negatives(frame.limit(0))) == []
    extra = frame.selectExpr("*", "1 AS row", "'x' AS vector", "2 AS is_anchor", "3 AS width")
    assert found(negatives.hard_negatives(extra)) == found(negatives.hard_negatives(frame))


def test_many_shards_and_blocks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    rows = [(i, int(draw.integers(0, 4)), [float(v) for v in centres[i % 6] + 0.2 * draw.normal(size=8)]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    monkeypatch.setattr(negatives, "SHARD_BYTES", 8 * 8 * 200)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 8 * 8 * 6)
    exact = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    assert found(negatives.hard_negatives(frame)) == brute(exact)


def test_bounds_hold_and_visits_stop():
    """No row scores above the bound of its cell, bounds only fall, and on clustered vectors most rows are never scored."""
    draw = np.random.default_rng(1)
    x = np.floor(256 * (4 * draw.normal(size=(40, 16))[draw.integers(0, 40, 6000)] + 0.05 * draw.normal(size=(6000, 16))))
    books = tuple(negatives._codebook(h, 64) for h in (x[:2000, :8], x[:2000, 8:]))
    index = negatives.MultiIndex(x, books)
    for anchor in x[:20]:
        last, rows = math.inf, 0
        for bound, start, stop in index.cells(anchor):
            assert (index.x[start:stop] @ anchor).max() <= bound <= last + 1
            last, rows = bound, rows + stop - start
        assert rows == len(x)
        lists, scored = index.best(anchor, np.ones(len(x), bool), [(None, None)], np.arange(len(x)), 5)
        assert [s for s, _ in lists[0]] == sorted((x @ anchor).tolist(), reverse=True)[:5]
        assert scored < len(x) / 2
