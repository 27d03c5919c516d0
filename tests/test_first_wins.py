"""First wins over several identifiers: chains, groups, and one record after another."""

import random
import time

import pytest

from feedloom.operators import dedup

SCHEMA = "source_idx int, rec_idx long, fields map<string,string>"


def one_by_one(rows):
    taken, kept = set(), []
    for source, record, fields in sorted(rows, key=lambda r: r[:2]):
        own = {(k, v) for k, v in fields.items()}
        if not own & taken:
            taken |= own
            kept.append((source, record))
    return kept


def found(frame):
    return sorted((r["source_idx"], r["rec_idx"]) for r in frame.collect())


def test_a_long_chain_takes_few_rounds(spark):
    """Each record shares an identifier with the next: every second one is kept, which rounds alone decide one step at a time."""
    rows = [(0, i, {"id": f"k{i}", "url": f"k{i + 1}"} if i % 2 else {"url": f"k{i}", "id": f"k{i + 1}"}) for i in range(10_000)]
    began = time.monotonic()
    assert found(dedup.first_wins(spark.createDataFrame(rows, SCHEMA).repartition(4))) == one_by_one(rows)
    assert time.monotonic() - began < 60


@pytest.mark.parametrize(("few", "seed"), [(200_000, 1), (60, 2), (9, 3)])
def test_groups_are_decided_record_by_record(spark, monkeypatch, few, seed):
    """With a small bound links are contracted first, and large groups take rounds."""
    monkeypatch.setattr(dedup, "FEW", few)
    draw = random.Random(seed)
    rows = []
    for g in range(12):
        for i in range(draw.choice([3, 8, 40])):
            rows.append((draw.randrange(2), len(rows), {"id": f"g{g}-{i + draw.randrange(2)}", "url": f"g{g}-{i + 1}", **({"guid": f"g{g}-{draw.randrange(9)}"} if draw.random() < 0.3 else {})}))
    assert found(dedup.first_wins(spark.createDataFrame(rows, SCHEMA))) == one_by_one(rows)
