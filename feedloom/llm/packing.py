"""Packed training sequences: best-fit-decreasing with segment-tree capacity search.

Texts are encoded, texts longer than a sequence are split losslessly into pieces, which are written and numbered row by row;
their numbers deal them into shards of about ``SHARD_TOKENS`` tokens (as many as the tokens ask for), repeated rows too. Each shard is packed alone: pieces from long
to short, each into the open sequence with the least room that still fits, which a segment tree over the room left finds in
a logarithm of the sequence length. Only the last sequences of a shard stay partly empty.

Each result row is a row of the id matrix with its cumulative segment lengths and its positions, which restart at 0 with
each segment. Defined results: texts without tokens and null texts take no room and appear in no sequence; ties are
ordered by doc_id, piece and ids; repeated rows are packed each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import bpe
from feedloom.llm.common import save, text_chunks, tidy

LENGTH = 2048
SHARD_TOKENS = 4_000_000


class Rooms:
    """Open sequences by the room they have left; ``least(n)`` is the smallest room of at least ``n`` that some has."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def least(self, n: int) -> int | None:
        node = self.leaves + n
        if self.count[node]:
            return n
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of places in ``sizes`` (each 1 to ``length``); equal sizes are taken in the order given."""
    rooms, out = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        room = rooms.least(sizes[i])
        if room is None:
            sequence, room = len(out), length
            out.append([])
        else:
            sequence = rooms.take(room)
        out[sequence].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], sequence)
    return out


def _pieces(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = length * width
        for batch in batches:
            for part in text_chunks(batch, "ids"):
                rows, numbers, sizes, pieces = [], [], [], []
                for row, ids in enumerate(part.column("ids").to_pylist()):
                    for at in range(0, len(ids or b""), step):
                        rows.append(row)
                        numbers.append(at // step)
                        pieces.append(ids[at : at + step])
                        sizes.append(len(pieces[-1]) // width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(pieces, pa.binary())], names=["doc_id", "piece", "n", "ids"])

    return run


def _packed(length: int, pad: int, dtype: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        shard = table.column("shard")[0].as_py()
        docs, numbers, data = (table.column(c).to_pylist() for c in ("doc_id", "piece", "ids"))
        width = np.dtype(dtype).itemsize
        order = sorted(range(len(data)), key=lambda i: (docs[i] is None, docs[i] or 0, numbers[i], data[i]))
        sizes = [len(data[i]) // width for i in order]
        out = {k: [] for k in ("n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions")}
        blank = np.full(length, pad, dtype)
        steps = np.arange(length, dtype=dtype)
        for sequence in best_fit_decreasing(sizes, length):
            own = [order[k] for k in sequence]
            lengths = [sizes[k] for k in sequence]
            used = sum(lengths)
            out["n_tokens"].append(used)
            out["doc_ids"].append([docs[i] for i in own])
            out["pieces"].append([numbers[i] for i in own])
            out["cu_seqlens"].append(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            out["ids"].append(b"".join(data[i] for i in own) + blank[used:].tobytes())
            out["positions"].append(b"".join(steps[:n].tobytes() for n in lengths) + bytes((length - used) * width))
        n = len(out["ids"])
        kind = table.schema.field("doc_id").type
        return pa.table({
            "shard": pa.array([shard] * n, pa.int32()), "sequence": pa.array(range(n), pa.int32()), "n_tokens": pa.array(out["n_tokens"], pa.int32()),
            "doc_ids": pa.array(out["doc_ids"], pa.list_(kind)), "pieces": pa.array(out["pieces"], pa.list_(pa.int32())), "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
            "ids": pa.array(out["ids"], pa.binary()), "positions": pa.array(out["positions"], pa.binary()),
        })

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, pad: int | None = None) -> DataFrame:
    """Packed sequences of ``docs`` (doc_id, text): shard, sequence, n_tokens, doc_ids, pieces, cu_seqlens, ids, positions.

    ids and positions are ``length`` little-endian numbers as wide as the tokenizer's ids need; after n_tokens ids are
    ``pad`` (the file's first added token unless given) and positions 0.
    """
    c = bpe.codec(path)
    pad = min(c.special.values(), default=0) if pad is None else pad
    if length > 1 << (8 * c.kind.itemsize):
        raise ValueError("positions of this length do not fit the width of the ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = bpe.encode(docs, path).mapInArrow(tidy(_pieces(length, c.kind.itemsize)), f"doc_id {kind}, piece int, n int, ids binary")
    pieces = save(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces", "snappy")
    tokens = pieces.agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-tokens // SHARD_TOKENS)))).cast("int").alias("shard")
    dealt = pieces.select("doc_id", "piece", "ids", shard)
    fields = f"shard int, sequence int, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"
    return dealt.groupBy("shard").applyInArrow(_packed(length, pad, c.kind.str), fields)


def write(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, one row a sequence, in the order of shard and sequence within files."""
    packed.sortWithinPartitions("shard", "sequence").write.option("compression", "zstd").parquet(path)
