"""Helpers that the training-data operators share: written tables, text batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.tables import counted_broadcast, shared_dir
from feedloom.plans.tables import written as save

#: Bytes of text that a task turns into arrays at a time; a single longer text is taken alone.
CHUNK_BYTES = 1 << 19


def small_batches(df: DataFrame, size: int = 2 << 20) -> DataFrame:
    """``df``, after the session's Arrow batches are bounded in bytes: rows of whole texts are far wider than usual ones."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if not now or not now.isdigit() or int(now) > size:
        conf.set(key, str(size))
    return df


def free_name(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts, or sizes, sum to about ``limit`` bytes; a longer text comes alone."""
    values = batch.column(column)
    if not len(values):
        return
    sizes = np.asarray((values if pa.types.is_integer(values.type) else pc.binary_length(values)).fill_null(0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which freed memory goes back: Python workers stay between stages, beside what the next one needs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return whole


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Forest:
    """Joins of the places 0 to n - 1, many at a time: ``up`` is the smallest place that each is joined with so far."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while ((above := self.up[self.up]) != self.up).any():
                self.up = above

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places that are not the smallest of theirs, and those smallest."""
        low = np.flatnonzero(self.up != np.arange(len(self.up)))
        return low, self.up[low]


def _parents(edges: DataFrame, name: str) -> DataFrame:
    """(u, p): for every end of ``edges`` (u, v) an end that links reach and that is not larger, where it is another one.

    Each end takes the least of its neighbours, a minimum that is pre-aggregated, then twice the choice of its choice.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = save(both.groupBy("u").agg(F.min("v").alias("p")).where("p < u"), name)
    second = first.toDF("p", "q")
    jumped = first.join(second, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    return save(jumped.join(second, "p", "left").select("u", F.coalesce("q", "p").alias("p")), name)


def moved(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with the nodes in ``column`` replaced by their parents; both sides are written, so a hot node can be split."""
    found = rows.join(parents.toDF("_u", "_p"), F.col(column) == F.col("_u"), "left")
    return found.withColumn(column, F.coalesce("_p", column)).drop("_u", "_p")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b) that is not the smallest that links reach; root is that smallest one.

    Each round moves every end to a smaller one and contracts the edges, so what a round has joined (stars above all)
    does not come again. A node's root is found through the moves of all rounds.
    """
    now = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    moves = []
    while not now.isEmpty():
        moves.append(_parents(now, name))
        ends = moved(moved(now, "u", moves[-1]), "v", moves[-1])
        now = save(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), name)
    if not moves:
        return now.toDF("node", "root")
    found = moves[0].toDF("node", "root")
    for i, move in enumerate(moves[1:]):
        fresh = move.toDF("node", "root").join(found.select("node"), "node", "left_anti")  # least of their neighbours so far
        found = moved(found, "root", move).union(fresh)
        found = save(found, name) if i + 2 < len(moves) else found
    return save(found, name)
