"""Hard negatives by search in an inverted multi-index.

Vectors are split into two halves with a codebook each, fitted by k-means on at most ``SAMPLE`` rows; a pair of codes is a
cell. Rows are dealt by hash to shards of bounded size, each with its own lists of cells and, for each code of a half, the
radius of the shard's rows around it. For an anchor the score of a row is at most the sum over both halves of <anchor, code> +
|anchor| * radius. A multi-sequence heap visits the cells of a shard from the greatest bound down, over both codes sorted by
their half of the bound, and stops on certified windows: every list of the anchor is full with scores above the bound of all
cells to come, or those cells cannot reach its window. The lists are exact, whatever the codebooks.

One pass finds an anchor's positives among its label, a second one, with the windows these give, its negatives. Blocks of anchors
meet shards in tasks of bounded rows, and a task returns at most ``TOP`` rows for each anchor or window.

Work: vectors without structure have radii as wide as their halves, and the bounds then exclude no cell (README has figures);
anchors are a share of the rows, so CPU then grows with the square of the rows, memory of a task does not.

Defined results: rows with a null vec_id or label, or a vector that is null, empty, or holds a null or non-finite component take no
part, nor do rows whose squared length in integers exceeds 2 ** 62 (a score of theirs need not fit a long). Vectors of different
lengths never meet. Repeated rows are rows of their own; ties of score go by vec_id, then by label and vector. An anchor without
positives, or a positive without negatives, has no rows. Only vec_id, label and embedding are read; no rows give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import save, small_batches

TOP = 5
#: An anchor's negatives score between these per cent of its positive's score.
LOW, HIGH = 80, 100
SCALE = 256
#: Codes of each half, and rows at most that codebooks are fitted on.
CODES = 16
SAMPLE = 4096
#: Bytes of vectors in a shard and in a block of anchors: what a task holds of each.
SHARD_BYTES = 16 << 20
ANCHOR_BYTES = 2 << 20
#: Rows that the first visit of an anchor scores at least; each further one takes twice as many.
_FIRST = 256
_LARGEST = 1 << 62


def _whole(scale: int):
    """(vec_id, label, is_anchor, width, vector): components times ``scale`` as whole numbers, of rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, vector in enumerate(batch.column("embedding")):
                values = vector.values if vector.is_valid else None
                if values is None or not len(values) or values.null_count:
                    continue
                x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    if (x @ x) <= _LARGEST:
                        rows.append((i, len(x), x.astype(np.int64).tobytes()))
            kept = batch.select(["vec_id", "label", "is_anchor"]).take(pa.array([r[0] for r in rows], pa.int64()))
            added = [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *added], names=["vec_id", "label", "is_anchor", "width", "vector"])

    return run


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of whole numbers, in double precision where every sum of products is exact there."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), np.int64).reshape(len(vectors), -1)
    return x.astype(np.float64) if float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 2.0**52 else x


def _codebook(x: np.ndarray, codes: int, turns: int = 8) -> np.ndarray:
    """k-means around rows drawn evenly; an empty code keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]
    for _ in range(turns):
        near = _nearest(x, centres)
        for c in np.unique(near).tolist():
            centres[c] = x[near == c].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_codebooks(rows: DataFrame, codes: int = CODES, sample: int = SAMPLE) -> Codebooks:
    """By width of the vectors a codebook for each half, from the ``sample`` rows with the smallest hashes."""
    drawn = rows.select("width", "vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    books: Codebooks = {}
    for width in sorted({r.width for r in drawn}):
        x = np.stack([np.frombuffer(r.vector, np.int64) for r in drawn if r.width == width]).astype(np.float64)
        books[width] = _codebook(x[:, : width // 2], codes), _codebook(x[:, width // 2 :], codes)
    return books


class MultiIndex:
    """The rows of a shard by cells, with bounds on what a cell's rows can score."""

    def __init__(self, x: np.ndarray, books: tuple[np.ndarray, np.ndarray] | None) -> None:
        wide, self.half = x.astype(np.float64), x.shape[1] // 2
        halves = wide[:, : self.half], wide[:, self.half :]
        self.books = books if books is not None else tuple(np.zeros((1, h.shape[1])) for h in halves)  # width not in the sample: one cell
        codes = [_nearest(h, b) for h, b in zip(halves, self.books, strict=True)]
        self.radii = [np.full(len(b), -1.0) for b in self.books]
        for radius, h, b, c in zip(self.radii, halves, self.books, codes, strict=True):
            np.maximum.at(radius, c, np.sqrt(np.einsum("ij,ij->i", h - b[c], h - b[c])))
        cell = codes[0] * len(self.books[1]) + codes[1]
        self.order = np.argsort(cell, kind="stable")
        self.x = x[self.order]
        self.starts = np.searchsorted(cell[self.order], np.arange(len(self.books[0]) * len(self.books[1]) + 1))

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, stop) of cells with rows, from the greatest bound down; no later cell exceeds a bound."""
        q = anchor.astype(np.float64)
        halves = q[: self.half], q[self.half :]
        sums = [b @ h + np.sqrt(h @ h) * r for h, b, r in zip(halves, self.books, self.radii, strict=True)]
        codes = [np.argsort(-s, kind="stable") for s in sums]
        codes = [c[r[c] >= 0] for c, r in zip(codes, self.radii, strict=True)]  # codes without rows never bound one
        slack = 1e-9 * (1 + sum(float(np.abs(s).max()) for s in sums))  # rounding of the bound itself
        first, second = (s[c].tolist() for s, c in zip(sums, codes, strict=True))
        names = codes[0].tolist(), codes[1].tolist()
        wide = len(self.books[1])
        heap = [(-(first[0] + second[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = names[0][i] * wide + names[1][j]
            if self.starts[cell + 1] > self.starts[cell]:
                yield -bound + slack, int(self.starts[cell]), int(self.starts[cell + 1])
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], names: np.ndarray, top: int) -> tuple[list[list[tuple[int, int]]], int]:
        """For each window (least, most) the ``top`` rows (score, place) within it by score, then ``names``; and the rows scored.

        ``allowed`` says for each place in the shard's order whether the row may count; a bound of None is open. Each list is
        certified against the bounds of the cells that were not visited.
        """
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        cells, size, scored = self.cells(anchor), _FIRST, 0
        ahead = next(cells, None)
        while ahead is not None:
            open_ = [w for w, (least, _) in enumerate(windows) if (least is None or ahead[0] >= least) and (len(found[w]) < top or ahead[0] >= found[w][-1][0])]
            if not open_:
                break
            spans, rows = [], 0
            while ahead is not None and rows < size:
                spans.append(np.arange(ahead[1], ahead[2]))
                rows += ahead[2] - ahead[1]
                ahead = next(cells, None)
            size, scored = 2 * size, scored + rows
            place = np.concatenate(spans)
            place = place[allowed[place]]
            score = (self.x[place] @ anchor).astype(np.int64)
            for w in open_:
                least, most = windows[w]
                inside = np.ones(len(place), bool) if most is None else score <= most
                if least is not None:
                    inside &= score >= least
                if len(found[w]) == top:
                    inside &= score >= found[w][-1][0]
                at, value = place[inside], score[inside]
                if len(at) > top:  # all ties of the last that counts stay, the names decide
                    keep = value >= np.partition(value, len(value) - top)[len(value) - top]
                    at, value = at[keep], value[keep]
                merged = found[w] + list(zip(value.tolist(), names[at].tolist(), at.tolist(), strict=True))
                found[w] = sorted(merged, key=lambda r: (-r[0], r[1]))[:top]
        return [[(s, p) for s, _, p in rows] for rows in found], scored


def _searched(books: Codebooks, top: int, low: int, high: int, negatives: bool):
    """(row, slot, score, found, vec_id, tie) of a block of anchors in a shard: positives, or the negatives of each window."""
    out = pa.schema([("row", pa.int64()), ("slot", pa.int64()), ("score", pa.int64()), ("found", pa.int64()), ("vec_id", pa.int64()), ("tie", pa.int64())])

    def run(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return out.empty_table()
        width = key[0].as_py()
        index = MultiIndex(_matrix(rows.column("vector").combine_chunks()), books.get(width))
        rows = rows.take(pa.array(index.order))
        label, row, vec_id, tie = (rows.column(c).to_numpy() for c in ("label", "row", "vec_id", "tie"))
        rank = np.empty(len(row), np.int64)
        rank[np.lexsort((row, tie, vec_id))] = np.arange(len(row))  # of equal scores the smaller vec_id comes first
        x = _matrix(anchors.column("vector").combine_chunks())
        if x.dtype != index.x.dtype:
            x, index.x = x.astype(np.int64), index.x.astype(np.int64)
        got: list[tuple[int, int, int, int]] = []
        own_rows, own_labels = anchors.column("row").to_pylist(), anchors.column("label").to_pylist()
        scores = anchors.column("scores").to_pylist() if negatives else [[None]] * len(x)
        for anchor, own, kind, values in zip(x, own_rows, own_labels, scores, strict=True):
            if negatives:
                slots = sorted({v for v in values if v >= 0})  # a window below zero is empty
                windows = [(-(-low * v // 100), high * v // 100) for v in slots]
                allowed = label != kind
            else:
                slots, windows, allowed = [0], [(None, None)], (label == kind) & (row != own)
            for slot, hits in zip(slots, index.best(anchor, allowed, windows, rank, top)[0], strict=True):
                got += [(own, slot, score, place) for score, place in hits]
        place = np.asarray([g[3] for g in got], np.int64)
        return pa.table([[g[0] for g in got], [g[1] for g in got], [g[2] for g in got], row[place], vec_id[place], tie[place]], schema=out)

    return run


def _first(found: DataFrame, by: list[str], top: int) -> DataFrame:
    """The ``top`` rows of each group with their rank; a group has at most ``top`` rows of each shard."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "tie", "found"))).where(F.col("rank") <= top)


def relabelled(rows: DataFrame) -> DataFrame:
    """``rows`` with the label (label + 1) % 10 where vec_id is divisible by 7."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def hard_negatives(rows: DataFrame, anchor: Column | None = None, top: int = TOP, low: int = LOW, high: int = HIGH, codes: int = CODES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive of ``rows``.

    ``rows`` has vec_id, label and embedding; ``anchor`` (by default: vec_id divisible by 100) chooses the anchors. Positives are the
    ``top`` other rows of an anchor's label, negatives the ``top`` rows of other labels whose score is within ``low`` to ``high`` per
    cent of the positive's. See the module for nulls, ties and rows that take no part.
    """
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    spark = rows.sparkSession
    narrow = small_batches(rows.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor")))
    whole = narrow.mapInArrow(_whole(SCALE), "vec_id long, label long, is_anchor boolean, width int, vector binary")
    tied = whole.withColumn("tie", F.xxhash64("label", "vector"))
    placed = save(tied.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    books = fit_codebooks(placed)
    wide = placed.agg(F.count("*").alias("n"), F.max("width").alias("width")).first()
    if not wide["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    anchors = save(placed.where("is_anchor").drop("is_anchor"), "negatives-anchors")
    size = 8 * wide["width"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-wide["n"] * size // SHARD_BYTES), min(tasks, -(-wide["n"] // 1024)))
    blocks = max(1, -(-anchors.count() * size // ANCHOR_BYTES))

    def met(some: DataFrame, negatives: bool) -> DataFrame:
        left = some.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = placed.drop("is_anchor").withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pair = ["width", "block", "shard"]
        left, right = (d.withColumn("block", F.col("block").cast("int")).withColumn("shard", F.col("shard").cast("int")) for d in (left, right))
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_searched(books, top, low, high, negatives), "row long, slot long, score long, found long, vec_id long, tie long")

    positives = save(_first(met(anchors, False), ["row"], top).select("row", F.col("vec_id").alias("positive_id"), "score"), "negatives-positives")
    windows = anchors.join(positives.groupBy("row").agg(F.collect_set("score").alias("scores")), "row")
    negatives = _first(met(windows, True), ["row", "slot"], top)
    named = positives.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").withColumn("slot", F.col("score"))
    out = named.join(negatives.select("row", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["row", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
