"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors a cosine of at least t means a squared distance of at most 2 - 2 t. A seeded orthogonal rotation spreads
the distance over the dimensions, which are split into BLOCKS equal blocks: in at least one of them two such vectors are
within (2 - 2 t) / BLOCKS, and in none further than 2 - 2 t.

Equal vectors fall together first and count by their number. Cells around pivots (vectors drawn by hash, about one for each
tile of the input, PIVOTS at most) deal the others: a vector is at home in the cell of its nearest pivot, and visits a
later cell only if in some block it is within the block's radius of that cell's members, and within the whole radius in all
dimensions; so every pair of vectors meets once at most, and every pair that can link does. Cells are cut into tiles of
bounded bytes. For two tiles the first block is compared under the whole budget, what it leaves is range-joined in every
block under that block's budget, and the union of candidates is verified on the whole vectors in double precision. Tasks
return a count for each vector and a spanning forest of the links they saw, never the pairs of a group.

Work: where vectors have no structure, cells exclude little and the first block is compared for nearly all pairs (see README
for figures); memory of a task does not grow. Defined results: a vector that is null, empty, zero or holds a null or
non-finite component has no link and is its own component; vectors of different lengths never link; repeated rows are
vectors of their own; a null vec_id never names a component unless all of its vectors have none, and is its own component
(null) where nothing links with it. Only vec_id and embedding are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Forest, connected_components, moved, save, small_batches

THRESHOLD = 0.9
BLOCKS = 4
#: Bytes of the vectors of a tile (in double precision); a task holds two tiles, whatever the input.
TILE_BYTES = 8 << 20
#: Cells, and so pivots, at most: every task holds the pivots.
PIVOTS = 1024
#: Rows of a tile that are compared at a time, and rows of input that are compared with the pivots at a time.
_ROWS = 128
#: Bytes of the vectors of candidate pairs that are gathered at a time.
_GATHER = 16 << 20
#: Share of candidates from which whole products are cheaper than gathering pairs.
_DENSE = 1 / 16
_SLACK = 1e-5


@functools.cache
def rotation(width: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _starts(width: int) -> np.ndarray:
    """Where the blocks begin."""
    return np.linspace(0, width, min(BLOCKS, width) + 1).astype(int)[:-1]


def tile_rows(width: int) -> int:
    return max(1, TILE_BYTES // (8 * width))


def _squares(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each block the squared distances of all rows of ``a`` to all of ``b``."""
    for lo, hi in zip(starts, [*starts[1:], a.shape[1]], strict=True):
        x, y = a[:, lo:hi], b[:, lo:hi]
        yield np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T), 0)


def _keyed(kind: str):
    """(vec_id, key, vector): the values of each valid vector as bytes, and their digest; null where it is not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = [], []
            for vector in batch.column("embedding"):
                values = vector.values if vector.is_valid else None
                x = np.empty(0, kind) if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(kind) + 0
                wide = x.astype(np.float64)
                norm = wide @ wide
                valid = np.isfinite(norm) and norm > 0
                vectors.append(x.tobytes() if valid else None)
                keys.append(hashlib.blake2b(vectors[-1], digest_size=16).digest() if valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vector"])

    return run


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """Pivots of each width, turned, and for each (width, cell): rows at home, visitors, and radii (whole, then by block)."""

    def __init__(self, pivots: list[bytes], kind: str, threshold: float) -> None:
        self.kind, self.far = kind, 2 - 2 * threshold
        self.pivots: dict[int, np.ndarray] = {}
        for vector in pivots:
            unit = _units([vector], kind)
            width = unit.shape[1]
            self.pivots[width] = np.concatenate([self.pivots.get(width, np.empty((0, width))), unit @ rotation(width).T])
        self.radii: dict[int, np.ndarray] = {}
        self.home: dict[tuple[int, int], int] = {}
        self.visitors: dict[tuple[int, int], int] = {}

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        """Rows of equal width, and their distances to the pivots: rows by cells by (whole, blocks)."""
        for batch in batches:
            sizes = np.asarray([len(v) for v in batch.column("vector").to_pylist()])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), _ROWS):
                    part = batch.take(pa.array(own[at : at + _ROWS]))
                    width = size // np.dtype(self.kind).itemsize
                    if width not in self.pivots:  # few vectors of this width, none drawn: one cell
                        yield part, width, np.zeros((part.num_rows, 1, 1 + min(BLOCKS, width)))
                        continue
                    turned = _units(part.column("vector").to_pylist(), self.kind) @ rotation(width).T
                    squares = np.stack(list(_squares(turned, self.pivots[width], _starts(width))), axis=2)
                    yield part, width, np.sqrt(np.concatenate([squares.sum(axis=2, keepdims=True), squares], axis=2))

    def visits(self, width: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each row, and whether it visits each cell."""
        home = apart[:, :, 0].argmin(axis=1)
        budget = np.sqrt(np.concatenate([[self.far], np.full(apart.shape[2] - 1, self.far / (apart.shape[2] - 1))])) + _SLACK
        near = apart <= budget + self.radii[width][None]
        return home, near[:, :, 0] & near[:, :, 1:].any(axis=2) & (np.arange(apart.shape[1])[None, :] > home[:, None])


def _homes(cells: Cells):
    """(width, cell, n, radii) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for _, width, apart in cells.parts(batches):
            home = apart[:, :, 0].argmin(axis=1)
            for c in np.unique(home).tolist():
                n, radii = found.get((width, c), (0, np.zeros(apart.shape[2])))
                found[width, c] = n + int((home == c).sum()), np.maximum(radii, apart[home == c, c].max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)] + [pa.array([n for n, _ in found.values()], pa.int64()), pa.array([r.tolist() for _, r in found.values()], pa.list_(pa.float64()))], names=["width", "cell", "n", "radii"])

    return run


def _visitors(cells):
    """(width, cell, n): visitors among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for _, width, apart in cells.value.parts(batches):
            _, visits = cells.value.visits(width, apart)
            for c in np.flatnonzero(visits.any(axis=0)).tolist():
                found[width, c] = found.get((width, c), 0) + int(visits[:, c].sum())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int32()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], names=["width", "cell", "n"])

    return run


def _placed(cells):
    """Rows with each cell they are at home in or visit, and the number of tiles of that cell's rows and visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, width, apart in cells.value.parts(batches):
            home, visits = cells.value.visits(width, apart)
            rows, cell = np.nonzero(visits)
            rows, cell = np.concatenate([np.arange(len(home)), rows]), np.concatenate([home, cell])
            keys = [(width, c) for c in cell.tolist()]
            tiles = [[-(-counts.get(k, 0) // tile_rows(width)) for k in keys] for counts in (cells.value.home, cells.value.visitors)]
            taken = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([taken.column("node"), taken.column("weight"), taken.column("vector"), pa.array([width] * len(rows), pa.int32()), pa.array(cell, pa.int32()), pa.array(np.arange(len(rows)) >= len(home)), *(pa.array(t, pa.int32()) for t in tiles)], names=["node", "weight", "vector", "width", "cell", "visits", "homes", "visitors"])

    return run


def _joined(threshold: float, kind: str):
    """Links between the two sides of a pair of tiles: a count for each vector, and a forest."""
    far = np.float32(2 - 2 * threshold + _SLACK)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, sides, weights = (table.column(c).to_numpy() for c in ("node", "side", "weight"))
        unit = _units(table.column("vector").to_pylist(), kind)
        width = unit.shape[1]
        starts = _starts(width)
        budget = np.float32((2 - 2 * threshold) / len(starts) + _SLACK)
        turned = (unit @ rotation(width).T).astype(np.float32)
        rows, others = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        alone = not len(others)  # a tile with itself
        others = rows if alone else others
        counts, forest = np.zeros(len(nodes)), Forest(len(nodes))

        def linked(a: np.ndarray, b: np.ndarray) -> None:
            counts[:] += np.bincount(a, weights[b], len(nodes)) + np.bincount(b, weights[a], len(nodes))
            forest.join(a, b)

        for at in range(0, len(rows), _ROWS):
            part = rows[at : at + _ROWS]
            near = next(_squares(turned[part], turned[others], starts)) <= far
            if alone:
                near &= others[None, :] > part[:, None]
            some, met = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            inner = near[np.ix_(some, met)]
            if inner.size and inner.mean() > _DENSE:
                a, b = part[some], others[met]
                found = np.zeros(inner.shape, bool)
                for square in _squares(turned[a], turned[b], starts):
                    found |= square <= budget
                i, j = np.nonzero(found & inner & (unit[a] @ unit[b].T >= threshold))
                linked(a[i], b[j])
                continue
            i, j = np.nonzero(near)
            step = max(1, _GATHER // (4 * width))
            for k in range(0, len(i), step):
                a, b = part[i[k : k + step]], others[j[k : k + step]]
                gap = turned[a] - turned[b]
                gap *= gap
                blocks = np.add.reduceat(gap, starts, axis=1)
                found = (blocks <= budget).any(axis=1) & (blocks.sum(axis=1) <= far)
                a, b = a[found], b[found]
                same = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                linked(a[same], b[same])
        held = np.flatnonzero(counts)
        low, up = forest.links()
        return pa.table({"node": np.concatenate([nodes[held], nodes[low]]), "other": pa.array([None] * len(held) + nodes[up].tolist(), pa.int64()), "n": np.concatenate([counts[held], np.zeros(len(low))]).astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = save(small_batches(vectors).select("vec_id", "embedding").mapInArrow(_keyed(kind), f"vec_id {id_kind}, key binary, vector binary"), "vectors")
    grouped = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = save(grouped.orderBy("least").withColumn("node", F.monotonically_increasing_id()), "vector-classes")

    bare = classes.select("node", "weight", "vector")
    n, size = classes.agg(F.count("*"), F.coalesce(F.max(F.length("vector")), F.lit(1))).first()
    wanted = min(PIVOTS, -(-n // tile_rows(max(1, size // np.dtype(kind).itemsize))))
    pivots = classes.orderBy(F.xxhash64("key"), "key").limit(max(1, wanted)).select("vector").collect()
    cells = Cells([bytes(r["vector"]) for r in pivots], kind, threshold)
    widest = F.array_compact(F.array(*[F.max(F.get("radii", F.lit(i))) for i in range(BLOCKS + 1)]))
    for r in bare.mapInArrow(_homes(cells), "width int, cell int, n long, radii array<double>").groupBy("width", "cell").agg(F.sum("n").alias("n"), widest.alias("radii")).collect():
        radii = cells.radii.setdefault(r["width"], np.zeros((len(cells.pivots.get(r["width"], [0])), len(r["radii"]))))
        radii[r["cell"]] = r["radii"]
        cells.home[r["width"], r["cell"]] = r["n"]
    held = spark.sparkContext.broadcast(cells)
    for r in bare.mapInArrow(_visitors(held), "width int, cell int, n long").groupBy("width", "cell").agg(F.sum("n").alias("n")).collect():
        cells.visitors[r["width"], r["cell"]] = r["n"]
    held = spark.sparkContext.broadcast(cells)
    placed = bare.mapInArrow(_placed(held), "node long, weight long, vector binary, width int, cell int, visits boolean, homes int, visitors int")
    own = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("visits"), F.col("visitors")).otherwise(F.col("homes")), F.lit(1))).cast("int")
    placed = placed.withColumn("tile", own)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    # Where a row goes: (tile of side 0, tile of side 1, whether side 1 visits, side).
    at = lambda i, j, visit, side: F.struct(i.alias("i"), j.alias("j"), F.lit(visit).alias("visit"), side.cast("int").alias("side"))
    among = F.transform(upto("homes"), lambda t: at(F.least("tile", t), F.greatest("tile", t), False, F.col("tile") > t))
    meets = F.transform(upto("visitors"), lambda t: at(F.col("tile"), t, True, F.lit(0)))
    comes = F.transform(upto("homes"), lambda t: at(t, F.col("tile"), True, F.lit(1)))
    sent = placed.select("node", "weight", "vector", "width", "cell", F.explode(F.when(F.col("visits"), comes).otherwise(F.concat(among, meets))).alias("to"))
    sent = sent.select("node", "weight", "vector", "width", "cell", "to.*")
    found = save(sent.groupBy("width", "cell", "i", "j", "visit").applyInArrow(_joined(threshold, kind), "node long, other long, n long"), "vector-links")

    counts = save(found.where("other is null").groupBy("node").agg(F.sum("n").alias("n_links")), "vector-counts")
    comps = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    named = moved(classes.select("key", "node", "weight", F.col("node").alias("root")), "root", comps)
    first = classes.select(F.col("node").alias("root"), F.col("least.vec_id").alias("component_id"))
    named = named.join(counts, "node", "left").join(first, "root")
    named = save(named.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-named")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    own_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(False)).alias("kept"))
