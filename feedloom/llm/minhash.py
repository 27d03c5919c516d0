"""MinHash near-duplicates with tensored banding.

Two small collections of ``GROUPS`` keys each (a key joins ``WIDTH`` minhashes) give GROUPS * GROUPS table keys, one for
each pair (i, j): 2 * GROUPS * WIDTH minhashes do the work of GROUPS * GROUPS * 2 * WIDTH. Two sets of similarity s meet
in some table with probability (1 - (1 - s ** WIDTH) ** GROUPS) ** 2: 0.9973 at 0.75, 0.9994 at 0.8.

Nothing is emitted for each pair of a group. Equal shingle sets fall together first. In ``STARS`` rounds every member of a
table key is compared with one leader of the key, and only keys whose members are still in different components go on. The
members that then remain apart are compared exactly, all with all of their key, inside tasks: keys are cut into tiles of
bounded size, the intersections of two tiles come from products of their membership matrices, and a task returns only links
that join components. Keys with the same members are compared once.

A round links the components of the rounds before, not their members, so each round only adds to what is joined. Both sides
of a join on a key, a leader or a root are written tables: adaptive execution can split a hot one.

Links are confirmed on full sets of 64-bit shingle hashes; two sets of n shingles differ from the sets of words by chance
n * n / 2 ** 64. A word's hash is a sum of mixed values of its bytes at their places, which no repetition pattern cancels.

Defined results: a null or wordless text has no shingle and links with nothing; one to four words are one shingle; equal
sets are one class whatever their doc_id; repeated rows each come back; a null doc_id is kept false and never names a
component unless all of its rows have none. Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Forest, connected_components, counted_broadcast, moved, save, small_batches, text_chunks, tidy

WORDS = 5
PERCENT = 75
GROUPS = 8
WIDTH = 2
#: Rounds of comparison with a leader before members that are still apart are compared with all of their key.
STARS = 3
#: Members, and shingles of all members, in a tile.
TILE, TILE_SHINGLES = 1024, 1 << 19
_COLUMNS = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEGMENT = 1 << 18
_JOIN = np.uint64(0xD6E8FEB86659FD93)
#: Places in a word whose letters' hashes are looked up.
_KNOWN = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _letter(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A 64-bit value for a byte at a place of a word; a word's hash is the sum of its bytes' values."""
    return _mix((place.astype(np.uint64) << np.uint64(8) | byte.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


with np.errstate(over="ignore"):
    _LETTERS = _letter(np.repeat(np.arange(_KNOWN), 256), np.tile(np.arange(256), _KNOWN))


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, and how many words begin before each cut; words never cross a cut."""
    space = _SPACE[data]
    fresh = np.empty(len(data), dtype=bool)
    fresh[:1] = True
    fresh[1:] = space[:-1]
    fresh[cuts[cuts < len(data)]] = True
    starts = np.flatnonzero(fresh & ~space)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    letters = _LOWER[data[starts[0] :]]
    near = place < _KNOWN
    if near.all():
        parts = _LETTERS[place << 8 | letters]
    else:
        parts = np.empty(len(place), np.uint64)
        parts[near] = _LETTERS[place[near] << 8 | letters[near]]
        parts[~near] = _letter(place[~near], letters[~near])
    parts[space[starts[0] :]] = 0
    return _mix(np.add.reduceat(parts, starts - starts[0])), np.searchsorted(starts, cuts)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the five-word shingles of each text (empty: none)."""
    hashes, counts, held, ends = [], [], [], [0]

    def flush() -> None:
        if held:
            data = np.frombuffer(b"".join(held), np.uint8)
            words, before = _word_hashes(data, np.asarray(ends))
            hashes.append(words)
            counts.extend(np.diff(before).tolist())
            held.clear()
            ends[:] = [0]

    for text in texts.cast(pa.large_binary()).to_pylist():
        text = text or b""
        if len(text) <= _SEGMENT:
            held.append(text)
            ends.append(ends[-1] + len(text))
            if ends[-1] > _SEGMENT:
                flush()
            continue
        flush()
        at, words = 0, []
        while at < len(text):  # a very long text, cut at white space
            end = at + _SEGMENT
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            piece = np.frombuffer(text[at:end], np.uint8)
            words.append(_word_hashes(piece, np.asarray([0, len(piece)]))[0])
            at = end
        hashes.append(np.concatenate(words))
        counts.append(len(hashes[-1]))
    flush()
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    n = len(flat) - WORDS + 1
    rolled = flat[: max(n, 0)].copy()
    for k in range(1, WORDS):
        rolled *= _JOIN
        rolled += flat[k : k + max(n, 0)]
    rolled = _mix(rolled)
    out, at = [], 0
    for count in counts:
        if count >= WORDS:
            out.append(np.unique(rolled[at : at + count - WORDS + 1]))
        elif count:
            value = np.uint64(count)
            for x in flat[at : at + count]:
                value = value * _JOIN + x
            out.append(_mix(np.asarray([value], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_751).integers(0, 1 << 63, size=(2, 2 * GROUPS * WIDTH), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times, plus = _coefficients()
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in text_chunks(batch):
                sets = shingle_sets(part.column("text"))
                filled = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), 2 * GROUPS), np.uint64)
                if filled:
                    flat = np.concatenate([sets[i] for i in filled])
                    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in filled])[:-1]])
                    for g in range(2 * GROUPS):
                        joined = np.zeros(len(filled), np.uint64)
                        for h in range(g * WIDTH, g * WIDTH + WIDTH):
                            joined = _mix(joined * _JOIN + np.minimum.reduceat(flat * times[h] + plus[h], starts))
                        keys[filled, g] = joined
                signed = keys.view(np.int64)
                halves = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * GROUPS), pa.array(np.ascontiguousarray(signed[:, k : k + GROUPS]).ravel())) for k in (0, GROUPS)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), *halves],
                    names=["doc_id", "h", "n_shingles", "set_key", "first_keys", "second_keys"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the rows whose text still has the wanted set key."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in text_chunks(batch):
                sets, keys = shingle_sets(part.column("text")), part.column("set_key").to_pylist()
                same = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == keys[i]]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(same, pa.int64())), pa.array([len(sets[i]) for i in same], pa.int64()), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["node", "n", "shingles"])


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, shingles) of ``nodes``, recomputed from one text of each class."""
    wanted = save(classes.join(nodes, "node", "left_semi").select("node", F.col("least.doc_id").alias("_id"), F.col("least.h").alias("_h"), "set_key"), "minhash-wanted")
    met = docs.join(counted_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")))
    return save(met.select("node", "set_key", "text").mapInArrow(tidy(_sets), "node long, n long, shingles array<long>").dropDuplicates(["node"]), "minhash-sets", "uncompressed")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y) of the pairs (a, b, x, y) whose full sets reach the similarity; x and y are the components of a and b."""
    size = sets.select("node", "n")
    sized = pairs.distinct().join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    sized = save(sized.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")), "minhash-pairs")
    shared = F.size(F.array_intersect("sa", "sb"))
    whole = sets.select("node", "shingles")
    both = sized.join(whole.toDF("b", "sb"), "b").join(whole.toDF("a", "sa"), "a")
    return both.where(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select("x", "y").distinct()


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of links (x, y) between components."""
    return connected_components(links.toDF("a", "b"), "minhash-components")


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, node, comp), moved by ``comps``, of the keys that are left in more than one component."""
    held = save(moved(members, "comp", comps), "minhash-held")
    split = save(held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "minhash-split")
    return save(held.join(split, "key", "left_semi"), "minhash-apart")


def _star(apart: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, x, y) of another leader of each key and the members that are not in its component."""
    leader = save(apart.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).alias("l")), "minhash-leaders")
    met = apart.join(leader, "key").where(F.col("comp") != F.col("l.comp"))
    return met.select(F.col("l.node").alias("a"), F.col("node").alias("b"), F.col("l.comp").alias("x"), F.col("comp").alias("y"))


def _tile_links(table: pa.Table) -> pa.Table:
    """Links (x, y) between components that the pairs of two tiles of a key (or within one) join."""
    table = table.combine_chunks()
    comps, sides = (table.column(c).to_numpy() for c in ("comp", "side"))
    lists = table.column("shingles").combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    owner = np.repeat(np.arange(len(comps)), sizes)
    _, column, often = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    met = often[column] > 1
    order = np.argsort(column[met], kind="stable")
    column, owner = np.unique(column[met][order], return_inverse=True)[1], owner[met][order]
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    alone = not len(right)
    right = left if alone else right
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + _COLUMNS])
        dense = np.zeros((len(comps), _COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        shared += dense[left] @ dense[right].T
    like = 100 * shared >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - shared)
    like &= comps[left][:, None] != comps[right][None, :]
    i, j = np.nonzero(like)
    named, place = np.unique(comps, return_inverse=True)
    forest = Forest(len(named))
    forest.join(place[left[i]], place[right[j]])
    x, y = forest.links()
    return pa.table({"x": pa.array(named[x], pa.int64()), "y": pa.array(named[y], pa.int64())})


def _remaining(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (x, y) that join components, from comparing all members of each key that is still apart."""
    sized = apart.join(sets.select("node", "n"), "node")
    keys = sized.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    once = keys.groupBy("members", "total", "mark").agg(F.min("key").alias("key"))
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    tiled = save(once.select("key", tiles.alias("tiles")), "minhash-tiles")
    placed = apart.join(tiled, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    sent = placed.select("key", "node", "comp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    sent = sent.select("key", "node", "comp", F.least("tile", "t").alias("i"), F.greatest("tile", "t").alias("j"), (F.col("tile") > F.col("t")).cast("int").alias("side"))
    return sent.join(sets.select("node", "shingles"), "node").groupBy("key", "i", "j").applyInArrow(_tile_links, "x long, y long").distinct()


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, set_key) and classes (set_key, node, root, least, component_id), both written.

    h is a hash of the text; least, (doc_id is null, doc_id, h), names the first row of a class; nodes are numbered in the
    order of least, so the smallest node of a component, its root, holds the component's first row.
    """
    docs = small_batches(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.withColumn("h", F.xxhash64("text")).mapInArrow(tidy(_signatures), f"doc_id {kind}, h long, n_shingles long, set_key binary, first_keys array<long>, second_keys array<long>")
    rows = save(signed, "minhash-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    grouped = rows.where("set_key is not null").groupBy("set_key").agg(least, F.first("first_keys").alias("first_keys"), F.first("second_keys").alias("second_keys"))
    classes = save(grouped.orderBy("least").withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    keys = classes.select("node", "second_keys", F.posexplode("first_keys").alias("i", "x")).select("node", "i", "x", F.posexplode("second_keys").alias("j", "y")).select("node", F.xxhash64("i", "x", "j", "y").alias("key"))
    shared = save(keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "minhash-shared")
    members = save(keys.join(counted_broadcast(shared), "key"), "minhash-members")

    sets = _sets_of(docs, classes, members.select("node").distinct())
    pairs = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("first").alias("x"), F.col("node").alias("y"))
    comps = [_joined(_confirmed(pairs, sets))]
    apart = _apart(members.select("key", "node", F.col("node").alias("comp")), comps[-1])
    for turn in range(1, STARS + 1):
        if apart.isEmpty():
            break
        comps.append(_joined(_confirmed(_star(apart, turn), sets) if turn < STARS else _remaining(apart, sets)))
        if turn < STARS:
            apart = _apart(apart, comps[-1])

    placed = classes.select("set_key", "node", F.col("node").alias("root"), "least")
    for found in comps:
        placed = moved(placed, "root", found)
    first = classes.select(F.col("node").alias("root"), F.col("least.doc_id").alias("component_id"))
    return rows.select("doc_id", "h", "n_shingles", "set_key"), save(placed.join(first, "root"), "minhash-named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    ``kept`` is doc_id = component_id; see the module for the method and for nulls, ties and empty texts.
    """
    rows, named = _named(docs)
    out = rows.join(named.select("set_key", "component_id"), "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group; every column is kept, whatever its name.

    The row with the smallest doc_id stays, one without a doc_id only if the whole group has none; of different texts under
    that doc_id the one with the smallest hash, and of rows that repeat it one. Texts without words, null ones too, are
    linked with nothing and all stay. An empty table stays empty.
    """
    rows, named = _named(docs)
    placed = rows.where("set_key is not null").join(named.select("set_key", "node", "root", "least"), "set_key")
    stays = (F.col("node") == F.col("root")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))
    judged = save(placed.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "minhash-judged")

    def of(some: DataFrame, how: str) -> DataFrame:
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.h"))
        return docs.alias("a").join(counted_broadcast(save(some.select("doc_id", "h"), "minhash-spare")).alias("b"), same, how)

    again = judged.where("stays and n > 1")
    if again.isEmpty():
        return of(judged.where("not stays"), "left_anti")
    return of(judged.where("not stays or n > 1"), "left_anti").union(of(again, "left_semi").dropDuplicates(["doc_id", "text"]))
