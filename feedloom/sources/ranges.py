"""Documents of any size as chunks: cut in parallel, with the parser's state at the start of each found by composing effects.

Spark's text reader splits a large file into byte ranges; with the most frequent mark of a format as its line separator, ranges
and chunks begin right after such a mark, even where a document has no line break. A chunk's effect tells what the chunk does to
the parser's state, whatever that state is; the states at all chunks follow by applying the effects of a document in order, a few
bytes for each CHUNK of it. With its state a chunk is parsed alone, by any task.

Files that the text reader cannot split so (compressed without a suffix, UTF-16 and UTF-32) are decoded by one task each and cut there.
"""

from __future__ import annotations

import codecs
import gzip
import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.plans.tables import counted_broadcast, written

#: Bytes of a chunk: what a task parses at a time.
CHUNK = 4 << 20
#: Byte order marks of encodings whose characters are no single bytes, longest first.
_WIDE = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


class Place(NamedTuple):
    """Of a byte: how many come before it, its line and its column in characters, both from 1."""

    offset: int = 0
    line: int = 1
    column: int = 1

    def after(self, data: bytes, size: int) -> Place:
        """The place ``size`` bytes on in ``data``, which begins here."""
        lines = data.count(b"\n", 0, size)
        begin = data.rfind(b"\n", 0, size) + 1
        wide = len(data[begin:size].decode("utf-8", "replace"))
        return Place(self.offset + size, self.line + lines, wide + (1 if lines else self.column))

    def moved(self, by: Place) -> Place:
        """The place that is at ``by`` of a chunk which begins here."""
        return Place(self.offset + by.offset, self.line + by.line - 1, by.column + (self.column - 1 if by.line == 1 else 0))


class Start(NamedTuple):
    """Where a chunk begins, in which state, its number in the document, and whether it is the last."""

    place: Place
    state: Any
    number: int
    last: bool
    has_mark: bool


def _text(data: bytes) -> bytes:
    """Content that the text reader cannot take, as UTF-8."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for mark, name in _WIDE:
        if data.startswith(mark):
            return data.decode(name, "replace").encode()
    return data.removeprefix(codecs.BOM_UTF8)


_CHUNKS = "doc int, block long, seq int, size long, data binary, effect binary"
_NAMES = ["doc", "block", "seq", "size", "data", "effect"]


def _packed(mark: bytes, effect: Callable[[bytes], Any], chunk: int):
    """Rows between marks, in order, as chunks with their effects."""

    def out(key: tuple[int, int, int], seq: int, held: list[list[bytes]]) -> pa.RecordBatch:
        data = mark.join(v for part in held for v in part) + mark
        return pa.RecordBatch.from_pylist([{"doc": key[0], "block": key[1], "seq": seq, "size": key[2], "data": data, "effect": _saved(data, effect)}], schema=_schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size = None, 0, [], 0
        for batch in batches:
            docs, blocks, sizes = (batch.column(c).to_numpy() for c in ("doc", "block", "size"))
            values, at = batch.column("value").to_pylist(), 0
            while at < len(values):
                own = (int(docs[at]), int(blocks[at]), int(sizes[at]))
                if own != key:
                    if held:
                        yield out(key, seq, held)
                    key, seq, held, size = own, 0, [], 0
                stop = at
                while stop < len(values) and size < chunk and docs[stop] == own[0] and blocks[stop] == own[1]:
                    size += len(values[stop]) + 1
                    stop += 1
                if stop > at:
                    held.append(values[at:stop])
                if size >= chunk:
                    yield out(key, seq, held)
                    seq, held, size = seq + 1, [], 0
                at = stop
        if held:
            yield out(key, seq, held)

    return run


def _schema() -> pa.Schema:
    return pa.schema([("doc", pa.int32()), ("block", pa.int64()), ("seq", pa.int32()), ("size", pa.int64()), ("data", pa.binary()), ("effect", pa.binary())])


def _saved(data: bytes, effect: Callable[[bytes], Any]) -> bytes:
    """A chunk's size and the place of its end, as from its own start, with its effect."""
    return pickle.dumps((Place().after(data, len(data)), effect(data)))


def cut_whole(data: bytes, mark: bytes, chunk: int) -> list[bytes]:
    """``data`` in pieces of about ``chunk`` bytes that end with ``mark``, but for the last."""
    out, at = [], 0
    while at < len(data):
        stop = data.find(mark, min(len(data), at + chunk - 1))
        stop = len(data) if stop < 0 else stop + 1
        out.append(data[at:stop])
        at = stop
    return out or [b""]


def _decoded(mark: bytes, effect: Callable[[bytes], Any], chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column("doc").to_pylist(), batch.column("content"), strict=True):
                try:
                    data = _text(content.as_py())
                except (OSError, EOFError):  # damaged compression: no document
                    data = b""
                for seq, part in enumerate(cut_whole(data, mark, chunk)):
                    yield pa.RecordBatch.from_pylist([{"doc": doc, "block": 0, "seq": seq, "size": len(data), "data": part, "effect": _saved(part, effect)}], schema=_schema())

    return run


def chunks_of(spark: SparkSession, files: list[str], mark: bytes, effect: Callable[[bytes], Any], heads: list[bytes], chunk: int | None = None) -> DataFrame:
    """doc (number in ``files``), block, seq, size, data, effect: the chunks of files, a written table.

    ``heads`` holds the first bytes of each file; files without content have no chunk.
    """
    chunk = chunk or CHUNK
    odd = [h[:2] == b"\x1f\x8b" and not f.lower().endswith(".gz") or any(h.startswith(m) for m, _ in _WIDE) for f, h in zip(files, heads, strict=True)]
    out = spark.createDataFrame([], _CHUNKS)
    for wide in (False, True):
        own = [(i, f, -1 if f.lower().endswith(".gz") else 0) for i, f in enumerate(files) if odd[i] == wide]
        if not own:
            continue
        paths = sorted({f for _, f, _ in own})
        if not wide:  # the text reader names files as addresses do
            own = [(i, spark._jvm.org.apache.hadoop.fs.Path(f).toUri().toString(), packed) for i, f, packed in own]
        listed = F.broadcast(spark.createDataFrame(own, "doc int, path string, packed long"))  # bounded: the caller's list
        if wide:
            read = spark.read.format("binaryFile").load(paths).select("path", "content").join(listed, "path").select("doc", "content")
            out = out.union(read.mapInArrow(_decoded(mark, effect, chunk), _CHUNKS))
        else:
            where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes")]
            read = spark.read.option("lineSep", mark.decode()).text(paths).select(*where, F.col("value").cast("binary").alias("value"))
            read = read.join(listed, "path").select("doc", "block", F.when(F.col("packed") < 0, -1).otherwise(F.col("bytes")).cast("long").alias("size"), "value")
            out = out.union(read.mapInArrow(_packed(mark, effect, chunk), _CHUNKS))
    return written(out, "chunks")


def _ends_with_mark(data_end: int, size: int) -> bool:
    """Whether the last mark of a document, which is added to each row, is in the file; a byte order mark is not in the rows."""
    return data_end in (size, size - 3) if size >= 0 else True


def fold(rows: list[tuple[int, bytes]], begin: Any, step: Callable[[Any, Any, Start], Any]) -> list[bytes]:
    """For each chunk (size of its file, saved effect) of a document its pickled ``Start``."""
    state, place, out = begin, Place(), []
    for number, (size, saved) in enumerate(rows):
        end, effect = pickle.loads(saved)
        after = place.moved(end)
        last = number == len(rows) - 1
        start = Start(place, state, number, last, _ends_with_mark(after.offset, size))
        out.append(pickle.dumps(start))
        if not last:
            state, place = step(state, effect, start), after
    return out


def started(chunks: DataFrame, begin: Any, step: Callable[[Any, Any, Start], Any]) -> DataFrame:
    """doc, data, start: each chunk with the state it begins in."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
        rows = list(zip(table.column("size").to_pylist(), table.column("effect").to_pylist(), strict=True))
        return table.select(["doc", "block", "seq"]).append_column("start", pa.array(fold(rows, begin, step), pa.binary()))

    states = chunks.select("doc", "block", "seq", "size", "effect").groupBy("doc").applyInArrow(run, "doc int, block long, seq int, start binary")
    return chunks.select("doc", "block", "seq", "data").join(counted_broadcast(written(states, "chunk-states")), ["doc", "block", "seq"]).select("doc", "data", "start")


def loaded(batch: pa.RecordBatch, mark: bytes) -> Iterator[tuple[int, bytes, Start]]:
    """doc, data and start of the chunks of a batch; of the last chunk without the mark that the file does not have."""
    for doc, data, start in zip(batch.column("doc").to_pylist(), batch.column("data").to_pylist(), batch.column("start").to_pylist(), strict=True):
        begun = pickle.loads(start)
        yield doc, data if begun.has_mark or not data.endswith(mark) or not begun.last else data[: -len(mark)], begun
