"""Byte-level BPE encoding and decoding by tree concatenation.

Ordinary texts are encoded where they are. A long text becomes leaves which are encoded in parallel on other executors, and
a shorter one with few blanks becomes leaves on the spot: ordinary leaves end before a space or line feed that
follows a visible character (no token of the vocabulary's pattern spans such a place), and a single pattern match longer
than ``UNSPLIT`` characters is halved into chunks. Leaves are joined pairwise in a tree: plainly where the split was safe;
within one match by encoding a growing window of tokens around the join until its first and last token are those of the two
sides. Then every neighbouring pair of tokens comes from some exact encoding, which makes the whole sequence exact.

Ids are those of the tokenizer file (its merges in id order, its added tokens found in the text). Defined results: a null
or empty text has no ids and decodes to an empty text; repeated rows each come back; equal long texts are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import save, small_batches, text_chunks, tidy

#: Size of an ordinary leaf (texts of more bytes are split), and of a stretch without split from which it is halved.
LEAF = 1 << 15
UNSPLIT = 1 << 11
#: Fixed value: the published pattern that this kind of vocabulary is split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, Codec] = {}


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        merged = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        ids = [said["model"]["vocab"][a + b] for a, b in merged]
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
            raise ValueError("the ids of the tokenizer are not in merge order")
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.size, self.bytes = size, [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def encode(self, text: str) -> list[int]:
        if self.special and self.marks.search(text):
            return self.encoding.encode(text, allowed_special="all", disallowed_special=())
        return self.encoding.encode_ordinary(text)

    def encode_all(self, text: str) -> list[int]:
        """The ids of a text, through leaves if it has few blanks for its length."""
        if len(text) > UNSPLIT and text.count(" ") * 64 < len(text):
            return join_tree([(k, encode_leaf(k, p, self)) for k, p in leaves(text, self)], self)
        return self.encode(text)

    def piece(self, data: bytes) -> list[int]:
        """Ids of bytes that lie within one match of the pattern."""
        return self.encoding._encode_single_piece(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of one match, from the ids of each."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.piece(b"".join(self.bytes[i] for i in a + b))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The codec of a file, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


#: Kinds of leaves: ordinary text, the first chunk of one long match, a later chunk of it.
TEXT, FIRST, LATER = 0, 1, 2


def leaves(text: str, c: Codec, leaf: int = LEAF, unsplit: int = UNSPLIT) -> list[tuple[int, str]]:
    """(kind, piece): pieces that make up ``text`` and can be encoded apart."""
    out: list[tuple[int, str]] = []
    places = [m.start() for m in re.finditer(r"(?<=\S)[ \n]", text)] + [len(text)]
    start = last = 0
    for place in places:
        if place - last > unsplit:  # a stretch without a safe place
            if last > start:
                out.append((TEXT, text[start:last]))
            out.extend(_stretch(text[last:place], c, leaf, unsplit))
            start = place
        elif place - start > leaf:
            if last > start:
                out.append((TEXT, text[start:last]))
                start = last
        last = place
    if last > start:
        out.append((TEXT, text[start:last]))
    return out


def _stretch(text: str, c: Codec, leaf: int, unsplit: int) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append((TEXT, "".join(held)))
            held.clear()

    at = 0
    for mark in [*c.marks.finditer(text), None]:
        size = 0
        for m in regex.finditer(PATTERN, text[at : mark.start() if mark else len(text)]):
            piece = m.group()
            if len(piece) > unsplit:
                flush()
                out.extend((LATER if i else FIRST, piece[i : i + unsplit]) for i in range(0, len(piece), unsplit))
                size = 0
                continue
            held.append(piece)
            size += len(piece)
            if size > leaf:
                flush()
                size = 0
        flush()
        if mark:
            out.append((TEXT, mark.group()))
            at = mark.end()
    return out


def encode_leaf(kind: int, piece: str, c: Codec) -> list[int]:
    return c.encode(piece) if kind == TEXT else c.piece(piece.encode())


def join_tree(parts: list[tuple[int, list[int]]], c: Codec) -> list[int]:
    """The ids of a text from (kind, ids) of its leaves in order, joined pairwise."""
    while len(parts) > 1:
        joined = []
        for i in range(0, len(parts), 2):
            if i + 1 == len(parts):
                joined.append(parts[i])
            else:
                (kind, a), (later, b) = parts[i], parts[i + 1]
                joined.append((kind, c.join(a, b) if later == LATER else a + b))
        parts = joined
    return parts[0][1] if parts else []


#: Makes the output columns from the ids of some texts.
Finish = Callable[[list[list[int]], "Codec"], list[pa.Array]]


def _packed(all_ids: list[list[int]], c: Codec) -> list[pa.Array]:
    return [pa.array([np.asarray(i, c.kind).tobytes() for i in all_ids], pa.binary())]


def _digested(all_ids: list[list[int]], c: Codec) -> list[pa.Array]:
    said = [hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest() for ids in all_ids]
    texts = [hashlib.sha256(c.decode(ids).encode()).hexdigest() for ids in all_ids]
    return [pa.array([len(ids) for ids in all_ids], pa.int64()), pa.array(said, pa.string()), pa.array(texts, pa.string())]


IDS, DIGESTS = ("ids",), ("n_tokens", "ids_sha256", "decoded_sha256")
_FIELDS = {IDS: "ids binary", DIGESTS: "n_tokens long, ids_sha256 string, decoded_sha256 string"}


def _whole(path: str, names: tuple[str, ...], finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_chunks(batch):
                ids = [c.encode_all(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *finish(ids, c)], names=["doc_id", *names])

    return run


def _split(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = leaves(text, c)
                for at in range(0, len(cut), 64):
                    some = cut[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([k for k, _ in some], pa.int32()), pa.array([p for _, p in some], pa.string())], names=["key", "part", "kind", "piece"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_chunks(batch, "piece"):
                ids = [encode_leaf(k, p, c) for k, p in zip(part.column("kind").to_pylist(), part.column("piece").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("part"), part.column("kind"), *_packed(ids, c)], names=["key", "part", "kind", "ids"])

    return run


def _joined(path: str, names: tuple[str, ...], finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].as_py()
                ids = join_tree([(p["kind"], np.frombuffer(p["ids"], c.kind).tolist()) for p in parts], c)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), *finish([ids], c)], names=["key", *names])

    return run


def is_long(text: Column) -> Column:
    """Texts that are split into leaves for other tasks."""
    return F.coalesce(F.octet_length(text) > LEAF, F.lit(False))


def _through(docs: DataFrame, path: str, names: tuple[str, ...], finish: Finish) -> DataFrame:
    """doc_id and the columns that ``finish`` makes, in the worker that completes the ids of a text."""
    docs = small_batches(docs.select("doc_id", "text"))
    kind, fields = docs.schema["doc_id"].dataType.simpleString(), _FIELDS[names]
    short = docs.where(~is_long(F.col("text"))).mapInArrow(tidy(_whole(path, names, finish)), f"doc_id {kind}, {fields}")
    long = docs.where(is_long(F.col("text"))).withColumn("key", F.sha2("text", 256))
    cut = long.select("key", "text").dropDuplicates(["key"]).mapInArrow(tidy(_split(path)), "key string, part int, kind int, piece string")
    done = cut.repartition("key", "part").mapInArrow(tidy(_encoded(path)), "key string, part int, kind int, ids binary")
    parts = done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "kind", "ids"))).alias("parts"))
    whole = save(parts.mapInArrow(tidy(_joined(path, names, finish)), f"key string, {fields}"), "bpe-long")
    return short.union(long.select("doc_id", "key").join(whole, "key").select("doc_id", *names))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian, 2 bytes each for up to 65,536 ids, else 4) for every row of ``docs`` (doc_id, text)."""
    return _through(docs, path, IDS, _packed)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """What ``digests`` of ``encode`` returns, without moving ids to a second worker; equal long texts are digested once.

    A null text counts as an empty one, which has no tokens; a null doc_id stays null; repeated rows each come back; columns
    besides doc_id and text are not read; an empty table stays empty.
    """
    return _through(docs, path, DIGESTS, _digested)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with decoded, the text of its ids (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_chunks(batch, "ids"):
                texts = [None if i is None else c.decode(np.frombuffer(i, c.kind).tolist()) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidy(run), f"{fields}, decoded string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of encoded rows, which it decodes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_chunks(batch, "ids"):
                ids = [np.frombuffer(data, c.kind).tolist() for data in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_digested(ids, c)], names=["doc_id", *DIGESTS])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, {_FIELDS[DIGESTS]}")
