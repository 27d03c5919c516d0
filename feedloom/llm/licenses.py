"""License scan: an exact set-similarity join of text blocks with license templates.

A text's words (A-Z lower-cased) are cut into overlapping blocks. Templates go by length, in words with repeats, to a stride
of ``STRIDE`` words, twice that, four times and so on; blocks of two strides begin at every stride, so a template lies whole
in some block wherever it stands, and a short one is not looked for in long blocks. A block meets a template if it holds at
least ``CONTAINED`` of the template's distinct words. The template words are ordered by how many documents of the whole
input hold them, rarest first; a block can only meet a template whose prefix (its rarest words, one more than may be missing)
it touches, whose needed words it is long enough for, and for which the places of the first shared word in both orders leave
enough words. What passes is counted exactly. The templates are a list that the caller gives: their index goes to every
task, and their word counts are summed by Spark.

Of templates of one family (versions of a license), a block gets the one it holds most of. Base phrases are found by
place: every start where a phrase's words stand in a row. Defined results: a null or wordless text has no block, no place,
empty labels and score 0; ties inside a family give both labels; repeated rows each come back.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, text_chunks

#: Words between the beginnings of two blocks, for the shortest templates.
STRIDE = 32
CONTAINED = 0.9

#: Phrases whose words stand in a row, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, family, text
DEFAULT_TEMPLATES = [
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org"),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "cc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "cc", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("gpl-2", "gpl", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Lower-case words stay; what separates words becomes a blank; bytes of other characters are word bytes.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split(b" ") if text else []


@dataclass
class Index:
    """Templates as words in the global order, and the templates that each prefix word leads to."""

    labels: list[str]
    families: list[str]
    ordered: list[list[bytes]]
    needed: list[int]
    rank: dict[bytes, int]
    prefixes: dict[int, dict[bytes, list[int]]]  # by stride

    @staticmethod
    def build(templates: list[tuple[str, str, str]], often: dict[bytes, int], contained: float) -> Index:
        sets = [{w for w in words_of(t) if w} for _, _, t in templates]
        rank = {w: i for i, w in enumerate(sorted(set().union(*sets), key=lambda w: (often.get(w, 0), w)))}
        ordered = [sorted(s, key=rank.__getitem__) for s in sets]
        needed = [max(1, math.ceil(contained * len(s) - 1e-9)) for s in sets]
        prefixes: dict[int, dict[bytes, list[int]]] = {}
        for i, (words, need) in enumerate(zip(ordered, needed, strict=True)):
            stride = STRIDE
            while stride < sum(map(bool, words_of(templates[i][2]))):
                stride *= 2
            for w in words[: len(words) - need + 1]:
                prefixes.setdefault(stride, {}).setdefault(w, []).append(i)
        return Index([t[0] for t in templates], [t[1] for t in templates], ordered, needed, rank, prefixes)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(start, end, label, contained) of every block and template that meet, starts and ends in words."""
        distinct = set(words)
        return [m for stride, prefixes in sorted(self.prefixes.items()) if (held := prefixes.keys() & distinct) for m in self._blocks(words, stride, prefixes, held)]

    def _blocks(self, words: list[bytes], stride: int, prefixes: dict[bytes, list[int]], held: set[bytes]) -> Iterator[tuple[int, int, str, float]]:
        wanted: dict[int, set[int]] = {}
        for at, w in enumerate(words):
            if w in held:
                for block in {max(at // stride - 1, 0), at // stride}:
                    wanted.setdefault(block, set()).update(prefixes[w])
        for block in sorted(wanted):
            span = words[block * stride : (block + 2) * stride]
            known = sorted(set(span) & self.rank.keys(), key=self.rank.__getitem__)
            place = {w: j for j, w in enumerate(known)}
            best: dict[str, list[tuple[float, str]]] = {}
            for i in wanted[block]:
                words_i, need = self.ordered[i], self.needed[i]
                if len(known) < need:
                    continue
                first = next((k for k, w in enumerate(words_i) if w in place), None)
                if first is None or min(len(words_i) - first, len(known) - place[words_i[first]]) < need:
                    continue
                shared = sum(w in place for w in words_i)
                if shared >= need:
                    best.setdefault(self.families[i], []).append((shared / len(words_i), self.labels[i]))
            for found in best.values():
                most = max(f for f, _ in found)
                for share, label in sorted(set(found)):
                    if share == most:
                        yield block * stride, block * stride + len(span), label, share


def _places(words: list[bytes]) -> list[tuple[int, str]]:
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES.items():
        wanted, last, n, at = b" " + phrase.encode() + b" ", 0, 0, -1
        while (at := joined.find(wanted, at + 1)) >= 0:
            n += joined.count(b" ", last, at)
            last = at
            out.append((n, label))
    return out


def _frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each template word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in text_chunks(batch):
                for text in part.column("text").to_pylist():
                    counts.update(words & set(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    summed = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in summed.collect()}  # at most the templates' words


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, places (start, label) and blocks (start, end, label, contained) for every row of ``docs``."""
    templates = DEFAULT_TEMPLATES if templates is None else templates
    docs = small_batches(docs.select("doc_id", "text"))
    index = Index.build(templates, _frequencies(docs, {w for _, _, t in templates for w in words_of(t) if w}), contained)
    held = docs.sparkSession.sparkContext.broadcast(index)
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                counts, places, blocks = [], [], []
                for text in part.column("text").to_pylist():
                    words = [w for w in words_of(text) if w]
                    counts.append(len(words))
                    places.append([{"start": s, "label": k} for s, k in sorted(_places(words))])
                    blocks.append([{"start": s, "end": e, "label": k, "contained": c} for s, e, k, c in held.value.matches(words)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(blocks, block)], names=["doc_id", "n_words", "places", "blocks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, places array<struct<start:bigint,label:string>>, blocks array<struct<start:bigint,end:bigint,label:string,contained:double>>")


def summarise(scanned: DataFrame) -> DataFrame:
    """The counts, labels and score of scanned rows: 1 with a base place, else the largest containment, else 0."""
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["start"])
    every = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["contained"])), F.lit(0.0))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"), join(every).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
