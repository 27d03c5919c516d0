"""Ordered union of sources and first-wins deduplication over several identifiers."""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions.compat import strip
from feedloom.functions.transforms import name_key
from feedloom.plans.tables import written

#: Names of the fields that identify a record.
IDENTIFIERS = ("id", "guid", "reference", "url", "apply_url")


def ordered_union(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources with the place of their source; columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_idx", F.lit(i)) for i, df in enumerate(sources)])


@F.pandas_udf(StringType())
def canonical_xml(raw: pd.Series) -> pd.Series:
    """Canonical form of XML text; text that is not well-formed stays as it is."""

    def one(text: str | None) -> str | None:
        try:
            return ElementTree.canonicalize(text)
        except (ElementTree.ParseError, TypeError, ValueError):
            return text

    return raw.map(one)


def identifiers(fields: Column, names: tuple[str, ...] = IDENTIFIERS) -> Column:
    """(field, value) of the identifier fields in a map of direct children; names match without case, _ and -."""
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(name_key(e["key"]).alias("k"), F.lower(strip(e["value"])).alias("v")))

    def first(name: str) -> Column:
        wanted = name.replace("_", "").replace("-", "")
        return F.get(F.filter(entries, lambda e: e["k"] == wanted), F.lit(0))["v"]

    found = [F.struct(F.lit(n).alias("field"), first(n).alias("value")) for n in names]
    return F.filter(F.array(*found), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def _keyed(records: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(o, key): order and hashed identifiers of every record; a record without any has the hash of its content, empty if all is null."""
    listed = F.sha2(F.to_json(F.col("fields")), 256)
    content = F.coalesce(F.sha2(canonical_xml("raw"), 256), listed, F.lit("")) if "raw" in records.columns else F.coalesce(listed, F.lit(""))
    own = identifiers(F.col("fields"), names)
    keys = F.when(F.size(own) > 0, F.transform(own, lambda x: F.struct(x["field"].alias("field_name"), x["value"].alias("field_value")))).otherwise(F.array(F.struct(F.lit("xml_hash").alias("field_name"), content.alias("field_value"))))
    return records.select(F.struct("source_idx", "rec_idx").alias("o"), F.explode(keys).alias("k")).select("o", "k.*")


#: Rounds that decide most records, and undecided (record, identifier) rows that one task may then hold.
ROUNDS, FEW = 2, 200_000


def _in_order(table: pa.Table) -> pa.Table:
    """The records that are kept among some, taken one by one in order: (source_idx, rec_idx)."""
    table = table.sort_by([("source_idx", "ascending"), ("rec_idx", "ascending")])
    source, record, names, values = (table.column(c).to_pylist() for c in ("source_idx", "rec_idx", "field_name", "field_value"))
    taken: set[tuple[str, str]] = set()
    kept: list[int] = []
    at = 0
    while at < len(source):
        stop = at + 1
        while stop < len(source) and source[stop] == source[at] and record[stop] == record[at]:
            stop += 1
        own = set(zip(names[at:stop], values[at:stop], strict=True))
        if taken.isdisjoint(own):
            taken |= own
            kept.append(at)
        at = stop
    return table.select(["source_idx", "rec_idx"]).take(pa.array(kept, pa.int64()))


def _decided(rows: DataFrame, by: list) -> DataFrame:
    """o of the records that are kept, each group decided in one task; records that share an identifier are in one group."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["o"].dataType}
    flat = rows.select(*by, "o.*", "field_name", "field_value")
    kept = flat.groupBy(*[c for c in flat.columns if c not in (*kinds, "field_name", "field_value")]).applyInArrow(_in_order, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return kept.select(F.struct(*kinds).alias("o"))


def _joined_ends(table: pa.Table) -> pa.Table:
    """(node, root) for the nodes of links (u, v), by union and find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
        up[root(u)] = root(v)
    return pa.table({"node": pa.array(list(up), pa.int64()), "root": pa.array([root(x) for x in up], pa.int64())})


def _components(open_: DataFrame) -> DataFrame:
    """``open_`` with a number (comp) that records which identifiers join, step by step, have in common.

    Links go from each record to the first one of its identifier. While they are many, each end moves to the neighbour with the least
    random number, if that is less than its own, and twice on from there, and links are contracted: about half of the ends go each
    time, in chains too. A few are joined in one task. Ends are hashes; two that collide only make one group of two.
    """
    least = open_.groupBy("field_name", "field_value").agg(F.min("o").alias("first"))
    links = open_.join(least, ["field_name", "field_value"]).select(F.xxhash64("o").alias("u"), F.xxhash64("first").alias("v"))
    links = written(links.where("u <> v").distinct(), "dedup-links")
    moves: list[DataFrame] = []
    while links.count() > FEW:
        number = lambda c: F.xxhash64(F.lit(len(moves)), c)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min_by("v", number("v")).alias("v"))
        step = written(near.select(F.col("u").alias("node"), F.when(number("v") < number("u"), F.col("v")).otherwise(F.col("u")).alias("root")), "dedup-moves")
        for _ in range(2):
            on = step.toDF("root", "next")
            step = written(step.join(on, "root").select("node", F.col("next").alias("root")), "dedup-moves")
        moves.append(step)
        ends = links.join(step.toDF("u", "a"), "u").join(step.toDF("v", "b"), "v")
        links = written(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "dedup-links")
    moves.append(written(links.groupBy(F.lit(0).alias("all")).applyInArrow(_joined_ends, "node long, root long"), "dedup-moves"))
    out = open_.withColumn("comp", F.xxhash64("o"))
    for step in moves:
        out = out.join(step.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
    return written(out, "dedup-components")


def first_wins(records: DataFrame, names: tuple[str, ...] = IDENTIFIERS, known: DataFrame | None = None) -> DataFrame:
    """Records (source_idx, rec_idx, fields, maybe raw) that share no identifier with an earlier kept record.

    Rounds decide most: of the undecided records, those that come first for all of their identifiers are kept; others that share an
    identifier with a kept one are dropped and register nothing. After ROUNDS the rest, chains of records that block one another, is
    decided record by record: in one task if it has at most FEW rows, else in one for each group that identifiers join. Only groups of
    over FEW rows take further rounds. ``known`` (field_name, field_value) holds identifiers of earlier runs.
    """
    open_ = written(_keyed(records, names), "dedup-open")
    if known is not None:
        seen = open_.join(known, ["field_name", "field_value"], "left_semi").select("o").distinct()
        open_ = written(open_.join(seen, "o", "left_anti"), "dedup-open")
    kept = None
    if len(names) == 1:  # each record has one identifier, so one minimum decides
        kept = open_.groupBy("field_name", "field_value").agg(F.min("o").alias("o")).select("o")
        return records.join(kept.select("o.*"), ["source_idx", "rec_idx"], "left_semi")
    turn = 0
    while not open_.isEmpty():
        if turn == ROUNDS:
            if open_.count() <= FEW:
                return _with(records, kept, _decided(open_, [F.lit(0).alias("all")]))
            open_ = _components(open_)
            large = F.broadcast(open_.groupBy("comp").agg(F.count("*").alias("rows")).where(F.col("rows") > FEW).select("comp"))  # few: each has over FEW rows
            won = written(_decided(open_.join(large, "comp", "left_anti"), ["comp"]), "dedup-won")
            kept, open_ = won if kept is None else kept.union(won), written(open_.join(large, "comp", "left_semi").select("o", "field_name", "field_value"), "dedup-open")
            turn += 1
            continue
        least = open_.groupBy("field_name", "field_value").agg(F.min("o").alias("first"))
        now = written(open_.join(least, ["field_name", "field_value"]).withColumn("wins", F.col("o") == F.col("first")), "dedup-round")
        won = written(now.groupBy("o").agg(F.min("wins").alias("wins")).where("wins").select("o"), "dedup-won")
        kept = won if kept is None else kept.union(won)
        taken = now.join(won, "o", "left_semi").select("field_name", "field_value").distinct()
        gone = now.join(taken, ["field_name", "field_value"], "left_semi").select("o").distinct()
        open_ = written(now.join(gone, "o", "left_anti").select("o", "field_name", "field_value"), "dedup-open")
        turn += 1
    return records.limit(0) if kept is None else _with(records, kept)


def _with(records: DataFrame, *kept: DataFrame | None) -> DataFrame:
    won = reduce(DataFrame.union, [k for k in kept if k is not None])
    return records.join(won.select("o.*"), ["source_idx", "rec_idx"], "left_semi")


def registered(kept: DataFrame, names: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(field_name, field_value) that kept records register, for later runs."""
    return _keyed(kept, names).select("field_name", "field_value").distinct()


def merge_counters(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Parsed, written and duplicate records of each source."""
    parsed, out = records.groupBy("source_idx").agg(F.count("*").alias("parsed")), kept.groupBy("source_idx").agg(F.count("*").alias("written"))
    return parsed.join(out, "source_idx", "left").fillna(0, ["written"]).withColumn("duplicates", F.col("parsed") - F.col("written"))
