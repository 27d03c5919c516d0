"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the number of copies that each of its documents should have: a whole part, and a
fraction that is rounded for all documents of the source together. Each document starts with its fraction of its words. From the
largest down, a document pairs up with the smaller ones of its block taken as one, and words move at random from one to the other,
with the expectation of both unchanged, until one side has all or none of its words: mostly the document, as the others take or give
together, each in proportion to what it lacks or has. So a document larger than its partners is settled first, and what stays open
is the smallest. Blocks of about ``BLOCK`` documents, dealt by hash, are folded in parallel, each leaving one open document; those
are folded in turn, in a reduction tree. The words of a source never change on the way; only the last open document is rounded,
to the nearer side, so a source ends within half of one small document of its target, however many blocks it has. Where the
others cannot take or give what a large document needs, it stays open itself; so each block keeps its smallest documents back for
the next level, so many that the last block of a source, at whatever level it has only one, has half a block of them, and the
last block is folded with ``TRIES`` seeds, of which the one counts that ends nearest to the target.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own, ordered last; repeated
rows are numbered and drawn one by one; with no words at all every target is 0. All random numbers are hashes of the
document keys and ``SEED``: reruns agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import counted_broadcast, let, save

WEIGHTS = (1, 2, 3)
#: No source is taken more often than this, and so no document.
MOST = 3
BLOCK = 256
SEED = 7
TRIES = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, target from rows of source and size: one row a source.

    Sources are numbered over a range sort, by their place in a part and the rows of the parts before, so their number is
    not bounded by a task. Sharing by weight with a ceiling: the level starts where no source is over it, and rises by what
    those over it leave until it stays; each step is one sum over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ordered = save(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    ordered = ordered.withColumn("part", F.shiftrightunsigned("at", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows"))  # as many as the sort has partitions
    before = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)) % len(WEIGHTS)
    rows = ordered.join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")))
    rows = save(rows.select("source", "source_size", "n", "weight", (MOST * F.col("source_size")).alias("ceiling")), "mix-weights")
    whole, level, last = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1.0
    while level != last:
        over = F.col("ceiling") < F.lit(level) * F.col("weight")
        filled, weights = rows.agg(F.coalesce(F.sum(F.when(over, F.col("ceiling"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        last, level = level, max(level, (whole - filled) / weights) if weights else level
    return rows.select("source", "source_size", "n", F.least(F.col("ceiling").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _settled(x: Column, y: Column) -> Column:
    return F.struct(x["z"].alias("z"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), y.alias("y"))


def _fold(items: Column, kind: str, seed: Column) -> Column:
    """done (all or nothing) and open (one or none) of a block whose documents come from the largest down.

    The words of those to come are a * y + b * z of what they began with (y) and their sizes (z): moves to or from all of them change
    a and b alone.
    """
    none, empty, zero = F.lit(None).cast(kind), F.array().cast(f"array<{kind}>"), F.lit(0.0)
    total = lambda name: F.aggregate(items, zero, lambda t, x: t + x[name])

    def step(s: Column, x: Column) -> Column:
        rest_z, rest_y = s["z"] - x["z"], s["y"] - x["y"]

        def moved(v: Column) -> Column:
            """``v``: words of the document, of the rest, and what may move up to the document and down from it."""
            draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), seed, x["h"]), 11) * F.lit(2.0**-53)
            rise = draw * (v["up"] + v["down"]) < v["down"]
            own = F.when(rise, F.when(v["up"] >= x["z"] - v["own"], x["z"]).otherwise(v["own"] + v["up"])).otherwise(F.when(v["down"] >= v["own"], zero).otherwise(v["own"] - v["down"]))
            left = F.when(rise, F.when(v["rest"] > v["up"], 1 - v["up"] / v["rest"]).otherwise(zero)).otherwise(F.when(rest_z - v["rest"] > v["down"], 1 - v["down"] / (rest_z - v["rest"])).otherwise(zero))

            def kept(k: Column) -> Column:
                whole = (k["own"] <= 0) | (k["own"] >= x["z"])
                return F.struct(
                    (s["a"] * k["left"]).alias("a"), (s["b"] * k["left"] + F.when(rise, zero).otherwise(1 - k["left"])).alias("b"), rest_y.alias("y"), rest_z.alias("z"),
                    F.when(whole, s["open"]).otherwise(_settled(x, k["own"])).alias("open"), F.when(whole, F.concat(s["done"], F.array(_settled(x, k["own"])))).otherwise(s["done"]).alias("done"),
                )

            return let(F.struct(own.alias("own"), left.alias("left")), kept)

        def met(v: Column) -> Column:
            whole = (v["own"] <= 0) | (v["own"] >= x["z"])
            same = [s["a"].alias("a"), s["b"].alias("b"), rest_y.alias("y"), rest_z.alias("z")]
            done = F.struct(*same, s["open"].alias("open"), F.concat(s["done"], F.array(_settled(x, v["own"]))).alias("done"))
            last = F.struct(*same, _settled(x, v["own"]).alias("open"), s["done"].alias("done"))
            room = F.struct(v["own"].alias("own"), v["rest"].alias("rest"), F.least(x["z"] - v["own"], v["rest"]).alias("up"), F.least(v["own"], rest_z - v["rest"]).alias("down"))
            return F.when(whole, done).when(rest_z <= 0, last).otherwise(let(room, moved))

        within = lambda value, most: F.greatest(zero, F.least(value, most))
        own, rest = within(s["a"] * x["y"] + s["b"] * x["z"], x["z"]), within(s["a"] * rest_y + s["b"] * rest_z, rest_z)
        return let(F.struct(own.alias("own"), rest.alias("rest")), met)

    begin = F.struct(F.lit(1.0).alias("a"), zero.alias("b"), total("y").alias("y"), total("z").alias("z"), none.alias("open"), empty.alias("done"))
    return F.aggregate(items, begin, step)


def _nearest(items: Column, kind: str, level: int) -> Column:
    """The fold, of ``TRIES`` seeds, whose open document is nearest to all or nothing."""

    def tried(k: Column) -> Column:
        def rated(f: Column) -> Column:
            miss = F.coalesce(F.least(f["open"]["y"], f["open"]["z"] - f["open"]["y"]), F.lit(0.0))
            return F.struct(miss.alias("miss"), k.alias("k"), f["open"].alias("open"), f["done"].alias("done"))

        return let(_fold(items, kind, k), rated)

    return F.array_min(F.transform(F.sequence(F.lit(TRIES * level), F.lit(TRIES * level + TRIES - 1)), tried))


def _rounded(rows: DataFrame, id_kind: str) -> DataFrame:
    """source, doc_id, copy, size, extra (0 or 1) for rows of source, doc_id, copy, size, share (over 0, under 1) and n."""
    kind = f"struct<z:double,h:bigint,doc_id:{id_kind},copy:int,y:double>"
    blocks = F.ceil(F.col("n") / BLOCK)
    key = F.xxhash64(F.lit(SEED), "doc_id", "copy", "source", "size")
    live = rows.select("source", "n", F.struct(F.col("size").cast("double").alias("z"), key.alias("h"), "doc_id", "copy", (F.col("share") * F.col("size")).alias("y")).alias("x"), F.pmod(key, blocks).alias("block"))
    out, turn = None, 0
    while True:
        last = F.col("n") <= BLOCK  # the source has one block left, whatever the others have
        many = F.ceil(F.col("n") / BLOCK)
        back = F.ceil(F.lit(BLOCK // 2) / many).cast("int")  # documents that each block keeps back, one at least
        order = F.sort_array(F.collect_list(F.struct((-F.col("x.z")).alias("o"), F.col("x.h").alias("h"), F.col("x.copy").alias("c"), "x")))
        items = live.groupBy("source", "n", "block").agg(F.transform(order, lambda t: t["x"]).alias("items"))
        first = F.greatest(F.size("items") - back, F.lit(0))
        once = _fold(F.slice("items", F.lit(1), first), kind, F.lit(TRIES * turn))
        kept = F.when(last, F.array().cast(f"array<{kind}>")).otherwise(F.slice("items", first + 1, back))
        folded = items.select("source", "n", "block", kept.alias("kept"), F.when(last, _nearest(F.col("items"), kind, turn)["open"]).otherwise(once["open"]).alias("open"), F.when(last, _nearest(F.col("items"), kind, turn)["done"]).otherwise(once["done"]).alias("done"))
        whole = F.transform(F.col("done"), lambda x: F.struct(x.alias("x"), F.lit(True).alias("done")))
        still = F.when(F.col("open").isNull(), F.array().cast(f"array<struct<x:{kind},done:boolean>>")).otherwise(F.array(F.struct(F.col("open").alias("x"), last.alias("done"))))
        small = F.transform("kept", lambda x: F.struct(x.alias("x"), F.lit(False).alias("done")))
        level = save(folded.select("source", "n", "block", F.explode(F.concat(whole, still, small)).alias("e")).select("source", "n", "block", "e.x", "e.done"), "mix-level")
        done = level.where("done").select("source", "x.doc_id", "x.copy", F.col("x.z").cast("long").alias("size"), (2 * F.col("x.y") >= F.col("x.z")).cast("int").alias("extra"))
        out = done if out is None else out.union(done)
        live = level.where("not done")
        if live.isEmpty():
            return out
        live, turn = live.select("source", (many * (1 + back)).alias("n"), "x", F.pmod("block", F.ceil(many * (1 + back) / BLOCK)).alias("block")), turn + 1


def choices(sized: DataFrame) -> DataFrame:
    """doc_id, copy (0, 1 ... for repeated rows), source, size, source_size, target, copies of rows of doc_id, source, size."""
    id_kind = sized.schema["doc_id"].dataType.simpleString()
    grouped = save(sized.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("times")), "mix-sizes")
    rows = grouped.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    targets = save(source_targets(rows), "mix-targets")
    held = rows.alias("a").join(counted_broadcast(targets).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "source_size", "target", "n", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"))
    held = held.withColumn("whole", F.floor("each").cast("int")).withColumn("share", F.col("each") - F.col("whole"))
    open_rows = (F.col("share") > 0) & (F.col("size") > 0)
    extra = _rounded(held.where(open_rows), id_kind)
    settled = held.where(~open_rows).select("doc_id", "copy", "source", "size", F.lit(0).alias("extra"))
    drawn = extra.select("doc_id", "copy", "source", "size", "extra").union(settled)
    named = drawn.alias("a").join(counted_broadcast(targets).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return named.select("doc_id", "copy", "a.source", "size", "source_size", "target", (whole + F.col("extra")).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) for every row of ``docs`` (doc_id, text, source)."""
    found = choices(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (never, once, or more); columns come back whatever their names.

    Null and empty texts have no words and are never taken; a null source is a source of its own; repeated rows are drawn
    one by one; an empty table stays empty.
    """
    found = save(choices(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))).select("doc_id", "copy", "source", "size", "copies"), "mix-choices")
    grouped = save(found.groupBy("doc_id", "source", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "copies"))), lambda x: x["copies"]).alias("each")), "mix-copies")
    held = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")).withColumn("size", n_words(F.col("row.text")))
    named = counted_broadcast(grouped).alias("b")
    joined = held.alias("a").join(named, F.col("a.row.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.row.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    joined = joined.select("row", "a.size", "each")
    single = joined.where(F.size("each") == 1).select("row", F.element_at("each", 1).alias("copies"))
    if not grouped.where(F.size("each") > 1).isEmpty():
        again = Window.partitionBy("row.doc_id", "row.source", "size").orderBy(F.xxhash64("row.text"))
        several = joined.where(F.size("each") > 1).withColumn("at", F.row_number().over(again)).select("row", F.element_at("each", F.col("at")).alias("copies"))
        single = single.union(several)
    return single.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
