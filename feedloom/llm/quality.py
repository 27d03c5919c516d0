"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, runs of white space and of digits made one) and hashed; for each host the documents with
different texts that hold a line are counted, so a group of exact copies counts once. A line over the limit, a number of
documents that does not depend on the size of the host, is removed; a document that loses more than half of its words that
way is depleted and rejected. The base rules reject short texts and texts whose three-word windows mostly repeat.

Hot lines and hosts: counts are pre-aggregated before the shuffle. The frequent lines of a host are few beside its texts, and
go to the tasks as one hash table a host, so texts stay where they are; beyond ``LOOKUP_LINES`` lines in all, each text gets
its own frequent lines by a join that adaptive execution can split. Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows each come back; ties cannot arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import counted_broadcast, free_name, let, save

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is too frequent if more than this many documents of its host hold it.
LINE_DOCS = 20
#: Frequent lines of all hosts that are looked up in broadcast tables; more of them join by text.
LOOKUP_LINES = 1 << 18
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.5

_BLANK = r"[ \t-\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    Equal windows are neighbours in hash order; in text order, a window adds three words less those that the one before
    it has covered. Each step is bound once, so the optimizer cannot repeat it for each element.
    """

    def covered(placed: Column) -> Column:
        n = F.size(placed) - 1
        twins = F.zip_with(F.slice(placed, F.lit(1), n), F.slice(placed, F.lit(2), n), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])

    def counted(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, covered))

    def windowed(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, counted))

    return let(words, windowed)


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r")) != ""


def _hashed(text: Column) -> Column:
    """(hash, words) of each line: case, kinds of white space and digits do not count; blank lines are (null, 0).

    The whole text is made normal before it is split, and a normal line has one blank between two words.
    """
    normal = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\S\n]+", " "), "[0-9]+", "0")

    def one(line: Column) -> Column:
        words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        return F.when(line == "", F.struct(F.lit(None).cast("long").alias("hash"), F.lit(0).alias("words"))).otherwise(F.struct(F.xxhash64(line).alias("hash"), words.alias("words")))

    return F.transform(F.split(normal, "\n"), lambda x: let(F.trim(x), one))


def _measured(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(host).alias("host"), text.alias("text")).withColumn("words", _words(text)).withColumn("raw", F.filter(F.split(text, "\n"), _filled))
    return rows.select(
        "doc_id",
        "host",
        _text_key(F.col("text")).alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        _lines(F.col("text")).alias("lines"),
    )


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _lines(text: Column) -> Column:
    return F.filter(_hashed(text), lambda x: x["hash"].isNotNull())


def frequent_lines(measured: DataFrame) -> DataFrame:
    """(host, hash) of the lines over the limit."""
    lines = measured.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    return lines.distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS).select("host", "hash")


def _tables(often: DataFrame) -> DataFrame:
    """(host, table): the frequent lines of each host as a hash table, an array of as many short lists as the host has lines."""
    sized = often.groupBy("host").agg(F.count("*").cast("int").alias("slots"))
    same = F.col("a.host").eqNullSafe(F.col("b.host"))
    placed = often.alias("a").join(sized.alias("b"), same).select("a.host", "hash", F.pmod("hash", "slots").cast("int").alias("slot"))
    held = placed.groupBy("host", "slot").agg(F.collect_list("hash").alias("hashes"))
    every = sized.select("host", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    met = every.alias("a").join(held.alias("b"), same & (F.col("a.slot") == F.col("b.slot")), "left")
    listed = F.sort_array(F.collect_list(F.struct("a.slot", F.coalesce("hashes", F.array().cast("array<bigint>")).alias("hashes"))))
    return met.groupBy("a.host").agg(F.transform(listed, lambda x: x["hashes"]).alias("table"))


def _own(measured: DataFrame, often: DataFrame) -> DataFrame:
    """(host, text_key, table): the frequent lines of each text that has any, a table of one list."""
    lines = measured.select("host", "text_key", F.explode(F.transform("lines", lambda x: x["hash"])).alias("hash")).distinct()
    met = lines.alias("a").join(often.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.hash") == F.col("b.hash")))
    return met.groupBy("a.host", "text_key").agg(F.array(F.collect_list("a.hash")).alias("table"))


def _with_tables(rows: DataFrame, host: Column, text_key: Column, measured: DataFrame, table: str) -> DataFrame:
    """``rows`` with the column ``table`` that holds the frequent lines of the row's host or text; null where there are none."""
    often = save(frequent_lines(measured), "quality-lines")
    if often.count() <= LOOKUP_LINES:
        found = counted_broadcast(save(_tables(often), "quality-tables")).toDF("_host", table)
        return rows.join(found, host.eqNullSafe(F.col("_host")), "left").drop("_host")
    found = save(_own(measured, often), "quality-own").toDF("_host", "_key", table)
    return rows.join(found, host.eqNullSafe(F.col("_host")) & (text_key == F.col("_key")), "left").drop("_host", "_key")


def _lost(line: Column, table: Column) -> Column:
    """The words of a line (hash, words) if it is frequent, else 0."""
    near = F.get(table, F.pmod(line["hash"], F.size(table)).cast("int"))
    return F.when(F.array_contains(near, line["hash"]), line["words"]).otherwise(0)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures, n_removed_words, base_failed and kept of every row of ``docs`` (doc_id, text and ``host``)."""
    measured = save(_measured(docs, host), "quality-measures")
    out = _with_tables(measured, F.col("host"), F.col("text_key"), measured, "table")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    removed = F.when(F.col("table").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + _lost(x, F.col("table"))))
    out = out.withColumn("n_removed_words", removed)
    left = F.col("n_words") - F.col("n_removed_words") >= LEFT_SHARE * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"))


def filter_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they have; frequent lines leave their texts.

    Null and empty texts fail the base rules; a null host is a host of its own; repeated rows are judged alike and each come
    back; columns come back whatever their names, ``n_chars`` with the new length; an empty table stays empty.
    """
    measured = save(docs.select(F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text")).select("host", _text_key(F.col("text")).alias("text_key"), _lines(F.col("text")).alias("lines")), "quality-measures")
    row, words, n, table = (free_name(x, docs.columns) for x in ("row", "words", "n", "table"))
    whole = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias(row))
    held = whole.withColumn(words, _words(F.coalesce(f"{row}.text", F.lit("")))).withColumn(n, F.size(words))
    held = held.where((F.col(n) >= MIN_WORDS) & (100 * _repeated(F.col(words)) <= REPEAT_PERCENT * F.col(n))).drop(words)
    old, text = F.col(row), F.col(f"{row}.text")
    met = _with_tables(held, old[host], _text_key(text), measured, table)

    def without(rest: Column) -> Column:
        out = old.withField("text", rest)
        return out.withField("n_chars", F.length(rest).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

    def stays(lost: Column) -> Column:
        """No row or one, from the words that each line loses."""
        total = F.aggregate(lost, F.lit(0), lambda s, x: s + x)
        rest = F.array_join(F.zip_with(F.split(text, "\n"), lost, lambda line, x: F.when(x == 0, line)), "\n")
        return F.when(total == 0, F.array(old)).when(F.col(n) - total >= LEFT_SHARE * F.col(n), F.array(let(rest, without)))

    found = let(_hashed(text), lambda own: F.transform(own, lambda x: _lost(x, F.col(table))))
    return met.select(F.explode(F.when(F.col(table).isNull(), F.array(old)).otherwise(let(found, stays))).alias(row)).select(f"{row}.*")
