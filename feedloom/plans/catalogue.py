"""Queries over the driver's tables, one for each operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import transforms as T
from feedloom.functions.compat import strip
from feedloom.operators import convert, dedup, predicates, stats, template, validate
from feedloom.operators.convert import difference
from feedloom.operators.predicates import select
from feedloom.plans.tables import in_order, shared_dir
from feedloom.sources import feeds, sheets, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders with a text that is null, empty, padded, a number with more behind it, no number, or a number. Both engines read it.
ODD = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' ', CAST(o_orderkey % 5000 AS STRING), 'kg ') WHEN 3 THEN o_orderstatus WHEN 4 THEN '-5.5e1x'
  ELSE CAST(o_orderkey % 9000 AS STRING) END AS v, o_orderdate, o_custkey FROM orders"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ODD.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))


def _odd_filter(name: str, operator: str, value: str, where: str) -> None:
    @_query(name, f"SELECT o_orderkey, v FROM ({ODD}) WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(_odd(spark, sf_dir), ["v"], [{"field": "v", "operator": operator, "value": value}]).select("o_orderkey", "v")


def _filter(name: str, table: str, key: str, field: str, operator: str, value: str, where: str) -> None:
    @_query(name, f"SELECT {key}, {field} FROM {table} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return select(df, df.columns, [{"field": field, "operator": operator, "value": value}]).select(key, field)


_NUM = "CASE WHEN {0} IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif(regexp_extract({0}, '^\\s*([+-]?(\\d+\\.?\\d*([eE][+-]?\\d+)?|\\.\\d+([eE][+-]?\\d+)?))', 1), '') AS DOUBLE), 0) END"
_filter("filter_equals", "orders", "o_orderkey", "o_orderstatus", "Equals", "F", "o_orderstatus = 'F'")
_filter("filter_not_equals", "orders", "o_orderkey", "o_orderstatus", "Not Equals", "F", "o_orderstatus <> 'F' OR o_orderstatus IS NULL")
_filter("filter_contains", "documents", "doc_id", "text", "Contains", "an", "text ILIKE '%an%'")
_filter("filter_starts_with", "part", "p_partkey", "p_name", "Starts With", "S", "p_name ILIKE 's%'")
_filter("filter_ends_with", "part", "p_partkey", "p_name", "Ends With", "E", "p_name ILIKE '%e'")
_filter("filter_greater_than", "events", "event_id", "event_type", "Greater Than", "login", "event_type > 'login'")
_odd_filter("filter_greater_than_number", "Greater Than", "1000", _NUM.format("v") + " > 1000")
_odd_filter("filter_less_than", "Less Than", "5", _NUM.format("v") + " < 5")
_odd_filter("filter_exists", "Exists", "", "v IS NOT NULL AND v <> ''")
_odd_filter("filter_missing", "Missing", "", "v IS NULL OR v = ''")
_odd_filter("filter_not_equals_null", "Not Equals", "F", "v <> 'F' OR v IS NULL")
_odd_filter("filter_not_in_list_null", "Not In List", "F, O", "v NOT IN ('F', 'O') OR v IS NULL")
_odd_filter("filter_regex_null", "Regex", "KG", "coalesce(regexp_matches(v, 'KG', 'i'), false)")
_filter("filter_in_list", "orders", "o_orderkey", "o_orderpriority", "In List", "1-URGENT, 2-HIGH", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("filter_not_in_list", "orders", "o_orderkey", "o_orderpriority", "Not In List", "1-URGENT,2-HIGH", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_filter("filter_regex", "documents", "doc_id", "text", "Regex", "^The [a-z]+ ", "regexp_matches(text, '^The [a-z]+ ', 'i')")
_filter("filter_unknown_field", "orders", "o_orderkey", "o_orderstatus", "Unknown", "x", "true")


@_query("filter_no_such_field", "SELECT 0::BIGINT AS n")
def filter_no_such_field(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return select(orders, orders.columns, [{"field": "none", "operator": "Equals", "value": "x"}, {"field": "o_orderstatus", "operator": "Exists"}]).agg(F.count("*").alias("n"))


@_query("search_one_field", "SELECT p_partkey FROM part WHERE p_type = 'x' OR regexp_matches(p_name, '^s.*e$', 'i')")
def search_one_field(spark, sf_dir):
    return select(_table(spark, sf_dir, "part"), ["p_name", "p_type"], term="^s.*e$", match="Regex", field="p_name").select("p_partkey")


@_query("record_preview", f"SELECT o_orderkey AS _row_id, v AS _raw_content, v FROM ({ODD}) WHERE v IS NOT NULL AND v <> '' ORDER BY o_orderkey LIMIT 1000")
def record_preview(spark, sf_dir):
    rows = _odd(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("v").alias("raw_content"), "v")
    return predicates.preview(rows, ["v"], filters=[{"field": "v", "operator": "Exists"}])[0]


@_query("match_count", f"SELECT count(*) AS n FROM ({ODD}) WHERE v IS NULL OR v = ''")
def match_count(spark, sf_dir):
    return select(_odd(spark, sf_dir), ["v"], [{"field": "v", "operator": "Missing"}]).agg(F.count("*").alias("n"))


@_query("export_headers", f'SELECT o_orderkey AS "Record ID", v AS "Raw XML/JSON Content", v FROM ({ODD})')
def export_headers(spark, sf_dir):
    return sinks.labelled(_odd(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("v").alias("raw_content"), "v"))


@_query("search_all", "SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' OR p_brand ILIKE '%an%' OR p_type ILIKE '%an%'")
def search_all(spark, sf_dir):
    return select(_table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], term="an").select("p_partkey")


@_query("filter_and_search", "SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1' AND p_name ILIKE 's%'")
def filter_and_search(spark, sf_dir):
    return select(_table(spark, sf_dir, "part"), ["p_name", "p_brand"], [{"field": "p_brand", "operator": "Not Equals", "value": "Brand#1"}], "s", "Starts With", "p_name").select("p_partkey")


def _stats_sql(table: str, fields: list[str]) -> str:
    one = """SELECT {i} AS field_idx, '{f}' AS path, count(*) AS total, count(*) FILTER ({f} <> '') AS present, count(*) - count(*) FILTER ({f} <> '') AS missing,
      count(DISTINCT nullif({f}, '')) AS unique_count, greatest(count(*) FILTER ({f} <> '') - count(DISTINCT nullif({f}, '')), 0) AS duplicate_count,
      coalesce(min(length({f})), 0) AS min_length, coalesce(max(length({f})), 0) AS max_length, coalesce(round(avg(length({f})), 2), 0) AS avg_length,
      coalesce(round(100.0 * count(*) FILTER ({f} <> '') / count(*), 2), 0) AS completion_rate FROM {t}"""
    return " UNION ALL ".join(one.format(i=i, f=f, t=table) for i, f in enumerate(fields))


@_query("field_stats", _stats_sql("documents", ["text"]))
def field_stats(spark, sf_dir):
    return stats.field_stats(_table(spark, sf_dir, "documents"), "text")


@_query("all_field_stats", _stats_sql("part", ["p_name", "p_brand", "p_type"]))
def all_field_stats(spark, sf_dir):
    return stats.all_field_stats(_table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@_query("odd_field_stats", _stats_sql(f"({ODD})", ["v"]))
def odd_field_stats(spark, sf_dir):
    return stats.field_stats(_odd(spark, sf_dir), "v")


@_query("odd_field_values", f"SELECT CASE WHEN v = '' THEN '[Empty]' ELSE v END AS value, count(*) AS n FROM ({ODD}) WHERE v IS NOT NULL GROUP BY 1")
def odd_field_values(spark, sf_dir):
    return stats.field_values(_odd(spark, sf_dir), "v")


@_query("id_summary", "SELECT count(*) AS total_jobs, 3 AS total_fields, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > 1)) AS duplicates FROM orders")
def id_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("company/id"), F.col("o_orderstatus").alias("GUID"), F.col("o_orderpriority").alias("url"))
    return stats.summary(rows, rows.columns)


@_query("chart_empty_key", f"WITH g AS (SELECT CASE WHEN v IN ('', 'F', 'O', 'P') THEN v ELSE '-' END AS k, count(*) AS n FROM ({ODD}) WHERE v IS NOT NULL GROUP BY 1) SELECT k AS label, n FROM g")
def chart_empty_key(spark, sf_dir):
    rows = _odd(spark, sf_dir).where("v is not null").select(F.when(F.col("v").isin("", "F", "O", "P"), F.col("v")).otherwise("-").alias("k"))
    return stats.chart(stats.group_by(rows, ["k"], ["k"]), ["k"])


@_query("completeness", "SELECT path, completion_rate, present, missing, CASE WHEN completion_rate < 50 THEN 'danger' WHEN completion_rate < 85 THEN 'warning' ELSE 'success' END AS band FROM (" + _stats_sql("(SELECT nullif(o_orderstatus, 'F') AS o_orderstatus, o_orderpriority FROM orders)", ["o_orderstatus", "o_orderpriority"]) + ")")
def completeness(spark, sf_dir):
    return stats.completeness(_table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")), ["o_orderstatus", "o_orderpriority"])


@_query("top_values", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_values(spark, sf_dir):
    return stats.frequent_values(_table(spark, sf_dir, "part"), "p_brand")


@_query("bottom_values", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type <> '' GROUP BY 1 ORDER BY n, value LIMIT 10")
def bottom_values(spark, sf_dir):
    return stats.frequent_values(_table(spark, sf_dir, "part"), "p_type", rarest=True)


@_query("multi_group_by", "SELECT coalesce(nullif(o_orderstatus, 'F'), '[Missing]') AS o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def multi_group_by(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')"))
    return stats.group_by(df, ["o_orderstatus", "o_orderpriority", "unknown"], df.columns)


@_query("rollup_ext", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_ext(spark, sf_dir):
    return stats.rollup(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@_query("field_values", "SELECT CASE WHEN p_type = '' THEN '[Empty]' ELSE p_type END AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1")
def field_values(spark, sf_dir):
    return stats.field_values(_table(spark, sf_dir, "part"), "p_type")


@_query("field_value_export", "SELECT nullif(o_orderstatus, 'F') AS value, count(*) AS n FROM orders GROUP BY 1")
def field_value_export(spark, sf_dir):
    return stats.field_value_export(_table(spark, sf_dir, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'F')")), "s")


@_query("duplicate_values", "SELECT text AS value, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 1000")
def duplicate_values(spark, sf_dir):
    return stats.duplicate_values(_table(spark, sf_dir, "documents"), "text")


@_query("duplicate_total", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def duplicate_total(spark, sf_dir):
    return stats.duplicate_total(_table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("string")), "o_custkey")


@_query("global_summary", "SELECT count(*) AS total_jobs, 2 AS total_fields, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM pages GROUP BY url HAVING count(*) > 1)) AS duplicates FROM pages")
def global_summary(spark, sf_dir):
    return stats.summary(_table(spark, sf_dir, "pages").select("url", "html"), ["url", "html"])


@_query("duplicate_summary", " UNION ALL ".join(f"SELECT '{f}' AS path, count(*) AS groups, sum(n)::BIGINT AS total_rows FROM (SELECT count(*) AS n FROM part WHERE {f} <> '' GROUP BY {f} HAVING count(*) > 1) HAVING count(*) > 0" for f in ("p_name", "p_brand", "p_type")))
def duplicate_summary(spark, sf_dir):
    return stats.duplicate_summary(_table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


_CHART = "WITH g AS ({0}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, {1}) AS rn FROM g) SELECT {2} AS label, n FROM r WHERE rn <= 15 UNION ALL SELECT 'Other', sum(n)::BIGINT FROM r WHERE rn > 15 HAVING sum(n) > 0"


@_query("chart_other", _CHART.format("SELECT p_brand, count(*) AS n FROM part GROUP BY 1", "p_brand", "p_brand"))
def chart_other(spark, sf_dir):
    return stats.chart(stats.group_by(_table(spark, sf_dir, "part"), ["p_brand"], ["p_brand"]), ["p_brand"])


@_query("flagship", _CHART.format("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND c_acctbal > 0 GROUP BY 1, 2", "c_mktsegment, o_orderpriority", "c_mktsegment || ' > ' || o_orderpriority"))
def flagship(spark, sf_dir):
    """Filter, two-level group and chart buckets over the orders of customers."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kept = select(orders.withColumn("c_acctbal", F.col("c_acctbal").cast("string")), orders.columns, [{"field": "o_orderstatus", "operator": "In List", "value": "F,O"}, {"field": "c_acctbal", "operator": "Greater Than", "value": "0"}])
    by = ["c_mktsegment", "o_orderpriority"]
    return stats.chart(stats.group_by(kept, by, by), by)


def _transform(name: str, table: str, key: str, field: str, steps: list[dict], sql: str) -> None:
    @_query(name, f"SELECT {key}, {sql} AS value FROM {table}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table)
        return df.select(key, T.apply(F.col(field), steps, df.columns).alias("value"))


def _step(name: str, *args: str) -> list[dict]:
    return [{"function": name, "args": list(args)}]


_transform("transform_concat", "part", "p_partkey", "p_name", _step("concat", "-", "$p_brand", "x", "$p_type", "$none"), "concat_ws('-', p_brand, 'x', p_type, '')")
_transform("transform_substring", "part", "p_partkey", "p_name", _step("substring", "1", "5"), "p_name[2:5]")
_transform("transform_substring_end", "part", "p_partkey", "p_name", _step("substring", "-3", "-1"), "p_name[length(p_name) - 2:length(p_name) - 1]")
_transform("transform_tokenize", "part", "p_partkey", "p_name", _step("tokenize", " ", "1"), "split_part(p_name, ' ', 2)")
_transform("transform_replace", "part", "p_partkey", "p_name", _step("replace", "a", "[A]"), "replace(p_name, 'a', '[A]')")
_transform("transform_upper_lower", "part", "p_partkey", "p_type", [*_step("upper"), *_step("replace", "E", "e")], "replace(upper(p_type), 'E', 'e')")
_transform("transform_lower", "part", "p_partkey", "p_type", _step("lower"), "lower(p_type)")


def _odd_transform(name: str, steps: list[dict], sql: str, made: str = "v") -> None:
    @_query(name, f"SELECT o_orderkey, {sql} AS value FROM (SELECT o_orderkey, coalesce({made}, '') AS v FROM ({ODD}))")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _odd(spark, sf_dir).select("o_orderkey", F.expr(made).alias("v"))
        return df.select("o_orderkey", T.apply(F.col("v"), steps, df.columns).alias("value"))


_odd_transform("transform_replace_empty", _step("replace", "", "-"), "CASE WHEN v = '' THEN '' ELSE concat('-', regexp_replace(v, '(.)', '\\1-', 'g')) END")
_odd_transform("transform_regex_replace_empty", _step("regex_replace", "^", "x"), "CASE WHEN v = '' THEN '' ELSE concat('x', v) END")
_odd_transform("transform_default_blank", _step("default", "none"), "CASE WHEN trim(v) = '' THEN 'none' ELSE v END")
_odd_transform(
    "transform_date_format_odd", _step("date_format", "%m/%d/%Y", "%Y-%m-%d"), "CASE WHEN v LIKE '%/%' THEN strftime(strptime(trim(v), '%m/%d/%Y'), '%Y-%m-%d') ELSE v END",
    "CASE o_orderkey % 4 WHEN 0 THEN v WHEN 1 THEN concat(' ', CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING), ' ') WHEN 2 THEN concat('0', CAST(o_orderkey % 9 + 1 AS STRING), '/1/2024') ELSE '' END",
)
_transform("transform_strip", "part", "p_partkey", "p_name", [*_step("concat", "", "  ", "$p_name", "\t "), *_step("strip")], "trim(p_name)")
_transform("transform_title_case", "part", "p_partkey", "p_name", _step("title_case"), "array_to_string(list_transform(string_split(p_name, ' '), lambda s: upper(s[1]) || lower(s[2:])), ' ')")
_transform("transform_default", "orders", "o_orderkey", "o_orderstatus", [*_step("replace", "F", " "), *_step("default", "none")], "CASE WHEN trim(replace(o_orderstatus, 'F', ' ')) = '' THEN 'none' ELSE o_orderstatus END")
_transform("transform_regex_replace", "part", "p_partkey", "p_name", _step("regex_replace", r"(\w+) (\w+)", r"\2_\1"), r"regexp_replace(p_name, '(\w+) (\w+)', '\2_\1', 'g')")
_transform("transform_url_encode", "part", "p_partkey", "p_brand", _step("url_encode"), "url_encode(p_brand)")
_transform("transform_url_decode", "part", "p_partkey", "p_brand", [*_step("url_encode"), *_step("url_decode")], "p_brand")
_transform("transform_contains", "part", "p_partkey", "p_name", _step("contains", "an", "yes", "no"), "CASE WHEN contains(p_name, 'an') THEN 'yes' ELSE 'no' END")


@_query("transform_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS value FROM orders")
def transform_date_format(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.date_format(text, "%Y-%m-%d", "%d/%m/%Y").alias("value"))


#: A number of bytes, odd so that no decimal is a tie.
_BYTES = "(o_orderkey * o_orderkey * 7919 + 1 - (o_orderkey * o_orderkey * 7919) % 2)"


def _sized_sql(places: int, first: str, units: list[str]) -> str:
    steps = " ".join(f"WHEN b < {1024 ** (i + 1)} THEN printf('%.{places}f {u}', b / {1024 ** i}.0)" for i, u in enumerate(units[:-1]) if i)
    return f"CASE WHEN b < 1024 THEN {first} {steps} ELSE printf('%.{places}f {units[-1]}', b / {1024 ** (len(units) - 1)}.0) END"


_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


@_query(
    "size_helpers",
    f"""SELECT o_orderkey, {_sized_sql(2, "printf('%.2f B', b / 1.0)", _UNITS)} AS format_size, {_sized_sql(1, "printf('%.1f B', b / 1.0)", _UNITS[:5])} AS human_size,
      CASE WHEN o_orderkey % 9 = 0 THEN '0 B' ELSE {_sized_sql(2, "concat(b, ' B')", _UNITS[:5])} END AS file_size, printf('%.2f MB/s', b / 1048576.0) AS speed,
      CASE WHEN s >= 3600 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm ', s % 60, 's') WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') WHEN s >= 1 THEN concat(s, 's') ELSE '0.0s' END AS duration
      FROM (SELECT o_orderkey, {_BYTES} AS b, o_orderkey % 9001 AS s FROM orders)""",
)
def size_helpers(spark, sf_dir):
    b, s = F.expr(_BYTES), F.col("o_orderkey") % 9001
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", T.format_size(b).alias("format_size"), T.human_size(b).alias("human_size"), T.file_size(F.when(F.col("o_orderkey") % 9 == 0, -b).otherwise(b)).alias("file_size"),
        T.speed(b).alias("speed"), T.duration(s).alias("duration"),
    )


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"


@_query("xml_escape", f"SELECT page_id, {_ESCAPED.format('html')} AS value FROM pages")
def xml_escape(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.xml_escape(F.col("html")).alias("value"))


@_query("name_helpers", "SELECT p_partkey, regexp_replace(p_brand, '[^\\p{L}\\p{N}_-]', '', 'g') AS tag, lower(replace(replace(concat('Job_', p_type), '_', ''), '-', '')) AS name, concat('a', p_size, ',b') AS places, concat(substr(sha256(concat('url:', p_name)), 1, 16), '.xml') AS staged FROM part")
def name_helpers(spark, sf_dir):
    text = F.concat(F.lit("{{a"), F.col("p_size").cast("string"), F.lit("}} {{ b }} {{ a"), F.col("p_size").cast("string"), F.lit(" }} {{no-place}}"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", T.header_tag(F.col("p_brand")).alias("tag"), T.name_key(F.concat(F.lit("Job_"), "p_type")).alias("name"), F.array_join(T.placeholders(text), ",").alias("places"),
        feeds.staged_name(F.lit("url"), F.col("p_name"), ".xml").alias("staged"),
    )


@_query("flatten_records", 'SELECT event_id::VARCHAR AS "event/id", event_type AS "event/kind/name", concat(\'["\', event_type, \'","\', user_id, \'"]\') AS tags, user_id::VARCHAR AS "user" FROM events')
def flatten_records(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    event = F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("name")).alias("kind")).alias("event")
    user = F.col("user_id").cast("string")
    return feeds.flatten(events.select(event, F.array("event_type", user).alias("tags"), F.array(user).alias("user")), xml=True)


@_query("format_sniff", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'csv' WHEN page_id % 3 = 1 THEN 'json' ELSE 'xml' END AS converter, CASE WHEN page_id % 3 = 1 THEN 'json' ELSE 'xml' END AS validator, CASE WHEN page_id % 3 = 1 THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding FROM pages")
def format_sniff(spark, sf_dir):
    third = F.col("page_id") % 3
    path = F.when(third == 0, F.concat("url", F.lit("/A.TXT"))).otherwise(F.lit("feed"))
    content = F.when(third == 1, F.concat(F.lit("\ufeff \n["), "html")).otherwise(F.col("html")).cast("binary")
    return _table(spark, sf_dir, "pages").select("page_id", convert.sniff_format(path, content).alias("converter"), feeds.sniff(path, content).alias("validator"), feeds.encoding(content).alias("encoding"))


@_query("xml_to_json", """SELECT p_partkey, concat('{"p": {"n": "', p_name, '", "b": ["', p_brand, '", null], "@size": "', p_size, '"}}') AS value FROM part""")
def xml_to_json(spark, sf_dir):
    text = F.concat(F.lit("<p size='"), F.col("p_size").cast("string"), F.lit("'><n> "), "p_name", F.lit("</n><b>"), "p_brand", F.lit("</b><b/></p>"))
    return _table(spark, sf_dir, "part").select("p_partkey", convert.xml_to_json(text).alias("value"))


@_query("json_to_xml", "SELECT p_partkey, concat('<p size=\"', p_size, '\"><n>', p_name, '</n><b>', p_brand, '</b><b /></p>') AS value FROM part")
def json_to_xml(spark, sf_dir):
    p = F.struct(F.col("p_size").cast("string").alias("@size"), F.col("p_name").alias("n"), F.array(F.col("p_brand"), F.lit(None)).alias("b"))
    return _table(spark, sf_dir, "part").select("p_partkey", convert.json_to_xml(F.to_json(F.struct(p.alias("p")))).alias("value"))


@_query("template_render", f"SELECT p_partkey, concat('<p><n>', {_ESCAPED.format('upper(p_name)')}, '</n><b><![CDATA[', p_brand, ']]></b><u></u><s>me</s><salary><min>', p_size, '</min><max></max><type>a&amp;b</type><currency></currency></salary></p>') AS value FROM part")
def template_render(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    record = "<p><n>{{ name }}</n><b><![CDATA[{{brand}}]]></b><off>{{name}}</off><u>{{none}}</u><s>{{who}}</s></p>"
    salary = {"enabled": True, "fields": {"min": {"source_type": "column", "value": "p_size"}, "type": {"source_type": "static", "value": "a&b"}}}
    made = template.render(part, record, {"name": "p_name", "brand": "p_brand"}, {"who": "me"}, {"name": _step("upper")}, ["off"], salary=salary)
    return part.select("p_partkey", made.alias("value"))


@_query("shown_values", "SELECT doc_id, CASE WHEN length(text) > 45 THEN concat(substr(text, 1, 45), '...') ELSE text END AS value FROM documents")
def shown_values(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", convert.shown(F.col("text")).alias("value"))


#: What is done to a JSON text by the number of the row, with the category of the fault that this makes.
_DAMAGE = "CASE event_id % 6 WHEN 1 THEN 'Tag Mismatch' WHEN 2 THEN 'Invalid Attribute' WHEN 3 THEN 'Unexpected EOF' WHEN 4 THEN 'Invalid Attribute' WHEN 5 THEN 'Tag Mismatch' END"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("""CASE event_id % 6 WHEN 1 THEN substr(props, 1, length(props) - 1) WHEN 2 THEN replace(props, '}', ', }') WHEN 3 THEN '' WHEN 4 THEN concat('[', props, ', {"k": 1, "k": 2}]')
      WHEN 5 THEN concat('<e>\n<k>', event_type, '</x>\n</e>') ELSE props END""")
    kind = F.when((F.col("event_id") % 6).isin(3, 5), "xml").otherwise("json")
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), kind.alias("kind"), text.cast("binary").alias("content"))
    return validate.validate_contents(rows)


@_query("validate_texts", f"SELECT event_id, 1 AS error_number, {_DAMAGE} AS category, 'Fatal' AS severity, CASE event_id % 6 WHEN 5 THEN 'x' END AS tag_name, CASE event_id % 6 WHEN 5 THEN 'k' END AS reference_tag FROM events WHERE event_id % 6 <> 0")
def validate_texts(spark, sf_dir):
    return _damaged(spark, sf_dir).select(F.col("path").cast("long").alias("event_id"), "error_number", "category", "severity", "tag_name", "reference_tag")


@_query("validation_summary", f"SELECT 'Fatal' AS severity, {_DAMAGE} AS category, count(*) AS n FROM events WHERE event_id % 6 <> 0 GROUP BY 2")
def validation_summary(spark, sf_dir):
    return validate.summary(_damaged(spark, sf_dir))


@_query("error_offsets", "SELECT o_orderkey, floor((o_orderkey % 100) * ((o_orderkey * 37) / (o_orderkey % 50 + 1)))::BIGINT AS byte_offset FROM orders")
def error_offsets(spark, sf_dir):
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", validate.byte_offset(key % 100 + 1, key * 37, key % 50 + 1).alias("byte_offset"))


@_query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@_query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@_query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def _feed(spark: SparkSession, name: str) -> str:
    """A new name for a feed in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@_query(
    "json_feed_records",
    """SELECT 0 AS source_idx, row_number() OVER (ORDER BY o_orderkey) - 1 AS rec_idx, o_orderkey::VARCHAR AS id, concat('a,"', o_orderstatus, '" [', o_custkey, ']') AS title, o_orderdate::DATE::VARCHAR AS day FROM orders""",
)
def json_feed_records(spark, sf_dir):
    """Orders as one JSON file, read back in chunks."""
    path, order = _feed(spark, "orders.json"), F.col("o_orderkey")
    title = F.concat(F.lit('a,"'), "o_orderstatus", F.lit('" ['), "o_custkey", F.lit("]"))
    rows = in_order(_table(spark, sf_dir, "orders"), "o_orderkey").select(order.alias("id"), title.alias("title"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("on"))
    sinks.export(rows, path, "json", as_file=True)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return feeds.scan_jobs(spark, [path]).select("source_idx", "rec_idx", field("id").alias("id"), field("title").alias("title"), field("on_day").alias("day"))


@_query(
    "xml_feed_records",
    "SELECT 0 AS source_idx, row_number() OVER (ORDER BY p_partkey) - 1 AS rec_idx, p_partkey::VARCHAR AS id, concat(p_name, ' > & ', p_brand) AS title, concat('<job>', p_size, ' ]]') AS note FROM part",
)
def xml_feed_records(spark, sf_dir):
    """Parts as one XML file with comments, CDATA and attributes that hold >, read back in chunks."""
    path = _feed(spark, "parts.xml")
    note = F.concat(F.lit("<![CDATA[<job>"), "p_size", F.lit(" ]]]]><![CDATA[]]>"))
    raw = F.concat(F.lit("<job a='>'><!-- </job> --><id>"), "p_partkey", F.lit("</id><t>"), T.xml_escape(F.concat("p_name", F.lit(" > & "), "p_brand")), F.lit("</t><n>"), note, F.lit("</n></job>"))
    sinks.merged_xml(_table(spark, sf_dir, "part").select(F.lit(0).alias("source_idx"), F.col("p_partkey").alias("rec_idx"), raw.alias("raw")), path, as_file=True)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return feeds.scan_jobs(spark, [path]).select("source_idx", "rec_idx", field("id").alias("id"), field("t").alias("title"), field("n").alias("note"))


@_query("xml_records_at_path", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS rec_idx, c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def xml_records_at_path(spark, sf_dir):
    """Customers below another element, found by the end of their path, with leaves by path and attributes."""
    path = _feed(spark, "customers.xml")
    raw = F.concat(F.lit("<c><cust key='"), "c_custkey", F.lit("'><n><a>"), T.xml_escape(F.col("c_name")), F.lit("</a></n><s>"), "c_mktsegment", F.lit("</s></cust></c><other><cust2/></other>"))
    sinks.merged_xml(_table(spark, sf_dir, "customer").select(F.lit(0).alias("source_idx"), F.col("c_custkey").alias("rec_idx"), raw.alias("raw")), path, "all", as_file=True)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return feeds.read_records(spark, path, "//c/cust").select("rec_idx", field("@key").alias("key"), field("n/a").alias("name"), field("s").alias("segment"))


@_query("json_table_at_path", 'SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey::VARCHAR AS "at/nation", CASE WHEN s_acctbal < 0 THEN floor(s_acctbal)::BIGINT::VARCHAR END AS owed FROM supplier')
def json_table_at_path(spark, sf_dir):
    """Suppliers below two names of a JSON file, as a flat table with the columns of all of them."""
    path = _feed(spark, "suppliers.json")
    owed = F.when(F.col("s_acctbal") < 0, F.floor("s_acctbal"))
    rows = _table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("nation")).alias("at"), owed.alias("owed"))).alias("value"))
    sinks.one_file(['{"count, all": [1, {"x": "]"}], "now": {"list": [', rows.withColumn("value", F.concat("value", F.lit(","))), '{"owed": null}]}}'], path)
    return feeds.flatten(feeds.read_json(spark, path, "now.list.item")).where("id is not null").select("id", "name", "`at/nation`", "owed")


@_query("json_file_faults", """SELECT 1 AS error_number, count(*) + 3 AS line, 19 AS "column", concat('Duplicate object key ', chr(39), 'b', chr(39)) AS message, 'Invalid Attribute' AS category, 'Fatal' AS severity, 4 AS context FROM events""")
def json_file_faults(spark, sf_dir):
    """Events as one file with a key that is repeated in its last line."""
    path = _feed(spark, "events.json")
    rows = in_order(_table(spark, sf_dir, "events"), "event_id").select(F.concat("props", F.lit(",")).alias("value"))
    sinks.one_file(['{"a": [', rows, "0],", ' "b": 1, "c": {}, "b": 2}'], path)
    found = validate.validate(spark, path, 3)
    return found.select("error_number", F.col("line").cast("long").alias("line"), "column", "message", "category", "severity", F.size("context_lines").alias("context"))


@_query("merge_union", "SELECT r_name AS name, 0 AS source_idx FROM region UNION ALL SELECT n_name, 1 FROM nation")
def merge_union(spark, sf_dir):
    return dedup.ordered_union([_table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))]).select("name", "source_idx")


@_query("dedup_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))")
def dedup_first_wins(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.lit(0).alias("source_idx"), F.col("doc_id").alias("rec_idx"), F.create_map(F.lit("id"), F.trim("text")).alias("fields"), "text")
    return dedup.first_wins(docs, ("id",)).select(F.col("rec_idx").alias("doc_id"))


_ROUNDS = """WITH RECURSIVE r(o, a, b, status) AS (
  SELECT o_orderkey, o_custkey % 997, strftime(o_orderdate, '%Y-%m-%d'), 0 FROM orders
  UNION ALL
  SELECT o, a, b, CASE WHEN wins THEN 1 WHEN bool_or(wins) OVER (PARTITION BY a) OR bool_or(wins) OVER (PARTITION BY b) THEN 2 ELSE 0 END
  FROM (SELECT o, a, b, o = min(o) OVER (PARTITION BY a) AND o = min(o) OVER (PARTITION BY b) AS wins FROM r WHERE status = 0)
) SELECT o AS rec_idx FROM r WHERE status = 1"""


@_query("dedup_multi_key", _ROUNDS)
def dedup_multi_key(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    fields = F.create_map(F.lit("id"), (F.col("o_custkey") % 997).cast("string"), F.lit("url"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return dedup.first_wins(orders.select(F.lit(0).alias("source_idx"), F.col("o_orderkey").alias("rec_idx"), fields.alias("fields"))).select("rec_idx")


@_query("dedup_content_hash", "SELECT min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def dedup_content_hash(spark, sf_dir):
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("id"), F.lit(" \t"))
    events = _table(spark, sf_dir, "events").select(F.lit(0).alias("source_idx"), F.col("event_id").alias("rec_idx"), fields.alias("fields"))
    return dedup.first_wins(events).select(F.col("rec_idx").alias("event_id"))


@_query("dedup_known", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey")
def dedup_known(spark, sf_dir):
    record = lambda key, value: [F.lit(0).alias("source_idx"), F.col(key).alias("rec_idx"), F.create_map(F.lit("Apply-URL"), F.concat(F.lit("\tC"), F.col(value).cast("string"), F.lit(" "))).alias("fields")]
    known = dedup.registered(_table(spark, sf_dir, "customer").where("c_acctbal < 0").select(*record("c_custkey", "c_custkey")))
    return dedup.first_wins(_table(spark, sf_dir, "orders").select(*record("o_orderkey", "o_custkey")), known=known).select(F.col("rec_idx").alias("o_orderkey"))


@_query(
    "merge_counters",
    """SELECT 0 AS source_idx, count(*) AS parsed, count(*) AS written, 0::BIGINT AS duplicates FROM customer UNION ALL
      SELECT 1, count(*), count(DISTINCT CASE WHEN c_custkey IS NULL THEN o_custkey END), count(*) - count(DISTINCT CASE WHEN c_custkey IS NULL THEN o_custkey END) FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def merge_counters(spark, sf_dir):
    record = lambda i, key, value: [F.lit(i).alias("source_idx"), F.col(key).alias("rec_idx"), F.create_map(F.lit("id"), F.col(value).cast("string")).alias("fields")]
    records = _table(spark, sf_dir, "customer").select(*record(0, "c_custkey", "c_custkey")).union(_table(spark, sf_dir, "orders").select(*record(1, "o_orderkey", "o_custkey")))
    return dedup.merge_counters(records, dedup.first_wins(records, ("id",)))


@_query("diff_tables", "SELECT coalesce(a.o, b.o)::VARCHAR AS path, CASE WHEN b.o IS NULL THEN 'Removed' WHEN a.o IS NULL THEN 'Added' ELSE 'Value mismatch' END AS kind, a.v AS old_value, b.v AS new_value FROM (SELECT o_orderkey AS o, o_orderstatus AS v FROM orders) a FULL JOIN (SELECT c_custkey AS o, c_mktsegment AS v FROM customer) b ON a.o = b.o WHERE a.v IS DISTINCT FROM b.v")
def diff_tables(spark, sf_dir):
    a = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("value"))
    return difference(a, _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_mktsegment").alias("value")))


@_query("diff_full_outer", "SELECT coalesce(a.n_name, b.n_name) AS path, CASE WHEN b.n_name IS NULL THEN 'Removed' WHEN a.n_name IS NULL THEN 'Added' ELSE 'Value mismatch' END AS kind, a.v AS old_value, b.v AS new_value FROM (SELECT n_name, n_regionkey::VARCHAR AS v FROM nation) a FULL JOIN (SELECT CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END AS n_name, (n_regionkey % 3)::VARCHAR AS v FROM nation) b ON a.n_name = b.n_name WHERE a.v IS DISTINCT FROM b.v")
def diff_full_outer(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    a = nation.select(F.col("n_name").alias("path"), F.col("n_regionkey").cast("string").alias("value"))
    b = nation.select(F.when(F.col("n_regionkey") == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("path"), (F.col("n_regionkey") % 3).cast("string").alias("value"))
    return difference(a, b)


@_query("strip_function", "SELECT p_partkey, trim(p_name) AS value FROM part")
def strip_function(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", strip(F.concat(F.lit("  "), "p_name", F.lit("\n"))).alias("value"))


@_query("validate_json", "SELECT event_id, json_valid(props) AS valid FROM events")
def validate_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"))


@_query("sheet_round_trip", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey::VARCHAR AS \"Record ID\", o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, o_orderpriority AS priority FROM orders")
def sheet_round_trip(spark, sf_dir):
    """Orders exported as a workbook and read back from all of its sheets."""
    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}.xlsx"
    orders = in_order(_table(spark, sf_dir, "orders"), "o_orderkey")
    sinks.export(sinks.labelled(orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))), path, "xlsx")
    return sheets.read_sheets(spark, path).withColumn("price", F.col("price").cast("double"))


@_query("sheet_preview", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_partkey::VARCHAR AS col_0, p_name AS col_1 FROM part ORDER BY p_partkey LIMIT 100")
def sheet_preview(spark, sf_dir):
    """The first 100 rows of a workbook of parts."""
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}.xlsx"
    sheets.export_sheet(_table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), path)
    return sheets.sheet_preview(spark, path)[1]
