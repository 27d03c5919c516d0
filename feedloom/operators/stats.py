"""Field statistics, groups, duplicates and completeness. All fields are measured in one pass over unpivoted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, EMPTY, OTHER = "[Missing]", "[Empty]", "Other"
#: Paths that identify a record, in lower case.
ID_NAMES = ("jobid", "id", "job_id", "guid", "url", "applyurl")


def _quoted(path: str) -> str:
    return "`" + path.replace("`", "``") + "`"


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def unpivoted(df: DataFrame, paths: list[str]) -> DataFrame:
    """(field_idx, path, value): every value of the fields as text, nulls included."""
    pairs = F.array(*[F.struct(F.lit(i).alias("field_idx"), F.lit(p).alias("path"), F.col(_quoted(p)).cast("string").alias("value")) for i, p in enumerate(paths)])
    return df.select(F.explode(pairs).alias("f")).select("f.*")


def all_field_stats(df: DataFrame, paths: list[str]) -> DataFrame:
    """Counts, lengths and completion of every field: one row a field. Values are counted before fields, so a hot value is
    reduced before the shuffle and distinct values need no second pass."""
    values = unpivoted(df, paths).groupBy("field_idx", "path", "value").agg(F.count("*").alias("n"))
    there, length = _present(F.col("value")), F.length("value")
    out = values.groupBy("field_idx", "path").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"), F.count(F.when(there, 1)).alias("unique_count"),
        F.coalesce(F.min(length), F.lit(0)).alias("min_length"), F.coalesce(F.max(length), F.lit(0)).alias("max_length"),
        F.sum(F.col("n") * length).alias("_chars"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("_known"),
    )
    return out.select(
        "field_idx", "path", "total", "present", (F.col("total") - F.col("present")).alias("missing"), "unique_count", F.greatest(F.col("present") - F.col("unique_count"), F.lit(0)).alias("duplicate_count"),
        "min_length", "max_length", F.coalesce(F.round(F.try_divide(F.col("_chars"), F.col("_known")), 2), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.round(F.try_divide(100 * F.col("present"), F.col("total")), 2), F.lit(0.0)).alias("completion_rate"),
    )


def field_stats(df: DataFrame, path: str) -> DataFrame:
    return all_field_stats(df, [path])


def frequent_values(df: DataFrame, path: str, limit: int = 10, rarest: bool = False) -> DataFrame:
    """The most (or least) frequent present values; ties in value order."""
    c = F.col(_quoted(path))
    n = F.col("n").asc() if rarest else F.col("n").desc()
    return df.where(_present(c)).groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(n, "value").limit(limit)


def group_by(df: DataFrame, by: list[str], paths: list[str]) -> DataFrame | None:
    """Rows of each combination, null keys named; unknown paths are dropped, None if none is known."""
    known = [p for p in by if p in paths]
    if not known:
        return None
    keys = [F.coalesce(F.col(_quoted(p)).cast("string"), F.lit(MISSING)).alias(p) for p in known]
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *map(_quoted, known))


def rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """Group-by with subtotals (an extension)."""
    return df.rollup(*map(_quoted, by)).agg(F.count("*").alias("n"))


def field_values(df: DataFrame, path: str) -> DataFrame:
    """Every non-null value and its rows, empty ones named."""
    c = F.col(_quoted(path))
    return df.where(c.isNotNull()).groupBy(F.when(c == "", EMPTY).otherwise(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def field_value_export(df: DataFrame, path: str) -> DataFrame:
    """Every value and its rows, null and empty as they are."""
    return df.groupBy(F.col(_quoted(path)).alias("value")).agg(F.count("*").alias("n"))


def duplicate_values(df: DataFrame, path: str, limit: int = 1000) -> DataFrame:
    """Present values of more than one row, most rows first (a top-k report)."""
    c = F.col(_quoted(path))
    return df.where(_present(c)).groupBy(c.alias("value")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "value").limit(limit)


def id_path(paths: list[str]) -> str | None:
    """The first path that is, as a whole and without case, a name that identifies records."""
    return next((p for p in paths if p.lower() in ID_NAMES), None)


def duplicate_total(df: DataFrame, path: str) -> DataFrame:
    """One row: how many rows repeat a value that an earlier row has."""
    c = F.col(_quoted(path))
    groups = df.where(_present(c)).groupBy(c.alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def summary(df: DataFrame, paths: list[str]) -> DataFrame:
    """One row: records, fields, and repeated ids of the first field that identifies records."""
    path = id_path(paths)
    total = df.agg(F.count("*").alias("total_jobs"), F.lit(len(paths)).alias("total_fields"))
    return total.crossJoin(duplicate_total(df, path)) if path else total.withColumn("duplicates", F.lit(0).cast("long"))  # one row each


def completeness(df: DataFrame, paths: list[str]) -> DataFrame:
    """Rate, present and missing of each field, least complete first, with the band of the rate."""
    rate = F.col("completion_rate")
    band = F.when(rate < 50, "danger").when(rate < 85, "warning").otherwise("success")
    return all_field_stats(df, paths).orderBy("completion_rate", "field_idx").select("path", "completion_rate", "present", "missing", band.alias("band"))


def duplicate_summary(df: DataFrame, paths: list[str]) -> DataFrame:
    """For each field with repeated values: the number of such values and of their rows."""
    groups = unpivoted(df, paths).where(_present(F.col("value"))).groupBy("path", "value").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("path").agg(F.count("*").alias("groups"), F.sum("n").alias("total_rows")).orderBy(F.desc("groups"), "path")


def chart(grouped: DataFrame, by: list[str], top: int = 15) -> DataFrame:
    """Labels and values of the largest groups, the others as one if they have any rows; without keys the label is Unknown."""
    label = F.concat_ws(" > ", *[F.col(_quoted(p)) for p in by]) if by else F.lit("Unknown")
    first = grouped.orderBy(F.desc("n"), *map(_quoted, by)).limit(top).select(label.alias("label"), "n")
    total = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).union(first.agg(-F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    return first.union(total.agg(F.lit(OTHER).alias("label"), F.sum("n").alias("n")).where("n > 0"))


def success_rate(runs: int, successes: int) -> str:
    """The share of runs that went well, with one decimal; all of them if there was none."""
    return f"{100 * successes / runs:.1f}%" if runs else "100.0%"
