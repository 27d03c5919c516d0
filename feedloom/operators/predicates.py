"""Filter and search specifications compiled to one Column predicate; Catalyst pushes what it can to the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.compat import loose_real, matches, wild


def _column(path: str) -> Column:
    return F.col("`" + path.replace("`", "``") + "`")


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _ordered(path: str, value: str, more: bool) -> Column:
    c, number = _column(path), _number(value)
    if number is None:
        return c > value if more else c < value
    if number != number:
        return F.lit(False)
    return loose_real(c) > number if more else loose_real(c) < number


def _listed(path: str, value: str, inside: bool) -> Column:
    items = [x.strip() for x in value.split(",") if x.strip()]
    if not items:
        return F.lit(not inside)
    return _column(path).isin(items) if inside else _column(path).isNull() | ~_column(path).isin(items)


def clause(path: str, operator: str, value: str = "") -> Column | None:
    """One clause, or None for an operator that is not known."""
    c = _column(path)
    known = {
        "equals": lambda: c == value,
        "notequals": lambda: ~c.eqNullSafe(F.lit(value)),
        "contains": lambda: wild(c, f"%{value}%"),
        "startswith": lambda: wild(c, f"{value}%"),
        "endswith": lambda: wild(c, f"%{value}"),
        "greaterthan": lambda: _ordered(path, value, True),
        "lessthan": lambda: _ordered(path, value, False),
        "exists": lambda: c.isNotNull() & (c != ""),
        "missing": lambda: c.isNull() | (c == ""),
        "inlist": lambda: _listed(path, value, True),
        "notinlist": lambda: _listed(path, value, False),
        "regex": lambda: matches(c, value),
    }.get("".join(operator.lower().split()))
    return known() if known else None


def compile_filters(filters: list[dict], paths: list[str]) -> Column | None:
    """All clauses together. An unknown field makes the result empty; an unknown operator or a blank part is skipped."""
    out = []
    for f in filters or []:
        path, operator = str(f.get("field") or "").strip(), str(f.get("operator") or "").strip()
        if not path or not operator:
            continue
        made = clause(path, operator, str(f.get("value") or "")) if path in paths else F.lit(False)
        if made is not None:
            out.append(made)
    return reduce(and_, out) if out else None


#: Match types of a search and the filter each stands for.
MATCH = {"exact": "equals", "exact match": "equals", "contains": "contains", "starts with": "startswith", "starts": "startswith", "ends with": "endswith", "ends": "endswith", "regex": "regex"}


def compile_search(term: str, match: str, paths: list[str], field: str = "all") -> Column | None:
    """A search in one field, or in any; a blank term or no columns give no predicate, an unknown field an empty result."""
    if not term or not term.strip() or not paths:
        return None
    operator = MATCH.get(match.strip().lower(), "contains")
    if field and field.lower() not in ("all", "all fields"):
        return clause(field, operator, term) if field in paths else F.lit(False)
    return reduce(or_, (F.coalesce(clause(p, operator, term), F.lit(False)) for p in paths))


def select(df: DataFrame, paths: list[str], filters: list[dict] | None = None, term: str = "", match: str = "contains", field: str = "all") -> DataFrame:
    """The rows of ``df`` that the filters and the search keep."""
    both = [p for p in (compile_filters(filters or [], paths), compile_search(term, match, paths, field)) if p is not None]
    return df.where(reduce(and_, both)) if both else df


def preview(df: DataFrame, paths: list[str], limit: int = 1000, **spec) -> tuple[DataFrame, int]:
    """The first rows by id under their path names, and how many rows match."""
    kept = select(df, paths, **spec)
    return kept.select(F.col("id").alias("_row_id"), F.col("raw_content").alias("_raw_content"), *map(_column, paths)).orderBy("_row_id").limit(limit), kept.count()
