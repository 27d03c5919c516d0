"""The scalar functions of feed mappings, as Column to Column; only odd date formats and escapes leave the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.functions.compat import strip

#: Date directives and the patterns that mean the same. Reading, a field may have fewer digits.
_DATES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "j": "DDD", "%": "%"}
_READ = _DATES | {"m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "j": "D"}
#: Fixed value: how a place in a template is written.
PLACE = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"


def _int(text: str) -> int | None:
    try:
        return int(str(text).strip())
    except ValueError:
        return None


def concat(value: Column, columns: list[str], sep: str = "", *refs: str, context: dict[str, Column] | None = None) -> Column:
    """References ($name) and literals joined; the value itself does not count.

    A name is a column of the row, else a value of ``context`` (static fields and targets so far), else empty.
    """

    def found(name: str) -> Column:
        if name in columns:
            return F.col("`" + name.replace("`", "``") + "`")
        return (context or {}).get(name, F.lit(""))

    parts = [F.coalesce(found(r[1:]).cast("string"), F.lit("")) if r.startswith("$") else F.lit(r) for r in refs]
    return F.concat_ws(sep, *parts) if parts else F.lit("")


def substring(value: Column, start: str = "0", end: str = "") -> Column:
    """A slice; negative places count from the end, and places that are no numbers leave the value."""
    a, b = _int(start), _int(end) if str(end).strip() else None
    if a is None or (str(end).strip() and b is None):
        return value
    n = F.length(value)
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = place(a), n if b is None else F.least(place(b), n)
    return F.when(last > first, F.substring(value, first + 1, last - first)).otherwise("")


def tokenize(value: Column, delimiter: str, index: str = "0") -> Column:
    i = _int(index)
    if i is None:
        return value
    return F.split_part(value, F.lit(delimiter), F.lit(i + 1)) if delimiter and i >= 0 else F.lit("")


def _filled(value: Column, made: Column) -> Column:
    """``made``, but an empty value stays empty."""
    return F.when(value == "", value).otherwise(made)


def replace(value: Column, old: str, new: str = "") -> Column:
    if old:
        return F.replace(value, F.lit(old), F.lit(new))
    return _filled(value, F.concat(F.lit(new), F.array_join(F.filter(F.transform(F.split(value, ""), lambda c: F.when(c != "", F.concat(c, F.lit(new)))), lambda c: c.isNotNull()), "")))


def title_case(value: Column) -> Column:
    """Each run of letters with its first one upper case."""
    runs = F.regexp_extract_all(value, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def default(value: Column, fallback: str = "") -> Column:
    return F.when(strip(value) == "", F.lit(fallback)).otherwise(value)


def _date_pattern(text: str, fields: dict[str, str] = _DATES) -> str | None:
    out, at = "", 0
    for m in re.finditer(r"%(.)", text):
        if m[1] not in fields:
            return None
        out += re.sub(r"([A-Za-z']+)", lambda k: "'" + k[1].replace("'", "''") + "'", text[at : m.start()]) + fields[m[1]]
        at = m.end()
    return out + re.sub(r"([A-Za-z']+)", lambda k: "'" + k[1].replace("'", "''") + "'", text[at:])


def date_format(value: Column, given: str, wanted: str) -> Column:
    """A date in another format, blanks around it apart; what does not parse stays as it is."""
    a, b = _date_pattern(given, _READ), _date_pattern(wanted)
    if a and b and not re.search("%[a-zA-Z]%[a-zA-Z]", given):  # fields that touch need fixed widths
        return F.coalesce(F.date_format(F.try_to_timestamp(strip(value), F.lit(a)), b), value)

    @F.pandas_udf(StringType())
    def slow(values: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return datetime.strptime(x.strip(), given).strftime(wanted)
            except (AttributeError, TypeError, ValueError):
                return x

        return values.map(one)

    return slow(value)


def regex_replace(value: Column, pattern: str, new: str = "") -> Column:
    try:
        re.compile(pattern)
    except re.error:
        return value
    return _filled(value, F.regexp_replace(value, re.sub(r"\(\?P<", "(?<", pattern), re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$"))))


def url_encode(value: Column) -> Column:
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_decode(value: Column) -> Column:
    """Escapes decoded where they are whole; plus signs and broken escapes stay."""

    @F.pandas_udf(StringType())
    def slow(values: pd.Series) -> pd.Series:
        return values.map(unquote, na_action="ignore")

    clean = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    broken = value.rlike("%(?![0-9A-Fa-f]{2})") | clean.isNull()
    return F.when(~value.contains("%"), value).when(broken | (clean.contains("�")), slow(value)).otherwise(clean)


def contains(value: Column, text: str, yes: str = "", no: str = "") -> Column:
    return F.when(value.contains(text), F.lit(yes)).otherwise(F.lit(no))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "substring": substring, "tokenize": tokenize, "replace": replace, "upper": F.upper, "lower": F.lower, "strip": strip, "title_case": title_case, "default": default,
    "date_format": date_format, "regex_replace": regex_replace, "url_encode": url_encode, "url_decode": url_decode, "contains": contains,
}


def apply(value: Column, steps: list[dict], columns: list[str], context: dict[str, Column] | None = None) -> Column:
    """Steps ({function, args}) in order; an unknown function or wrong arguments leave the value. Null counts as empty."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for step in steps:
        name, args = step.get("function"), [str(a) for a in step.get("args", [])]
        try:
            if name == "concat":
                out = concat(out, columns, *args, context=context)
            elif name in FUNCTIONS:
                out = FUNCTIONS[name](out, *args)
        except TypeError:
            continue
    return out


def xml_escape(value: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def header_tag(name: Column) -> Column:
    """A column header as an element name."""
    tag = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "")
    return F.when(tag == "", "field").otherwise(tag)


def name_key(name: Column) -> Column:
    return F.lower(F.translate(name, "_-", ""))


def placeholders(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(PLACE), F.lit(1)))


def _fixed(value: Column, places: int) -> Column:
    """A number with so many places, rounded by all of its digits and where these are a tie to the even one.

    ``format_string`` rounds the shortest text of a double, which can be a tie that the double itself is not.
    """
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places))


def _sized(value: Column, places: int, whole_bytes: bool, top: str) -> Column:
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    units = units[: units.index(top) + 1]
    out = None
    for i, unit in reversed(list(enumerate(units))):
        text = F.format_string("%d " + unit, value.cast("long")) if whole_bytes and not i else F.concat(_fixed(value.cast("double") / F.lit(float(1024**i)), places), F.lit(f" {unit}"))
        out = text if out is None else F.when(value < 1024 ** (i + 1), text).otherwise(out)
    return out


def format_size(value: Column) -> Column:
    return _sized(value, 2, False, "PB")


def human_size(value: Column) -> Column:
    return _sized(value, 1, False, "TB")


def file_size(value: Column) -> Column:
    return F.when(value < 0, "0 B").otherwise(_sized(value, 2, True, "TB"))


def duration(seconds: Column) -> Column:
    whole = seconds.cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(seconds < 1, F.concat(_fixed(seconds, 1), F.lit("s"))).when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def speed(bytes_a_second: Column) -> Column:
    return F.when(bytes_a_second <= 0, "0.00 MB/s").otherwise(F.concat(_fixed(bytes_a_second.cast("double") / 1048576.0, 2), F.lit(" MB/s")))
