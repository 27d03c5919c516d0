"""Feed generation: a template compiled at plan time into one concatenation of literals and columns for each row."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.transforms import PLACE, apply, xml_escape

_PLACE = re.compile(PLACE)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)


def check(template: str) -> str | None:
    """What is wrong with a template, or None."""
    if not template.strip():
        return "the template is empty"
    try:
        ElementTree.fromstring(template)
    except ElementTree.ParseError as e:
        return str(e)
    return None


def names(template: str) -> list[str]:
    return list(dict.fromkeys(_PLACE.findall(template)))


#: Other names of columns for a placeholder.
SYNONYMS = {
    "title": ["jobtitle", "name", "position", "role"],
    "company": ["employer", "companyname", "brand", "organization"],
    "posteddate": ["dateposted", "posted", "date", "creationdate"],
    "refcode": ["reference", "jobid", "id", "ref", "code"],
    "postalcode": ["zip", "zipcode", "postal", "postcode"],
    "description": ["desc", "jobdescription", "body", "text"],
    "salary_min": ["minsalary", "salarymin", "min", "salaryfrom"],
    "salary_max": ["maxsalary", "salarymax", "max", "salaryto"],
}


def auto_match(columns: list[str], places: list[str]) -> dict[str, str]:
    """Placeholder to column: equal after normalising, else one within the other, else by one of its other names in turn."""
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    near = lambda name: [c for c in columns if key(c) and (key(c) in name or name in key(c))]
    out = {}
    for p in places:
        tries = ([c for c in columns if key(c) == key(p)], near(key(p)), *(near(s) for s in SYNONYMS.get(p, [])))
        if found := next((t for t in tries if t), None):
            out[p] = found[0]
    return out


def repeating(template: str, mapped: list[str]) -> tuple[str, str, str]:
    """(before, record, after): the smallest element under the root that holds every mapped placeholder, as it is written."""
    spans, stack = [], []
    for m in re.finditer(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<(/?)([^\s/>!?]+)[^>]*?(/?)>", template, re.S):
        if not m[2]:
            continue
        if m[1]:
            name, start = stack.pop()
            spans.append((start, m.end(), len(stack)))
        elif m[3]:
            spans.append((m.start(), m.end(), len(stack)))
        else:
            stack.append((m[2], m.start()))
    wanted = [m.span() for m in _PLACE.finditer(template) if m[1] in mapped]
    holds = [s for s in spans if s[2] >= 1 and all(s[0] <= a and b <= s[1] for a, b in wanted)]
    inner = [s for s in holds if any(t[0] > s[0] and t[1] < s[1] for t in spans)] if wanted else []  # a leaf is no record
    best = max(inner, key=lambda s: s[2]) if inner else min((s for s in spans if s[2] == 1), default=(0, len(template), 0))
    return template[: best[0]], template[best[0] : best[1]], template[best[1] :]


#: Elements of the optional blocks of a record, and of the head of a feed, in order.
SALARY = ("min", "max", "type", "currency")
AWM = ("method", "format", "email", "apikey")
HEADERS = ("provider", "providerurl", "isfullfeed", "part", "islast")


def dynamic_value(config: dict | None, columns: list[str]) -> Column:
    """A configured value ({source_type: column or static, value}) as escaped text; what is not known is empty."""
    kind, value = (config or {}).get("source_type"), (config or {}).get("value", "")
    if kind == "column" and value in columns:
        return xml_escape(F.coalesce(F.col("`" + value.replace("`", "``") + "`").cast("string"), F.lit("")))
    return xml_escape(F.lit("" if value is None else str(value))) if kind == "static" else F.lit("")


def _element(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))


def blocks(record: str, columns: list[str], campaign: list[dict] | None = None, salary: dict | None = None, awm: dict | None = None) -> list[tuple[int, Column]]:
    """(place in the record's text, what is put in there): custom fields of the campaign, salary, AWM.

    Custom fields go to the end of the record's own campaign element, which is made if there is none; the other blocks go to
    the end of the record.
    """
    end = record.rindex("</")
    out: list[tuple[int, Column]] = []
    fields = [_element("customfield", _element("name", xml_escape(F.lit(f["name"].strip()))), _element("value", dynamic_value(f, columns))) for f in campaign or [] if f.get("name", "").strip()]
    if campaign:
        custom, depth, at = _element("customfields", *fields), 0, None
        for m in re.finditer(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<(/?)([^\s/>!?]+)[^>]*?(/?)>", record, re.S):
            if m[2] and m[1]:
                depth -= 1
                if depth == 1 and m[2] == "campaign" and at is None:
                    at = m.start()
            elif m[2] and not m[3]:
                depth += 1
        out.append((at, custom) if at is not None else (end, _element("campaign", custom)))
    for name, config, names in (("salary", salary, SALARY), ("awm", awm, AWM)):
        if (config or {}).get("enabled"):
            out.append((end, _element(name, *[_element(n, dynamic_value(config.get("fields", {}).get(n), columns)) for n in names])))
    return out


def header_text(df: DataFrame, headers: dict, order: list[str] | None = None) -> str:
    """The head elements of a feed; a header of a column has its value in the first row (by ``order`` if given)."""
    wanted = {k: headers.get(k) or {} for k in HEADERS}
    known = [c["value"] for c in wanted.values() if c.get("source_type") == "column" and c.get("value") in df.columns]
    row = (df.orderBy(*order) if order else df).select(*[F.col("`" + c.replace("`", "``") + "`").cast("string") for c in dict.fromkeys(known)]).first() if known else None
    value = lambda c: ((row[c["value"]] if row and c.get("value") in known else "") if c.get("source_type") == "column" else c.get("value", "")) or ""
    return "".join(f"<{k}>{_filled('{{v}}', {'v': str(value(c))})}</{k}>" for k, c in wanted.items())


def render(
    df: DataFrame, record: str, mapping: dict[str, str], static: dict[str, str] | None = None, transforms: dict[str, list[dict]] | None = None, disabled: list[str] | None = None,
    campaign: list[dict] | None = None, salary: dict | None = None, awm: dict | None = None,
) -> Column:
    """The text of one record: mapped columns over static values, transformed, then escaped; in CDATA only its end is split.

    Transforms run in the order given; a reference in one is a column, else a static value or a target transformed before.
    """
    for tag in disabled or []:
        record = re.sub(rf"<{re.escape(tag)}(\s[^>]*)?(/>|>.*?</{re.escape(tag)}\s*>)", "", record, flags=re.S)
    unknown = sorted(c for c in mapping.values() if c not in df.columns)
    if unknown:
        raise ValueError(f"mapped columns that the rows do not have: {', '.join(unknown)}")
    cdata = [m.span(1) for m in _CDATA.finditer(record)]
    context: dict[str, Column] = {k: F.lit("" if v is None else str(v)) for k, v in (static or {}).items()}
    context |= {k: F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")) for k, c in mapping.items()}
    for name, steps in (transforms or {}).items():
        context[name] = apply(context.get(name, F.lit("")), steps, df.columns, context)
    puts = [(m.start(), m.end(), m[1], None) for m in _PLACE.finditer(record)] + [(at, at, None, made) for at, made in blocks(record, df.columns, campaign, salary, awm)]
    parts, at = [], 0
    for start, end, name, made in sorted(puts, key=lambda p: p[:2]):
        parts.append(F.lit(record[at:start]))
        at = end
        if name is None:
            parts.append(made)
            continue
        value = context.get(name, F.lit(""))
        parts.append(F.replace(value, F.lit("]]>"), F.lit("]]]]><![CDATA[>")) if any(a <= start < b for a, b in cdata) else xml_escape(value))
    return F.concat(*parts, F.lit(record[at:]))


def _filled(text: str, static: dict[str, str]) -> str:
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return _PLACE.sub(lambda m: escape(static.get(m[1], "")), text)


def build(df: DataFrame, template: str, mapping: dict[str, str], out: str, static: dict[str, str] | None = None, headers: dict[str, str] | None = None, **render_options) -> None:
    """Write the feed as text parts: the opening, a part for each partition of records, the closing.

    Concatenated in name order they are the document; static values of the frame never touch record data. ``headers`` are
    plain values by element, or configured ones ({source_type, value}), which come in the fixed order of a feed's head.
    """
    fault = check(template)
    if fault:
        raise ValueError(fault)
    before, record, after = repeating(template, list(mapping))
    if any(isinstance(v, dict) for v in (headers or {}).values()):
        extra = header_text(df, headers)
    else:
        extra = "".join(f"<{k}>{_filled('{{v}}', {'v': v})}</{k}>" for k, v in (headers or {}).items())
    before = re.sub(r"(<(?![?!])[^>]+>)", lambda m: m[1] + extra, before, count=1)
    spark = df.sparkSession
    rows = df.select(render(df, record, mapping, static, **render_options).alias("value"))
    for name, part in (("0-open", spark.createDataFrame([(_filled(before, static or {}),)], "value string")), ("1-records", rows), ("2-close", spark.createDataFrame([(_filled(after, static or {}),)], "value string"))):
        part.write.text(f"{out}/{name}")
