"""Column shims for text that was written for other engines: loose numbers, wildcards, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))"


def loose_real(value: Column) -> Column:
    """The number that a text begins with, 0.0 if it begins with none; null stays null."""
    number = F.nullif(F.regexp_extract(value, _NUMBER, 1), F.lit("")).try_cast("double")
    return F.when(value.isNotNull(), F.coalesce(number, F.lit(0.0)))


def wild(value: Column, pattern: str) -> Column:
    """LIKE without case: % and _ are wildcards, a backslash is itself."""
    return value.ilike(pattern.replace("\\", "\\\\"))


def matches(value: Column, pattern: str) -> Column:
    """A pattern found anywhere without case; null is false, and so is every row if the pattern is invalid."""
    pattern = re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", re.sub(r"\\k<(\w+)>", r"(?P=\1)", pattern)))
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except Exception:  # either dialect rejects it
        return F.lit(False)
    return F.coalesce(value.rlike("(?i)" + pattern), F.lit(False))


#: White space of any kind, with the separators that text functions elsewhere count as such.
_WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    """Without white space of any kind at either end, in linear time."""
    return F.btrim(value, F.lit(_WHITE))
