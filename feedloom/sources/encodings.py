"""Which encoding bytes are in that neither a mark nor a declaration tells: validity first, then how well letters sit together."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes that are looked at.
SAMPLE = 65_536
#: Encodings that are tried on bytes that are not UTF-8; of equal ones the first counts.
CANDIDATES = ("cp1252", "cp1255", "cp1251", "cp1250", "koi8_r", "cp1253", "cp1256", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
_QUOTES = set("«»“”„‘’‚–—…€°§№·")


@cache
def _script(char: str) -> str:
    """The first word of a character's name (LATIN, CYRILLIC, HANGUL ...), of a letter; else nothing."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def _decoded(data: bytes, name: str) -> str | None:
    """The text, if the bytes are valid but for a character that the sample's end cuts."""
    for cut in range(4 if len(data) >= SAMPLE else 1):
        try:
            return data[: len(data) - cut].decode(name)
        except UnicodeDecodeError:
            continue
    return None


def _score(text: str) -> float:
    """From 1, where every character beyond ASCII is a letter among letters of its script, down to -1."""
    total, count, before = 0.0, 0, ""
    for char, after in zip(text, [*text[1:], ""], strict=True):
        if char >= "\x80":
            count += 1
            script = _script(char)
            if not script:
                total += 0.5 if char in _QUOTES else -1.0
            elif script in ("HIRAGANA", "KATAKANA", "HANGUL"):
                total += 1.0 if char < "＀" else -0.5  # half-width forms are rare
            elif script == "CJK":  # any two bytes are one somewhere: less telling than an alphabet
                total += 0.7 if "一" <= char else -0.5
            elif script == "LATIN" and before >= "\x80" and after >= "\x80" and before.isalpha() and after.isalpha():
                total += -1.0  # three accented letters in a row
            else:
                near = [s for s in (_script(before) if before else "", _script(after) if after else "") if s]
                alike = not near or all(s == script for s in near)
                inside = char.isupper() and before.isalpha() and before.islower()  # a capital within a word
                total += 1.0 if alike and not inside else -1.0
        before = char
    return total / count if count else 0.0


def guessed(data: bytes) -> str:
    """The encoding of bytes by what they look like."""
    data = data[:SAMPLE]
    zeros = [data[i:512:4].count(0) for i in range(4)]
    quarter = max(1, len(data[:512]) // 4)
    if zeros[3] > quarter / 2 and zeros[2] > quarter / 2 and zeros[0] < quarter / 2:
        return "utf-32-le"
    if zeros[0] > quarter / 2 and zeros[1] > quarter / 2 and zeros[3] < quarter / 2:
        return "utf-32-be"
    if zeros[1] + zeros[3] > quarter and zeros[0] + zeros[2] < quarter / 2:
        return "utf-16-le"
    if zeros[0] + zeros[2] > quarter and zeros[1] + zeros[3] < quarter / 2:
        return "utf-16-be"
    if _decoded(data, "utf-8") is not None:
        return "utf-8"
    scores = {name: _score(text) for name in CANDIDATES if (text := _decoded(data, name)) is not None}
    best = max(scores, key=lambda name: scores[name], default="")
    return best if best and scores[best] > 0 else "iso-8859-1"


@F.pandas_udf(StringType())
def guessed_encoding(content: pd.Series) -> pd.Series:
    """``guessed`` of binary values; null stays null. Pass the first SAMPLE bytes of a file."""
    return content.map(lambda data: None if data is None else guessed(bytes(data)))
