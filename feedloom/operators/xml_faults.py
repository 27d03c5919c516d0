"""Faults of an XML document, all of them: a tokenizer that goes on after each one.

Tags, comments, CDATA sections and instructions are told apart as the feed scan does it, so nothing in a comment or a CDATA section is
taken for markup. Each start tag, reference and character is checked on its own; an end tag that meets another element closes up to its own
one where that is open, else it takes the place of the innermost.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from feedloom.sources.xml_scan import _TOKEN

_NAME = rb"[A-Za-z_:\x80-\xff][\w.:\x80-\xff-]*+"
_ATTRIBUTE = re.compile(rb"""(\s*+)(?:(""" + _NAME + rb""")(\s*+=\s*+)?("[^"]*+"|'[^']*+')?|([^\s]++))""")
_REFERENCE = re.compile(rb"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+))(;?)|(" + _NAME + rb")(;?))?")
_ILLEGAL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ENTITY = re.compile(rb"<!ENTITY\s+(" + _NAME + rb")")
_DECLARATION = re.compile(rb"""<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
_GIVEN = {b"amp", b"lt", b"gt", b"quot", b"apos"}


class _Document:
    """One walk over a document, collecting (offset, message)."""

    def __init__(self, data: bytes) -> None:
        self.data, self.out = data, []
        self.entities = set(_GIVEN)
        self.stack: list[tuple[bytes, int, frozenset[bytes]]] = []  # name, place, prefixes in scope
        self.opened: Counter[bytes] = Counter()
        self.rooted = self.extra = self.cut = False

    def say(self, at: int, message: str) -> None:
        self.out.append((at, message))

    def walk(self) -> None:
        data, at = self.data, 0
        for m in _TOKEN.finditer(data):
            self._text(at, m.start())
            at = m.end()
            if m[7] is not None:
                self._end(m) if m[6] else self._start(m)
            else:
                self._other(m)
        self._text(at, len(data))
        if self.stack and not self.cut:
            name, place, _ = self.stack[-1]
            self.say(len(data), f"Premature end of data in tag {_shown(name)} line {data.count(b'\n', 0, place) + 1}")
        elif not self.rooted and not self.out:
            self.say(0, "Start tag expected, '<' not found")

    def _text(self, begin: int, end: int) -> None:
        text = self.data[begin:end]
        if not text:
            return
        if not self.stack and text.strip():
            if not self.rooted:
                if b"<" not in text:
                    self.say(begin + len(text) - len(text.lstrip()), "Start tag expected, '<' not found")
            else:
                self._extra(begin + len(text) - len(text.lstrip()))
        if b"<" in text:
            for m in re.finditer(rb"<", text):
                self.say(begin + m.start(), "StartTag: invalid element name")
        if b"]]>" in text and self.stack:
            self.say(begin + text.index(b"]]>"), "Sequence ']]>' not allowed in content")
        self._values(begin, text)

    def _extra(self, at: int) -> None:
        if not self.extra:
            self.say(at, "Extra content at the end of the document")
        self.extra = True

    def _values(self, begin: int, text: bytes) -> None:
        """References and characters of text or of the value of an attribute."""
        for m in _ILLEGAL.finditer(text):
            self.say(begin + m.start(), f"xmlChar 0x{text[m.start()]:X} out of allowed range")
        if b"&" not in text:
            return
        for m in _REFERENCE.finditer(text):
            at = begin + m.start()
            if m[1] or m[2]:
                code = int(m[1], 16) if m[1] else int(m[2][:12])
                if not m[3]:
                    self.say(at, "CharRef: expecting ';'")
                elif not (code in (9, 10, 13) or 32 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF):
                    self.say(at, f"CharRef: xmlChar 0x{code:X} out of allowed range")
            elif not m[4]:
                self.say(at, "EntityRef: no name")
            elif not m[5]:
                self.say(at, "EntityRef: expecting ';'")
            elif m[4] not in self.entities:
                self.say(at, f"Entity '{_shown(m[4])}' not defined")

    def _other(self, m: re.Match) -> None:
        text, at = m.group(), m.start()
        if text.startswith(b"<!--"):
            if not m[1]:
                self.cut = True
                self.say(at, "Comment not terminated")
            elif b"--" in text[4:-3] or text[-4:-3] == b"-":
                self.say(at, "Double hyphen within comment")
        elif text.startswith(b"<![CDATA["):
            if not m[2]:
                self.cut = True
                self.say(at, "CData section not finished")
            elif not self.stack:
                self._extra(at) if self.rooted else self.say(at, "Start tag expected, '<' not found")
        elif text.startswith(b"<?"):
            if not m[3]:
                self.cut = True
                self.say(at, "PI not terminated")
            elif re.match(rb"<\?xml\s", text) and at:
                self.say(at, "XML declaration allowed only at the start of the document")
        else:
            self.entities.update(_ENTITY.findall(text))
            if not (m[4] or m[5]):
                self.say(at, "DOCTYPE improperly terminated")

    def _start(self, m: re.Match) -> None:
        name, rest, at = m[7], m[8], m.start()
        empty = rest.endswith(b"/") and bool(m[9])
        if not self.stack:
            if self.rooted:
                self._extra(at)
            self.rooted = True
        if not re.fullmatch(_NAME, name):
            self.say(at, "StartTag: invalid element name")
        prefixes = self.stack[-1][2] if self.stack else frozenset([b"xml", b"xmlns"])
        names, declared = self._attributes(name, m.start(8), rest[:-1] if empty else rest)
        if declared:
            prefixes = prefixes | declared
        for n in (name, *names):
            prefix, colon, _ = n.partition(b":")
            if colon and prefix not in prefixes:
                self.say(at, f"Namespace prefix {_shown(prefix)} is not defined")
        if not m[9]:
            if m[10]:
                self.cut = True
            self.say(at, f"Couldn't find end of Start Tag {_shown(name)} line {self.data.count(b'\n', 0, at) + 1}")
        if not empty:
            self.stack.append((name, at, prefixes))
            self.opened[name] += 1

    def _attributes(self, tag: bytes, begin: int, rest: bytes) -> tuple[list[bytes], frozenset[bytes]]:
        names: list[bytes] = []
        declared = set()
        if not rest.strip():
            return names, frozenset()
        for m in _ATTRIBUTE.finditer(rest):
            at, name = begin + m.start() + len(m[1]), m[2]
            if name is None:
                if m[5] and (not names or names[-1] is not None):
                    self.say(at, "attributes construct error")
                continue
            if not m[1]:
                if names and names[-1] is None:
                    continue
                self.say(at, "attributes construct error")
            if m[3] is None or m[4] is None:
                self.say(at, f"Specification mandates value for attribute {_shown(name)}" if m[3] is None else "AttValue: \" or ' expected")
                names.append(None)
                continue
            if name in names:
                self.say(at, f"Attribute {_shown(name)} redefined")
            names.append(name)
            value = m[4][1:-1]
            self._values(begin + m.start(4) + 1, value)
            if name == b"xmlns" or name.startswith(b"xmlns:"):
                declared.add(name[6:])
                if value and b":" not in value:
                    self.say(at, f"xmlns: URI {_shown(value)} is not absolute")
        return [n for n in names if n is not None], frozenset(declared)

    def _end(self, m: re.Match) -> None:
        name, at = m[7], m.start()
        if not m[9] or m[8].strip():
            self.say(m.end(7), "expected '>'")
        if self.stack and self.stack[-1][0] == name:
            self.opened[self.stack.pop()[0]] -= 1
        elif not self.stack:
            self._extra(at)
        else:
            top, begun, _ = self.stack[-1]
            self.say(at, f"Opening and ending tag mismatch: {_shown(top)} line {self.data.count(b'\n', 0, begun) + 1} and {_shown(name)}")
            while self.stack:  # back to the element that it ends, or only over the one it takes the place of
                last = self.stack.pop()[0]
                self.opened[last] -= 1
                if last == name or not self.opened[name]:
                    break


def _shown(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _as_utf8(data: bytes) -> tuple[bytes, list[tuple[int, str]]]:
    """The document in UTF-8, and what is wrong with its encoding."""
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace").encode(), []
    m = _DECLARATION.match(data)
    if m and m[1].lower() not in (b"utf-8", b"utf8", b"us-ascii", b"ascii"):
        try:
            name = codecs.lookup(m[1].decode()).name
        except LookupError:
            return data, [(m.start(1), f"Unsupported encoding {_shown(m[1])}")]
        if name.startswith(("utf-16", "utf-32")):
            return data, [(m.start(1), "Document labelled with another encoding than it has")]
        return data.decode(name, "replace").encode(), []
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data, [(e.start, "Input is not proper UTF-8, indicate encoding !")]
    return data, []


def _placed(data: bytes, out: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
    breaks = [m.start() for m in re.finditer(b"\n", data)]
    for at, message in sorted(set(out)):
        if message.startswith("Premature end of data in tag"):
            yield len(breaks) + 1, 1, message
            continue
        line = bisect_left(breaks, at)
        begin = breaks[line - 1] + 1 if line else 0
        yield line + 1, len(data[begin:at].decode("utf-8", "replace")) + 1, message


def xml_faults(data: bytes) -> list[tuple[int, int, str]]:
    """(line, column, message) of every fault of a document, in order."""
    data = data.removeprefix(codecs.BOM_UTF8)
    if not data.strip():
        return [(1, 1, "Document is empty")]
    data, wrong = _as_utf8(data)
    document = _Document(data)
    document.walk()
    return list(_placed(data, wrong + document.out))
