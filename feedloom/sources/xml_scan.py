"""XML documents by chunks: elements at a path or by name, with their raw text, also from documents with faults.

Chunks end with ``>``, which may stand in text, in a comment, a CDATA section, an instruction, a document type or the value of an
attribute. A chunk's effect is found for each of these starts: the mode at its end and the tags that it leaves open or closes, after
tags that meet in the chunk have cancelled each other. That is exact for documents with faults too, as a closing tag that meets nothing
in the chunk stays in the list: it ends the nearest open element of its name, or nothing where there is none.

Raw text is the source's, with the prefixes declared that the element takes from elements around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from feedloom.sources.json_scan import Found
from feedloom.sources.ranges import Place, Start

MARK = b">"
_REST = rb"""[^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+"""
_OPEN_VALUE = rb"""("[^"<]*+|'[^'<]*+)\Z"""
_TOKEN = re.compile(
    rb"<!--(?:.*?(-->)|.*\Z)|<!\[CDATA\[(?:.*?(\]\]>)|.*\Z)|<\?(?:.*?(\?>)|.*\Z)|<!DOCTYPE(?:[^\[>]*+(?:\[(?:.*?\]\s*+(>)|.*\Z)|(>))?)"
    rb"|<(/?)([^\s/><!?&\"'=]++)(" + _REST + rb")(?:(>)|" + _OPEN_VALUE + rb")?",
    re.S,
)
_TAG_REST = re.compile(rb"(" + _REST + rb")(?:(>)|" + _OPEN_VALUE + rb")?", re.S)
_ENDS = {"comment": re.compile(rb"-->"), "cdata": re.compile(rb"\]\]>"), "pi": re.compile(rb"\?>"), "doctype": re.compile(rb"\]\s*>"), '"': re.compile(rb'["<]'), "'": re.compile(rb"['<]")}
_DECLARED = re.compile(rb"""\sxmlns:([^\s=]+)\s*=\s*("[^"<]*"|'[^'<]*')""")
_PREFIX = re.compile(rb"[<\s/]([^\s<>/=:\"'&;]+):[^\s<>/=:\"'&;]")

Names = tuple[tuple[bytes, bytes], ...]


class Tag(NamedTuple):
    """What a chunk leaves: an opened or closed element, or (``rest``) the end of a start tag that began before it."""

    kind: str
    name: bytes = b""
    at: int = 0
    stop: int = 0
    declared: Names = ()
    empty: bool = False


class Level(NamedTuple):
    """An open element: its name, the prefixes it declares, the chunk it began in."""

    name: bytes
    declared: Names
    chunk: int


class State(NamedTuple):
    """What is open where a chunk begins; ``pending`` is the start tag in whose attribute it begins."""

    levels: tuple[Level, ...] = ()
    mode: str = "text"
    pending: Level | None = None


BEGIN = State()


def _names(attributes: bytes) -> Names:
    return tuple(_DECLARED.findall(attributes)) if b"xmlns:" in attributes else ()


def tags(data: bytes, mode: str) -> Iterator[Tag]:
    """The tags of a chunk that begins in ``mode``; at the end one named after the mode in which it ends."""
    at = 0
    if mode in _ENDS:
        m = _ENDS[mode].search(data)
        if m is None:
            yield Tag("mode", mode.encode())
            return
        at = m.end()
        if mode in "\"'":
            if m.group() == b"<":  # the value never ends: neither does its tag
                at = m.start()
                yield Tag("rest", b"", 0, at)
            else:
                m = _TAG_REST.match(data, at)
                if m[3]:
                    yield Tag("mode", m[3][:1], declared=_names(m[1] + b" "))
                    return
                at = m.end()
                yield Tag("rest", b"", 0, at, _names(data[:at]), m[1].endswith(b"/"))
    for m in _TOKEN.finditer(data, at):
        name = m[7]
        if name is not None:
            rest = m[8]
            if m[6]:
                yield Tag("close", name, m.start(), m.end())
            elif m[10]:
                yield Tag("open tag", name, m.start(), m.end(), _names(rest))
                yield Tag("mode", m[10][:1])
                return
            else:
                yield Tag("open", name, m.start(), m.end(), _names(rest), rest.endswith(b"/"))
        elif not any(m.group(i) for i in (1, 2, 3, 4, 5)):
            text = m.group()
            kind = "comment" if text.startswith(b"<!--") else "cdata" if text.startswith(b"<![") else "pi" if text.startswith(b"<?") else "doctype"
            if kind != "doctype" or b"[" in text:
                yield Tag("mode", kind.encode())
                return
    yield Tag("mode", b"text")


def _one_effect(data: bytes, mode: str) -> tuple[str, list[tuple], Names]:
    """(mode at the end, tags that do not cancel, prefixes that a start tag declares which goes on through the chunk)."""
    left: list[tuple] = []
    for tag in tags(data, mode):
        if tag.kind == "mode":
            return tag.name.decode(), left, tag.declared
        if tag.kind == "close" and left and left[-1][0] == "open" and left[-1][1] == tag.name:
            left.pop()
        elif not tag.empty or tag.kind == "rest":
            left.append((tag.kind, tag.name, tag.declared, tag.empty))
    raise AssertionError


_MODES = ("text", *_ENDS)


def effect(data: bytes) -> dict[str, tuple]:
    """What a chunk does, by the mode at its start."""
    return {mode: _one_effect(data, mode) for mode in _MODES if mode == "text" or _ENDS[mode].search(data) is not None}


def _closed(levels: list[Level], name: bytes) -> int | None:
    """How many levels stay when ``name`` is closed; None if no such element is open."""
    if levels and levels[-1].name == name:
        return len(levels) - 1
    return next((i for i in range(len(levels) - 1, -1, -1) if levels[i].name == name), None)


def step(state: State, effects: dict[str, tuple], start: Start) -> State:
    """The state after a chunk."""
    if state.mode not in effects:
        return state
    mode, left, declared = effects[state.mode]
    levels, pending = list(state.levels), state.pending
    if pending is not None and declared:
        pending = pending._replace(declared=pending.declared + declared)
    for kind, name, names, empty in left:
        if kind == "open":
            levels.append(Level(name, names, start.number))
        elif kind == "open tag":
            pending = Level(name, names, start.number)
        elif kind == "rest":
            if pending is not None and not empty:
                levels.append(pending._replace(declared=pending.declared + names))
            pending = None
        elif (stay := _closed(levels, name)) is not None:
            del levels[stay:]
    return State(tuple(levels), mode, pending)


Rule = Callable[[list[bytes]], bool]


def local(name: bytes) -> str:
    return name.rpartition(b":")[2].decode("utf-8", "replace")


def named(names: tuple[str, ...]) -> Rule:
    """Elements with one of these local names, in any case."""
    return lambda path: local(path[-1]).lower() in names


def at_path(path: str) -> Rule:
    """Elements at a full path (/a/b), or whose path ends in these names (//a/b or a/b)."""
    wanted = [n for n in path.split("/") if n]
    whole = path.startswith("/") and not path.startswith("//")

    def rule(levels: list[bytes]) -> bool:
        if len(levels) != len(wanted) if whole else len(levels) < len(wanted):
            return False
        return [local(n) for n in levels[len(levels) - len(wanted) :]] == wanted

    return rule


def _with_prefixes(raw: bytes, around: list[Level]) -> bytes:
    """``raw`` with the prefixes that elements around it declare, where it uses them."""
    if not any(level.declared for level in around):
        return raw
    known = {k: v for level in around for k, v in level.declared}
    first = _TOKEN.match(raw)
    own = {k for k, _ in _names(first[8])} if first and first[8] else set()
    used = sorted({p for p in _PREFIX.findall(raw) if p in known} - own)
    at = 1 + len(first[7]) if first and first[7] else 0
    return raw[:at] + b"".join(b" xmlns:%s=%s" % (p, known[p]) for p in used) + raw[at:] if used and at else raw


class Walk:
    """One chunk, from its state on: the elements that ``rule`` names, the outermost of them."""

    def __init__(self, data: bytes, start: Start, rule: Rule) -> None:
        self.data, self.start, self.rule = data, start, rule
        self.levels: list[Level] = list(start.state.levels)
        self.inside: int | None = None  # levels around the element that is captured
        self.owner = 0
        for i in range(len(self.levels)):
            if rule([x.name for x in self.levels[: i + 1]]):
                self.inside, self.owner = i, self.levels[i].chunk
                break

    def found(self) -> Iterator[Found]:
        data, state, began = self.data, self.start.state, 0
        pending, names = state.pending, [x.name for x in self.levels]
        if self.inside is None and pending is not None and self.rule([*names, pending.name]):
            self.inside, self.owner = len(names), pending.chunk
        mine = False  # the captured element began in this chunk
        around: list[Level] = self.levels[: self.inside] if self.inside is not None else []
        for tag in tags(data, state.mode):
            if tag.kind == "mode":
                break
            if tag.kind == "open tag":
                pending = Level(tag.name, tag.declared, self.start.number)
                if self.inside is None and self.rule([*names, tag.name]):
                    self.inside, began, mine, self.owner, around = len(names), tag.at, True, self.start.number, list(self.levels)
                continue
            end = None
            if tag.kind == "open" or tag.kind == "rest":
                level = Level(tag.name, tag.declared, self.start.number) if tag.kind == "open" else pending
                if level is None:
                    continue
                if tag.kind == "rest":
                    level, pending = level._replace(declared=level.declared + tag.declared), None
                if self.inside is None and self.rule([*names, level.name]):
                    self.inside, began, mine, self.owner, around = len(names), tag.at, True, self.start.number, list(self.levels)
                if not tag.empty:
                    self.levels.append(level)
                    names.append(level.name)
                elif self.inside == len(names):
                    end = tag.stop
            else:
                stay = _closed(self.levels, tag.name)
                if stay is None:
                    continue
                if self.inside is not None and stay <= self.inside:
                    end = tag.stop if stay == self.inside else tag.at  # an element around it is closed
                del self.levels[stay:], names[stay:]
            if end is not None:
                if mine:
                    yield Found("value", _with_prefixes(data[began:end], around))
                else:
                    yield Found("part", data[:end], self.owner, True)
                self.inside, mine = None, False
        if self.inside is not None:
            declared = b"".join(b" xmlns:%s=%s" % x for level in around for x in level.declared) if mine else b""
            yield Found("part", data[began:] if mine else data, self.owner, declared=declared)


def joined(raw: bytes, declared: bytes) -> bytes:
    """An element that was put together from parts, with the prefixes declared that it takes from around it."""
    return _with_prefixes(raw, [Level(b"", _names(declared), 0)])


def values(data: bytes, rule: Rule) -> list[bytes]:
    """The raw text of the elements of a whole document that ``rule`` names."""
    return [f.data for f in Walk(data, Start(Place(), BEGIN, 0, True, True), rule).found() if f.what == "value"]


class Node:
    """An element of a record: local name, attributes by local name, children, text before each child and at the end."""

    __slots__ = ("attributes", "children", "name", "text")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children, self.text = name, attributes, [], [""]

    def all_text(self) -> str:
        """The text of the element and of all in it, in order."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            for i in range(len(node.text) - 1, -1, -1):
                stack.append(node.text[i])
                if i:
                    stack.append(node.children[i - 1])
        return "".join(out)


def _short(name: str) -> str:
    return name.rpartition(":")[2]


def parsed(raw: bytes) -> Node:
    """The tree of a record; of one with faults what its tags and text tell."""
    return tree_of(raw)[0]


def tree_of(raw: bytes) -> tuple[Node, bool]:
    """The tree of a record, and whether it has no faults."""
    root, sound = Node("", {}), True
    stack = [root]

    def opened(name: str, attributes: dict[str, str]) -> None:
        node = Node(_short(name), {_short(k): v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")})
        stack[-1].children.append(node)
        stack[-1].text.append("")
        stack.append(node)

    def said(text: str) -> None:
        stack[-1].text[-1] += text

    parser = expat.ParserCreate(namespace_separator=":")  # the local name is behind the last colon, as in the source
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, lambda name: stack.pop(), said
    try:
        parser.Parse(raw.decode("utf-8", "replace").encode(), True)
    except expat.ExpatError:
        root, sound = Node("", {}), False
        stack[:] = [root]
        at = 0
        for m in _TOKEN.finditer(raw):
            said(unescape(raw[at : m.start()].decode("utf-8", "replace")))
            at, name = m.end(), m[7].decode("utf-8", "replace") if m[7] else None
            if m.group().startswith(b"<![CDATA["):
                said(m.group()[9 : -3 if m[2] else None].decode("utf-8", "replace"))
            elif name and not m[6]:
                opened(name, {k.decode("utf-8", "replace"): unescape(v[1:-1].decode("utf-8", "replace")) for k, v in re.findall(rb"""([^\s=/"']+)\s*=\s*("[^"<]*"|'[^'<]*')""", m[8])})
                if m[8].endswith(b"/"):
                    stack.pop()
            elif name and (i := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == _short(name)), None)):
                del stack[i:]
    return root.children[0] if root.children else root, sound


def _serialised(root: Node) -> str:
    """A tree as text, by local names."""
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, k = stack.pop()
        if not k:
            out.append(f"<{node.name}{''.join(f' {n}={quoteattr(v)}' for n, v in node.attributes.items())}>")
        out.append(escape(_LEGAL.sub("", node.text[k])))
        if k < len(node.children):
            stack += [(node, k + 1), (node.children[k], 0)]
        else:
            out.append(f"</{node.name}>")
    return "".join(out)


_LEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def record_of(raw: bytes) -> tuple[dict[str, str], str]:
    """Direct children by local name, the first of each, with all their text; and the raw text, written anew if it has faults."""
    root, sound = tree_of(raw)
    out: dict[str, str] = {}
    for child in root.children:
        out.setdefault(child.name, child.all_text().strip())
    return out, raw.decode("utf-8", "replace") if sound else _serialised(root)


def fields_of(raw: bytes) -> dict[str, str]:
    """Direct children by local name, the first of each, with all their text."""
    return record_of(raw)[0]
