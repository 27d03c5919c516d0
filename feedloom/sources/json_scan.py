"""JSON documents by chunks: values at a path or records by rule, and the first fault with its place.

The structural index of a chunk (where quotes, brackets, colons and commas stand that no string holds) comes from the parity of quotes
that no backslash escapes, for both cases of the start: outside and inside a string. A chunk's effect is the brackets it closes and
opens, with the names of what it opens, and the string that is open at its end. With the state at its start a chunk is scanned alone:
whole values are checked by the JSON decoder in C, only what encloses them and what it refuses is walked token by token.

What a document has before its first fault is kept. Keys of objects that span chunks meet in a grouping by object and key.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any, NamedTuple

import numpy as np

from feedloom.sources.ranges import Place, Start

MARK = b","
#: Characters that a number or name may have; longer ones are a fault.
TOKEN_LIMIT = 4097
_SPACE = b" \t\n\r"
_STRING = re.compile(rb'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"')
_END = re.compile(rb'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"')
_BARE = re.compile(rb'[^ \t\n\r"{}\[\]:,]++')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?")
_LONG = re.compile(rb'[^ \t\n\r"{}\[\]:,]{4098}')
_BLANK = re.compile(rb"[ \t\n\r]*+")


class Level(NamedTuple):
    """An open object or list: its bracket, its name in the object around it (None in a list), the chunk and the place it began in."""

    kind: str
    name: str | None
    chunk: int
    place: Place


class State(NamedTuple):
    """What is open where a chunk begins: levels from the outermost, and the string, if any, with its role and what came of it.

    The role is key, value, or what is wanted in place of the string. ``name`` is that of a value.
    """

    levels: tuple[Level, ...] = ()
    begun: bool = False
    in_string: bool = False
    role: str = ""
    name: str | None = None
    string_chunk: int = 0
    string_place: Place = Place()
    string: bytes = b""


class Index:
    """Structural places of a chunk, for a start outside or inside a string."""

    def __init__(self, data: bytes, in_string: bool) -> None:
        self.data, array = data, np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(array == 34)
        behind = quotes[(quotes > 0) & (array[np.maximum(quotes - 1, 0)] == 92)]
        if len(behind):  # escaped by an odd run of backslashes
            others = np.flatnonzero(array != 92)
            before = np.searchsorted(others, behind) - 1
            runs = behind - 1 - np.where(before >= 0, others[np.maximum(before, 0)], -1)
            quotes = np.setdiff1d(quotes, behind[runs % 2 == 1], assume_unique=True)
        self.quotes = quotes
        marks = np.flatnonzero(_STRUCTURAL[array])
        self.marks = marks[(np.searchsorted(quotes, marks) + in_string) % 2 == 0]
        self.kinds = array[self.marks]
        self.ends_in_string = bool((len(quotes) + in_string) % 2)

    @cached_property
    def depth(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of brackets, and how many are open after each, from 0 at the start."""
        brackets = (self.kinds != 44) & (self.kinds != 58)
        at, kinds = self.marks[brackets], self.kinds[brackets]
        return at, np.cumsum(np.where((kinds == 123) | (kinds == 91), 1, -1))

    @cached_property
    def _lower(self) -> dict[int, np.ndarray]:
        at, depth = self.depth
        by = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[by])) + 1
        return {int(depth[g[0]]): g for g in np.split(by, cuts) if len(g)}

    def closing(self, at: int) -> int | None:
        """The place of the bracket that closes the one at ``at``, if it is in the chunk."""
        places, depth = self.depth
        i = int(np.searchsorted(places, at))
        return self.below(int(depth[i]) - 1, i)

    def below(self, level: int, after: int = -1) -> int | None:
        """The place after bracket number ``after`` where the depth first falls to ``level``."""
        group = self._lower.get(level)
        if group is None:
            return None
        k = int(np.searchsorted(group, after, side="right"))
        return int(self.depth[0][group[k]]) if k < len(group) else None


#: Bytes up to which brackets are matched without an index of arrays, which costs as much for few bytes as for thousands.
_SHORT = 2048
_QUOTED = re.compile(rb'(\\++)("?)|["{}\[\]]')


def _matched(data: bytes, in_string: bool) -> dict[int, int]:
    """The place of each bracket that closes one in a short chunk, by the place of that one, as ``Index.closing`` has it."""
    out, still = {}, []
    for m in _QUOTED.finditer(data):
        if m[1] is not None:  # backslashes: an odd number of them escapes a quote
            in_string ^= bool(m[2]) and len(m[1]) % 2 == 0
        elif m[0] == b'"':
            in_string = not in_string
        elif in_string:
            continue
        elif m[0] in b"{[":
            still.append(m.start())
        elif still:
            out[still.pop()] = m.start()
    return out


_STRUCTURAL = np.zeros(256, bool)
_STRUCTURAL[list(b"{}[]:,")] = True


def _key(raw: bytes) -> str:
    """A key by what is between its quotes."""
    try:
        return json.loads(b'"%s"' % raw, strict=False)
    except ValueError:
        return raw.decode("utf-8", "replace")


def _named_before(data: bytes, index: Index, colon: int) -> tuple[str | bytes | None, bool]:
    """The key before a colon, and whether it is the end of one that began before the chunk."""
    close = int(np.searchsorted(index.quotes, colon)) - 1
    if close >= 1:
        return _key(data[index.quotes[close - 1] + 1 : index.quotes[close]]), False
    return (data[: index.quotes[0]], True) if close == 0 else (None, False)


def _one_effect(data: bytes, in_string: bool) -> tuple:
    """(brackets closed, levels opened (kind, name, name goes on from the start, place), string at the end or None).

    The string: the mark before it (none: the start), whether something stands between, its place, its bytes, its name as above.
    """
    index = Index(data, in_string)
    at, depth = index.depth
    closed = -min(0, int(depth.min(initial=0)))
    opened = []
    if len(at):
        least = np.minimum.accumulate(depth[::-1])[::-1]
        kinds = np.frombuffer(data, np.uint8)[at]
        still = np.flatnonzero(((kinds == 123) | (kinds == 91)) & (least >= depth) & (depth > -closed))
        for i in still.tolist():
            place = int(at[i])
            before = int(np.searchsorted(index.marks, place)) - 1
            name, joined = None, False
            if before >= 0 and index.kinds[before] == 58:
                name, joined = _named_before(data, index, int(index.marks[before]))
            opened.append((chr(data[place]), name, joined, Place().after(data, place)))
    string = None
    if index.ends_in_string:
        if len(index.quotes):
            start = int(index.quotes[-1])
            before = int(np.searchsorted(index.marks, start)) - 1
            mark = chr(index.kinds[before]) if before >= 0 else ""
            between = bool(data[index.marks[before] + 1 if mark else 0 : start].strip(_SPACE))
            named = _named_before(data, index, int(index.marks[before])) if mark == ":" else (None, False)
            string = (mark, between, Place().after(data, start), data[start + 1 :], named)
        else:
            string = (None, False, None, data, (None, False))
    return closed, opened, string


def effect(data: bytes) -> tuple:
    """What a chunk does to the state, outside and inside a string at its start."""
    return _one_effect(data, False), _one_effect(data, True)


def step(state: State, effects: tuple, start: Start) -> State:
    """The state after a chunk, as long as there is no fault."""
    closed, opened, string = effects[state.in_string]
    levels = list(state.levels[: max(0, len(state.levels) - closed)])
    for kind, name, joined, place in opened:
        if joined:
            name = _key(state.string + name)
        levels.append(Level(kind, name, start.number, start.place.moved(place)))
    if string is None:
        return State(tuple(levels), True)
    mark, between, place, rest, (name, joined) = string
    if mark is None:  # the string that was open goes on
        return state._replace(string=state.string + rest if state.role != "value" else b"")
    top = levels[-1].kind if levels else ""
    after = "end" if not levels else "object comma" if top == "{" else "list comma"
    if mark == "" and not start.number and not state.begun and not between:
        role = "value"  # a document that is a string
    elif mark in ("}", "]") or not levels:
        role = after
    elif between:
        keyed = mark in ("{", ",") or mark == "" and (not state.in_string or state.role == "key")
        role = "colon" if top == "{" and keyed else after
    else:
        role = "value" if mark == ":" or top == "[" else "key"
    name = _key(state.string + name) if joined else name
    return State(tuple(levels), True, True, role, name, start.number, start.place.moved(place), rest if role != "value" else b"")


BEGIN = State()


class Fault(Exception):
    """The first fault of a document."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


class Repeated(ValueError):
    pass


def _pairs(pairs: list) -> None:
    if len(dict(pairs)) != len(pairs):
        raise Repeated


def _refused(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_refused)


def _sound(raw: bytes) -> bool:
    """Whether the decoder takes a value as a whole; False only says that it has to be walked."""
    if len(raw) > TOKEN_LIMIT and _LONG.search(raw):
        return False
    try:
        _decoder.decode(raw.decode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return False
    return True


#: The messages, as users know them. By what is wanted, then the token that is there.
_GOT = {
    "first key": "Expected object key or '}}', got '{}'",
    "key": "Expected object key, got '{}'",
    "colon": "Expected ':', got '{}'",
    "value": "Expected value, got '{}'",
    "object comma": "Expected ',' or '}}', got '{}'",
    "first item": "Expected array element or ']', got '{}'",
    "item": "Expected array element, got '{}'",
    "list comma": "Expected ',' or ']', got '{}'",
    "root": "Unexpected token '{}' at start of document",
    "end": "Unexpected token '{}' after valid JSON document",
}
_TRAILING = {"key": "Trailing comma inside object is not allowed", "item": "Trailing comma inside array is not allowed"}
_TOO_LONG = "Token buffer limit exceeded"
_OPEN_STRING = "Unclosed string at end of document"
_OPEN_ESCAPE = "Incomplete escape sequence at end of document"
_OPEN_LEVEL = "Unclosed structure: missing closing match for '{}'"
_NOTHING = "Empty or whitespace-only JSON document"
_UNFINISHED = "Incomplete JSON document structure"

Rule = Callable[[list[Level], str | None, str], bool]


def in_lists(levels: list[Level], name: str | None, kind: str) -> bool:
    """The rule of merged feeds: an object that is an item of a list, the outermost of such."""
    return kind == "{" and bool(levels) and levels[-1].kind == "["


def at_path(path: str) -> Rule:
    """Values at a path of names joined by dots, with ``item`` for the items of a list."""
    wanted = path.split(".") if path else []

    def rule(levels: list[Level], name: str | None, kind: str) -> bool:
        if len(levels) != len(wanted):
            return False
        parents = [*levels[1:], Level(kind, name, 0, Place())] if levels else []
        return all(("item" if outer.kind == "[" else inner.name) == want for outer, inner, want in zip(levels, parents, wanted, strict=True))

    return rule


def _nothing(levels: list[Level], name: str | None, kind: str) -> bool:
    return False


class Found(NamedTuple):
    """What a chunk gives: a whole value, a part of one that began in chunk ``owner`` (``ends`` it or not), a key, or the fault.

    ``declared`` are the prefixes that elements around an XML element declare, with its first part.
    """

    what: str
    data: bytes = b""
    owner: int = 0
    ends: bool = False
    scope: int = 0
    place: Place = Place()
    declared: bytes = b""


class Walk:
    """One chunk, from its state on. With a ``rule`` the values that it names are found, without one every token is checked."""

    def __init__(self, data: bytes, start: Start, rule: Rule | None) -> None:
        self.data, self.start, self.rule = data, start, rule or _nothing
        self.checks = rule is None
        self.state: State = start.state
        self.levels: list[Level] = list(self.state.levels)
        self.outer = len(self.levels)  # levels that other chunks began, as many as are still open
        self.names: list[set[str] | None] = [None] * len(self.levels)
        self.keys: list[list[tuple[str, int]]] = [[] for _ in self.levels]
        self.tried: list[int] = [1 << 62] * len(self.levels)  # sizes of enclosing values that the decoder refused
        self.key: str | None = None

    @cached_property
    def index(self) -> Index:
        return Index(self.data, self.state.in_string)

    @cached_property
    def _closing(self) -> Callable[[int], int | None]:
        return _matched(self.data, self.state.in_string).get if len(self.data) <= _SHORT else self.index.closing

    def place(self, at: int) -> Place:
        return self.start.place.after(self.data, at)

    def found(self) -> Iterator[Found]:
        try:
            yield from self._walk()
        except Fault as fault:
            yield Found("fault", fault.message.encode("utf-8", "replace"), place=self.place(fault.at) if fault.at >= 0 else self.state.string_place)
        if self.checks and not (self.start.last and not self.start.number):
            for level, keys in zip(self.levels, self.keys, strict=True):
                yield from self._open_keys(level, keys)

    def _open_keys(self, level: Level, keys: list[tuple[str, int]]) -> Iterator[Found]:
        """Keys of an object that goes beyond the chunk."""
        place, last = self.start.place, 0
        for name, at in keys:
            if at >= 0:
                place, last = place.after(self.data[last:at], at - last), at
            yield Found("key", name.encode("utf-8", "surrogatepass"), scope=level.place.offset, place=place if at >= 0 else self.state.string_place)

    def _captured(self) -> tuple[int, int] | None:
        """(number of levels around, chunk it began in) of the value in which the chunk begins, if the rule names it."""
        for i, level in enumerate(self.levels):
            if self.rule(self.levels[:i], level.name, level.kind):
                return i, level.chunk
        if self.state.in_string and self.state.role == "value" and self.rule(self.levels, self.state.name, '"'):
            return len(self.levels), self.state.string_chunk
        return None

    def _walk(self) -> Iterator[Found]:
        data, state, at = self.data, self.state, 0
        inside = self._captured()
        if inside is not None:
            around, owner = inside
            if around == len(self.levels):
                stop = int(self.index.quotes[0]) if len(self.index.quotes) else None
            else:
                stop = self.index.below(around - len(self.levels))
            yield Found("part", data if stop is None else data[: stop + 1], owner, stop is not None)
            if stop is None:
                self._cut(around)
                return
            del self.levels[around:], self.names[around:], self.keys[around:], self.tried[around:]
            self.outer = min(self.outer, around)
            at, want = stop + 1, self._after_value()
        elif state.in_string:
            m = _END.match(data)
            if m is None:
                self._string_fault(0)
                return
            at, text = m.end(), state.string + data[: m.end() - 1]
            if state.role == "key":
                self._named(_key(text), -1)
                want = "colon"
            elif state.role == "value":
                want = self._after_value()
            else:
                raise Fault(-1, _GOT[state.role].format(_key(text)))
        elif not state.begun:
            want = "root"
            at = 3 if data.startswith(b"\xef\xbb\xbf") else 0
        else:
            want = "end" if not self.levels else "key" if self.levels[-1].kind == "{" else "item"
            if not self.levels:
                raise Fault(0, _GOT["end"].format(","))
        yield from self._tokens(at, want)

    def _cut(self, around: int) -> None:
        """The chunk ends inside a value with so many levels around it, which no document may."""
        if self.start.last:
            kinds = [x.kind for x in self.levels[around:]] or ["{"]
            raise Fault(len(self.data), _OPEN_LEVEL.format(kinds[-1]))

    def _after_value(self) -> str:
        return "end" if not self.levels else "object comma" if self.levels[-1].kind == "{" else "list comma"

    def _named(self, name: str, at: int) -> None:
        """A key of the innermost object; those of objects within the chunk must differ at once."""
        self.key = name
        if not self.checks:
            return
        if len(self.levels) <= self.outer:
            self.keys[-1].append((name, at))
            return
        names = self.names[-1]
        if name in names:
            raise Fault(at, f"Duplicate object key '{name}'")
        names.add(name)
        self.keys[-1].append((name, at))

    def _string_fault(self, at: int) -> None:
        """What is wrong with the string whose content begins at ``at``; nothing if it goes on in the next chunk."""
        data = self.data
        while True:
            c = data[at : at + 1]
            if not c:
                if self.start.last:
                    raise Fault(self.begun_at, _OPEN_STRING)
                return
            if c == b'"':
                return
            if c == b"\\":
                if at + 1 == len(data):
                    raise Fault(self.begun_at, _OPEN_STRING)
                kind = data[at + 1 : at + 2]
                if kind not in b'"\\/bfnrtu':
                    raise Fault(at + 1, f"Invalid escape character: '\\{data[at + 1 : at + 5].decode('utf-8', 'replace')[:1]}'")
                at += 2
                if kind == b"u":
                    for _ in range(4):
                        digit = data[at : at + 1]
                        if not digit:
                            raise Fault(self.begun_at, _OPEN_STRING)
                        if digit not in b"0123456789abcdefABCDEF":
                            raise Fault(at, f"Invalid hex digit in unicode escape sequence: '{data[at : at + 4].decode('utf-8', 'replace')[:1]}'")
                        at += 1
                continue
            if c[0] < 32:
                raise Fault(at, "Control characters must be escaped in string literals")
            at += 1

    #: Where the string that is walked begins; before the chunk if negative.
    begun_at = -1

    def _tokens(self, at: int, want: str) -> Iterator[Found]:
        data, size = self.data, len(self.data)
        while True:
            at = _BLANK.match(data, at).end()
            if at == size:
                break
            c = data[at : at + 1]
            if c == b'"':
                m = _STRING.match(data, at)
                if m is None:
                    self.begun_at = at
                    self._string_fault(at + 1)
                    if want in ("value", "item", "first item", "root") and self.rule(self.levels, self.key if want == "value" else None, '"'):
                        yield Found("part", data[at:], self.start.number, False)
                    return  # goes on in the next chunk
                raw, kind, stop = m.group(), '"', m.end()
            elif c in b"{}[]:,":
                raw, kind, stop = c, c.decode(), at + 1
            else:
                m = _BARE.match(data, at)
                raw, kind, stop = m.group(), "0", m.end()
                if len(raw) > TOKEN_LIMIT and len(raw.decode("utf-8", "replace")) > TOKEN_LIMIT:
                    raise Fault(at, _TOO_LONG)
                if data[stop : stop + 1] == b'"':
                    raise Fault(stop, "Unexpected '\"' in document")
                if raw not in (b"true", b"false", b"null") and not _NUMBER.fullmatch(raw):
                    raise Fault(at, f"Invalid token '{raw.decode('utf-8', 'replace')}'")
            if want in ("key", "first key") and kind == '"':
                self._named(_key(raw[1:-1]), at)
                want, at = "colon", stop
            elif want == "colon" and kind == ":":
                want, at = "value", stop
            elif want in ("value", "item", "first item", "root") and kind in '"0{[':
                name = self.key if want == "value" else None
                named = self.rule(self.levels, name, kind)
                if kind in "{[":
                    close = self._closing(at)
                    if named:
                        if close is None:
                            yield Found("part", data[at:], self.start.number, False)
                            self._cut(len(self.levels))
                            return
                        yield Found("value", data[at : close + 1])
                        want, at = self._after_value(), close + 1
                        continue
                    most = self.tried[-1] // 2 if self.tried else 1 << 62
                    if self.checks and close is not None and close + 1 - at <= most and _sound(data[at : close + 1]):
                        want, at = self._after_value(), close + 1
                        continue
                    self.levels.append(Level(kind, name, self.start.number, Place(self.start.place.offset + at)))
                    self.names.append(set())
                    self.keys.append([])
                    self.tried.append(1 << 62 if close is None else close + 1 - at)
                    want, at = "first key" if kind == "{" else "first item", stop
                else:
                    if named:
                        yield Found("value", raw)
                    want, at = self._after_value(), stop
            elif want.endswith("comma") and kind == ",":
                want, at = "key" if self.levels[-1].kind == "{" else "item", stop
            elif kind == "}" and want in ("first key", "object comma") or kind == "]" and want in ("first item", "list comma"):
                level, keys = self.levels.pop(), self.keys.pop()
                self.names.pop()
                self.tried.pop()
                if self.checks and len(self.levels) < self.outer:
                    yield from self._open_keys(level, keys)
                self.outer = min(self.outer, len(self.levels))
                self.key = None
                want, at = self._after_value(), stop
            elif kind in "}]" and want in _TRAILING and (kind == "}") == (want == "key"):
                raise Fault(at, _TRAILING[want])
            else:
                got = _key(raw[1:-1]) if kind == '"' else raw.decode("utf-8", "replace")
                raise Fault(at, _GOT[want].format(got))
        if not self.start.last:
            return
        if want == "root":
            raise Fault(0, _NOTHING)
        if self.levels:
            raise Fault(size, _OPEN_LEVEL.format(self.levels[-1].kind))
        if want != "end":
            raise Fault(size, _UNFINISHED)


def values(data: bytes, rule: Rule) -> list[Any]:
    """The values of a whole document that ``rule`` names, up to its first fault: raw JSON of each."""
    return [f.data for f in Walk(data, Start(Place(), BEGIN, 0, True, True), rule).found() if f.what == "value"]


def first_fault(data: bytes) -> tuple[int, int, str] | None:
    """(line, column, message) of the first fault of a whole document."""
    whole = data.strip(_SPACE)
    if whole[:1] in (b"{", b"[") and _sound(whole):
        return None
    for f in Walk(data, Start(Place(), BEGIN, 0, True, True), None).found():
        if f.what == "fault":
            return f.place.line, f.place.column, f.data.decode()
    return None
