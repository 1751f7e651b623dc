"""C# source files: a lexer, and the declarations and references that it finds.

Types, methods, constructors, properties and const fields at any depth become chunks, which overlap: a type's chunk has its members' text.
References are by name only; there is no binding of symbols as a compiler does it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

_LEX = re.compile(
    r"""(?P<trivia>\s+|//[^\n]*|/\*.*?\*/|(?<![^\n])[ \t]*\#[^\n]*)
    |(?P<string>\$*\"{3,}.*?\"{3,}|[$@]*@[$]*"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.[^']*|[^'\\\n])')
    |(?P<number>\d[\w.]*)
    |(?P<word>@?[^\W\d]\w*)
    |(?P<mark>=>|::|\?\.|\?\?=?|&&|\|\||[=!<>+\-*/%&|^]=|\+\+|--|->|.)""",
    re.X | re.S,
)
RESERVED = set(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false
    finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected
    public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using
    virtual void volatile while""".split()
)
MODIFIERS = set("public private protected internal static readonly abstract sealed virtual override async partial extern unsafe new const volatile required file ref fixed".split())
TYPES = {"class", "struct", "interface", "record"}
ACCESSORS = {"get", "set", "init", "add", "remove"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(text) if m.lastgroup != "trivia"]


@dataclass
class Declaration:
    kind: str
    name: str
    first: int  # tokens
    last: int
    body: tuple[int, int]
    signature: str
    types: tuple[str, ...]
    namespace: str
    bases: list[str] = field(default_factory=list)
    is_class: bool = False


class Parser:
    def __init__(self, text: str):
        self.text, self.t = text, lex(text)
        self.found: list[Declaration] = []
        self.skipped: set[int] = set()  # tokens that aren't expressions: names declared, attributes, base lists, signatures
        self.closing = self._pairs()
        self._members(0, len(self.t), "", ())

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for i, x in enumerate(self.t):
            if x.text in OPEN and x.kind == "mark":
                stack.append(i)
            elif x.text in CLOSE and x.kind == "mark" and stack:
                out[stack.pop()] = i
        for i in stack:
            out[i] = len(self.t) - 1
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].kind in ("mark", "word") and self.t[i].text in texts

    def _angles(self, i: int) -> int:
        """Past a list of type arguments that begins here, or the same place."""
        if not self._is(i, "<"):
            return i
        depth = 0
        for j in range(i, min(i + 400, len(self.t))):
            x = self.t[j]
            if x.kind == "mark":
                if x.text == "<":
                    depth += 1
                elif x.text == ">":
                    depth -= 1
                    if not depth:
                        return j + 1
                elif x.text in ";{})&&||":
                    return i
        return i

    def _source(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def _past(self, i: int, end: int) -> int:
        """Past the statement or block here."""
        while i < end:
            if self._is(i, "{"):
                i = self.closing[i] + 1
                if self._is(i, "="):  # an initialiser after accessors
                    continue
                return i
            if self._is(i, ";"):
                return i + 1
            i = self.closing[i] + 1 if self._is(i, "(", "[") else i + 1
        return end

    def _members(self, i: int, end: int, namespace: str, types: tuple[str, ...]) -> None:
        while i < end:
            first = i
            while self._is(i, "["):
                self.skipped.update(range(i, self.closing[i] + 1))
                i = self.closing[i] + 1
            start_modifiers = i
            while i < end and self.t[i].text in MODIFIERS and not (self.t[i].text == "new" and self._is(i + 1, "(")):
                i += 1
            modifiers = [x.text for x in self.t[start_modifiers:i]]
            if i >= end:
                return
            word = self.t[i].text
            if word == "namespace" and not types:
                j = i + 1
                while j < end and not self._is(j, "{", ";"):
                    j += 1
                name = ".".join(x for x in (namespace, self._source(i + 1, j)) if x)
                if self._is(j, "{"):
                    self._members(j + 1, self.closing[j], name, types)
                    i = self.closing[j] + 1
                else:
                    namespace, i = name, j + 1
            elif word in TYPES and i + 1 < end and (self.t[i + 1].kind == "word") and not (word == "record" and self._is(i + 2, "=", ";")):
                i = self._type(first, i, end, namespace, types)
            elif word in ("using", "extern", "enum", "delegate", "event") or word in ("}", ";"):
                j = i + 1 if word in "};" else self._past(i, end)
                if word in ("enum", "delegate"):
                    self.skipped.update(range(i, j))
                i = j
            else:
                i = self._member(first, i, end, namespace, types, modifiers)
            i = max(i, first + 1)

    def _type(self, first: int, i: int, end: int, namespace: str, types: tuple[str, ...]) -> int:
        is_class = self.t[i].text == "class"
        if self._is(i + 1, "struct", "class"):
            i += 1
        name = self.t[i + 1].text
        head = i
        i = self._angles(i + 2)
        if self._is(i, "("):
            i = self.closing[i] + 1
        bases = []
        if self._is(i, ":"):
            i += 1
            while i < end and not self._is(i, "{", ";", "where"):
                j = i
                while j < end and not self._is(j, ",", "{", ";", "where"):
                    j = self._angles(j) if self._is(j, "<") and self._angles(j) > j else (self.closing[j] + 1 if self._is(j, "(", "[") else j + 1)
                bases.append(self._source(i, j).split("(")[0].strip())
                i = j + 1 if self._is(j, ",") else j
        while i < end and not self._is(i, "{", ";"):
            i += 1
        close = self.closing.get(i, i) if self._is(i, "{") else i
        self.skipped.update(range(head, i + 1))
        self.found.append(Declaration("type", name, first, min(close, len(self.t) - 1), (i, close), f"{name} : {bases[0]}" if bases else name, types, namespace, bases, is_class))
        if self._is(i, "{"):
            self._members(i + 1, close, namespace, (*types, name))
        return close + 1

    def _member(self, first: int, i: int, end: int, namespace: str, types: tuple[str, ...], modifiers: list[str]) -> int:
        head, last_word = i, -1
        while i < end and not self._is(i, "(", "{", ";", "=", "=>", ","):
            if self.t[i].kind == "word":
                last_word = i
            if self._is(i, "operator", "this", "~"):
                return self._past(i, end)
            j = self._angles(i)
            i = j if j > i else (self.closing[i] + 1 if self._is(i, "[") else i + 1)
            if self._is(i, "(") and i == head + 0:
                break
        if self._is(i, "(") and last_word < 0:  # a tuple type
            i = self.closing[i] + 1
            if i < end and self.t[i].kind == "word":
                last_word, i = i, i + 1
        if i >= end or last_word < 0 or not types:
            return self._past(i, end) if i < end else end
        name, result = self.t[last_word].text, self._source(head, last_word)
        put = lambda kind, last, body, signature: self.found.append(Declaration(kind, name, first, last, body, signature, types, namespace))
        words = lambda *xs: " ".join(x for x in xs if x)
        after = self._past(i, end)
        if self._is(i, "("):
            close = self.closing[i]
            j = close + 1
            while j < end and not self._is(j, "{", "=>", ";"):
                j = self.closing[j] + 1 if self._is(j, "(", "[") else j + 1
            kind = "constructor" if not result else "method"
            # a constructor's call of another one is an expression, its parameters aren't
            self.skipped.update(range(head, close + 1))
            body = (j, after) if self._is(j, "{", "=>") else (first, after)
            put(kind, after - 1, body, words(*modifiers, result, f"{name}({self._parameters(i + 1, close)})"))
        elif self._is(i, "{", "=>"):
            self.skipped.update(range(head, i))
            self.skipped.update(k for k in range(i, after) if self.t[k].text in ACCESSORS and self._is(k + 1, ";", "{", "=>"))
            put("property", after - 1, (i, after), words(*modifiers, result, name))
        else:
            self.skipped.update(range(head, i))
            if "const" in modifiers:
                j = i
                while j < end and not self._is(j, ",", ";"):
                    j = self.closing[j] + 1 if self._is(j, "(", "[", "{") else j + 1
                put("field", after - 1, (last_word, last_word + 1), words(*modifiers, result, name) + self._source(i, j))
        return after

    def _parameters(self, i: int, end: int) -> str:
        out = []
        while i < end:
            j = i
            while j < end and not self._is(j, ","):
                k = self._angles(j)
                j = k if k > j else (self.closing[j] + 1 if self._is(j, "(", "[") else j + 1)
            a, b = i, j
            while a < b and (self._is(a, "ref", "out", "in", "params", "this", "scoped", "readonly") or self._is(a, "[")):
                a = self.closing[a] + 1 if self._is(a, "[") else a + 1
            stop = next((k for k in range(a, b) if self._is(k, "=")), b)
            if stop - a >= 2:
                out.append(f"{self._source(a, stop - 1)} {self.t[stop - 1].text}")
            i = j + 1
        return ", ".join(out)

    def words(self, a: int, b: int) -> list[str]:
        return [x.text.lstrip("@") for k, x in enumerate(self.t[a:b], a) if x.kind == "word" and x.text not in RESERVED and not (x.text in ACCESSORS and k in self.skipped)]

    def references(self, d: Declaration) -> Iterator[tuple[str, str]]:
        """(name, kind): bases of a class, objects made, calls by the whole expression's text, and members read."""
        if d.is_class:
            yield from ((b, "Inherits") for b in d.bases)
        i, last = d.first, d.last + 1
        while i < last:
            x = self.t[i]
            if i in self.skipped or x.kind != "word":
                i += 1
                continue
            if x.text == "new":
                j = i + 1
                while j < last and (self.t[j].kind == "word" or self._is(j, ".", "::")):
                    j += 1
                if j > i + 1:
                    yield re.sub(r"\s", "", self._source(i + 1, j)), "References"
                i = max(j, i + 1)
                continue
            if x.text in RESERVED - {"this", "base"}:
                i += 1
                continue
            j = i + 1
            while j + 1 < last and self._is(j, ".", "?.") and self.t[j + 1].kind == "word":
                j += 2
            name = re.sub(r"\s", "", self._source(i, j)).replace("?.", ".")
            k = self._angles(j)
            if self._is(k, "("):
                yield name, "Calls"
            elif "." in name:
                yield name, "References"
            i = j


def _preview(text: str, limit: int = 320) -> str:
    t = text.strip()
    return t if len(t) <= limit else t[:limit] + " …"


def parse(text: str, path: str = "") -> Iterator[tuple[dict, list[tuple[str, str]], None]]:
    """Chunk and references of each declaration, in order of their beginnings."""
    p = Parser(text)
    lines = [i for i, c in enumerate(text) if c == "\n"]
    for d in sorted(p.found, key=lambda d: (d.first, -d.last)):
        start, end = p.t[d.first].start, p.t[d.last].end
        lead = p.t[d.first - 1].end if d.first else 0
        types = ".".join(d.types)
        own = d.signature if d.kind in ("method", "constructor") else d.name
        if d.kind == "type":
            words = [d.name, *(re.split(r"[<(]", b)[0].strip() for b in d.bases)]
        elif d.kind == "field":
            words = [d.name]
        else:
            words = p.words(*d.body)
        source = text[start:end]
        head = d.signature if not types else f"{types} -> {d.signature}"
        yield (
            dict(
                id=".".join(x for x in (d.namespace, types, own) if x), path=path, lang="csharp", text=text[lead:end], preview=f"{head}\n{_preview(source)}", identifiers=None, keywords=list({w.lower(): None for w in words}), symbol_kind=d.kind, symbol_name=d.name,
                namespace=d.namespace, containing_type=types, span_start=start, span_end=end, start_line=bisect_right(lines, start - 1) + 1, end_line=bisect_right(lines, end - 1) + 1, signature=d.signature, xml_links=[], def_type=None,
            ),
            list(p.references(d)),
            None,
        )
