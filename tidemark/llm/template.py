"""A sandboxed template language, compiled to Python closures.

Text, ``{{ expression }}`` and the statements ``for``, ``if``/``elif``/``else``, ``set`` and ``generation``
(its output is marked for the loss). ``-`` beside a delimiter strips white space there. Expressions have
literals, names, ``a.b`` and ``a[b]`` on mappings and lists, ``+ - ~``, comparisons, ``in``, ``and or not``
and filters. Nothing else is reachable: no calls, no Python attributes, no names that start with an
underscore. ``compile_template`` parses, folds constants and returns a generator function
``render(sink, values)`` that pauses after each pass of an outermost loop, so a caller can flush output.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape_control(text: str) -> str:
    """Put a backslash between ``<`` and ``|`` (before backslashes already there), so no control string is left."""
    return _CONTROL.sub(r"<\1\\|", text)


def unescape_control(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_name(text: str) -> str:
    """A role on one line: backslashes and line breaks are spelled out, then control strings escaped."""
    return escape_control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_name(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_control(text), flags=re.S)


FILTERS: dict[str, Callable] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "escape": lambda x: escape_control(str(x)), "name": lambda x: escape_name(str(x)), "string": str}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}


class TemplateError(ValueError):
    pass


# ---------------------------------------------------------------- syntax tree

_PARTS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_LEXEMES = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\](),=]))")
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take(*COMPARE, "not"):
            if op == "not":
                self.need("in")
                node = ("not", ("compare", "in", node, self.added()))
            else:
                node = ("compare", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.postfixed()
        while op := self.take("+", "-", "~"):
            node = ("add", op, node, self.postfixed())
        return node

    def postfixed(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "[", "|"):
            if op == "[":
                node = ("item", node, self.either())
                self.need("]")
            else:
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"bad name {name!r}")
                self.at += 1
                if op == "|" and name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                node = ("filter", name, node) if op == "|" else ("item", node, ("value", name))
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("value", float(text) if "." in text else int(text))
        if kind == "str":
            return ("value", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            if text in ("true", "false", "none"):
                return ("value", {"true": True, "false": False, "none": None}[text])
            if text.startswith("_"):
                raise TemplateError(f"bad name {text!r}")
            return ("name", text)
        if text == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[tuple]:
    """The template as a tree: ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)...]), ("set", name, e), ("generation", body)."""
    items: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PARTS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] else text
        if text:
            items.append(("text", text))
        if m[2] is not None:
            items.append(("out", m[2]))
        elif m[5] is not None:
            items.append(("do", m[5].strip()))
        strip, at = bool(m[3] or m[6]), m.end()
    if rest := source[at:].lstrip() if strip else source[at:]:
        items.append(("text", rest))
    place = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal place
        body: list[tuple] = []
        while place < len(items):
            kind, text = items[place]
            place += 1
            if kind == "text":
                body.append(("text", text))
            elif kind == "out":
                body.append(("out", _Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return body, text
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body.append(("for", m[1], _Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    arms, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((condition, inner))
                        if end == "endif":
                            break
                        condition = _Expression(end[4:]).whole() if end.startswith("elif") else ("value", True)
                    body.append(("if", arms))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad set: {rest!r}")
                    body.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    body.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown statement {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    return block()[0]


# ---------------------------------------------------------------- constants


def _added(op: str, a, b):
    return str(a) + str(b) if op == "~" else a + b if op == "+" else a - b


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("value", "name"):
        return node
    parts = [fold_expression(x) if isinstance(x, tuple) else x for x in node[1:]]
    inner = [x for x in parts if isinstance(x, tuple)]
    known = all(x[0] == "value" for x in inner)
    if kind in ("and", "or") and inner[0][0] == "value":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if not known:
        return (kind, *parts)
    values = [x[1] for x in inner]
    if kind == "not":
        return ("value", not values[0])
    if kind == "compare":
        return ("value", COMPARE[parts[0]](*values))
    if kind == "add":
        return ("value", _added(parts[0], *values))
    if kind == "filter":
        return ("value", FILTERS[parts[0]](values[0]))
    return (kind, *parts)


def fold(body: list[tuple]) -> list[tuple]:
    """The tree without constant expressions, dead branches and neighbouring texts."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold_expression(node[1])
            add(("text", _shown(e[1])) if e[0] == "value" else ("out", e))
        elif node[0] == "for":
            out.append(("for", node[1], fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            out.append(("set", node[1], fold_expression(node[2])))
        elif node[0] == "generation":
            out.append(("generation", fold(node[1])))
        elif node[0] == "if":
            arms = []
            for condition, inner in node[1]:
                condition = fold_expression(condition)
                if condition[0] == "value" and not condition[1]:
                    continue
                arms.append((condition, fold(inner)))
                if condition[0] == "value":
                    break
            if arms and arms[0][0][0] == "value":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                out.append(("if", arms))
        else:
            add(node)
    return out


# ---------------------------------------------------------------- closures


def _shown(value) -> str:
    return "" if value is None else str(value)


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "value":
        return lambda v, x=node[1]: x
    if kind == "name":
        return lambda v, n=node[1]: v.get(n)
    if kind == "item":
        a, b = _expression(node[1]), _expression(node[2])

        def item(v: dict):
            box, key = a(v), b(v)
            if isinstance(box, dict):
                return box.get(key)
            if isinstance(box, (list, tuple, str)) and isinstance(key, int):
                return box[key] if -len(box) <= key < len(box) else None
            raise TemplateError("only mappings and lists have items")

        return item
    if kind == "filter":
        f, a = FILTERS[node[1]], _expression(node[2])
        return lambda v: f(a(v))
    if kind == "not":
        a = _expression(node[1])
        return lambda v: not a(v)
    if kind in ("and", "or"):
        a, b = _expression(node[1]), _expression(node[2])
        return (lambda v: a(v) and b(v)) if kind == "and" else (lambda v: a(v) or b(v))
    a, b = _expression(node[2]), _expression(node[3])
    if kind == "compare":
        return lambda v, f=COMPARE[node[1]]: f(a(v), b(v))
    return lambda v, op=node[1]: _added(op, a(v), b(v))


def _statement(node: tuple) -> Callable[["Sink", dict], Iterator[None]]:
    kind = node[0]
    if kind == "text":

        def text(sink: Sink, v: dict, s=node[1]) -> Iterator[None]:
            sink.put(s)
            return iter(())

        return text
    if kind == "out":
        e = _expression(node[1])

        def out(sink: Sink, v: dict) -> Iterator[None]:
            sink.put(_shown(e(v)))
            return iter(())

        return out
    if kind == "set":
        e = _expression(node[2])

        def assign(sink: Sink, v: dict) -> Iterator[None]:
            v[node[1]] = e(v)
            return iter(())

        return assign
    if kind == "generation":
        body = _body(node[1])

        def generation(sink: Sink, v: dict) -> Iterator[None]:
            sink.open()
            for _ in body(sink, v):
                pass
            sink.close()
            return iter(())

        return generation
    if kind == "if":
        arms = [(_expression(c), _body(b)) for c, b in node[1]]

        def branch(sink: Sink, v: dict) -> Iterator[None]:
            for condition, body in arms:
                if condition(v):
                    yield from body(sink, v)
                    return

        return branch
    items, body = _expression(node[2]), _body(node[3])

    def loop(sink: Sink, v: dict) -> Iterator[None]:
        following = iter(items(v) or ())
        inner = dict(v)
        index, done = 0, object()
        now = next(following, done)
        while now is not done:
            after = next(following, done)
            inner[node[1]] = now
            inner["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": after is done}
            yield from body(sink, inner)
            yield
            now, index = after, index + 1

    return loop


def _body(nodes: list[tuple]) -> Callable[["Sink", dict], Iterator[None]]:
    parts = [_statement(n) for n in nodes]

    def run(sink: Sink, v: dict) -> Iterator[None]:
        for part in parts:
            yield from part(sink, v)

    return run


class Sink:
    """Output so far and the marked spans in it, both cut off by ``flush``."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[list[int]] = []
        self.depth = 0

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.length += len(text)

    def open(self) -> None:
        if not self.depth:
            self.spans.append([self.length, self.length])
        self.depth += 1

    def close(self) -> None:
        self.depth -= 1
        if not self.depth:
            self.spans[-1][1] = self.length

    def flush(self) -> tuple[str, list[list[int]]]:
        out = "".join(self.parts), self.spans
        self.parts, self.length, self.spans = [], 0, []
        return out


def compile_template(source: str) -> Callable[[Sink, dict], Iterator[None]]:
    return _body(fold(parse(source)))
