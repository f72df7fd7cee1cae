"""Compiler of a sandboxed template language to Python closures.

The language has text, ``{{ expression }}`` and the statements ``for … in``, ``if/elif/else``, ``set`` and ``generation``; a ``-`` inside
a delimiter trims the white space beside it. Expressions have literals, names, attributes and items of mappings, ``loop``, ``~``,
comparisons, ``in``, ``and/or/not`` and filters. There are no calls, no attributes of Python objects and no names but those given, so a
template can neither reach anything outside its data nor run without end.

Compilation has three steps: parse into a syntax tree, fold what is constant, and turn every node into a closure. A compiled template
yields its output in pieces, each with a mark that tells whether it is inside a ``generation`` block; loops take their items one by
one, so a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

MAX_SOURCE = 100_000
MAX_DEPTH = 50


class TemplateError(ValueError):
    pass


# ---- syntax tree

class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Unary(NamedTuple):
    of: Any


class Binary(NamedTuple):
    op: str
    left: Any
    right: Any


class Filter(NamedTuple):
    name: str
    of: Any


class Output(NamedTuple):
    value: Any


class For(NamedTuple):
    name: str
    items: Any
    body: list


class If(NamedTuple):
    test: Any
    then: list
    other: list


class Set(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: list


_DELIMITED = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|[.\[\]()|~]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "for", "if", "else", "elif", "set", "loop", *_CONSTANTS}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, filters: Iterable[str]):
        self.filters = set(filters)
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("number", "text", "name", "mark")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def accept(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "mark") and value in values:
            self.at += 1
            return value
        return None

    def whole(self) -> Any:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("expression too deep")
        node = self.both()
        while self.accept("or"):
            node = Binary("or", node, self.both())
        self.depth -= 1
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.accept("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        turns = 0
        while self.accept("not"):
            turns += 1
        node = self.compared()
        for _ in range(turns):
            node = Unary(node)
        return node

    def compared(self) -> Any:
        node = self.joined()
        while op := self.accept("==", "!=", "in"):
            node = Binary(op, node, self.joined())
        return node

    def joined(self) -> Any:
        node = self.filtered()
        while self.accept("~"):
            node = Binary("~", node, self.filtered())
        return node

    def filtered(self) -> Any:
        node = self.primary()
        while True:
            if self.accept("|"):
                kind, name = self.peek()
                if kind != "name" or name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                self.at += 1
                node = Filter(name, node)
            elif self.accept("."):
                kind, name = self.peek()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no attribute {name!r}")
                self.at += 1
                node = Item(node, Const(name))
            elif self.accept("["):
                node = Item(node, self.either())
                if not self.accept("]"):
                    raise TemplateError("] expected")
            else:
                return node

    def primary(self) -> Any:
        kind, value = self.peek()
        if self.accept("("):
            node = self.either()
            if not self.accept(")"):
                raise TemplateError(") expected")
            return node
        self.at += 1
        if kind == "number":
            return Const(int(value))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name" and value in _CONSTANTS:
            return Const(_CONSTANTS[value])
        if kind == "name" and not value.startswith("_") and (value == "loop" or value not in _RESERVED):
            return Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Iterable[str] = ()) -> list:
    """The syntax tree of a template."""
    if len(source) > MAX_SOURCE:
        raise TemplateError("template too long")
    filters = list(filters)
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _DELIMITED.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        before, after = (m[1] or m[4], m[3] or m[6])
        parts.append(("text", text.rstrip() if before else text))
        if m[2] is not None:
            parts.append(("output", m[2]))
        elif m[5] is not None:
            parts.append(("statement", m[5].strip()))
        at, trim = m.end(), bool(after)
    rest = source[at:]
    parts.append(("text", rest.lstrip() if trim else rest))
    place = 0

    def expression(text: str) -> Any:
        return _Expression(text, filters).whole()

    def block(ends: tuple[str, ...], depth: int) -> tuple[list, str]:
        nonlocal place
        if depth > MAX_DEPTH:
            raise TemplateError("blocks too deep")
        nodes: list = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Output(Const(text)))
            elif kind == "output":
                nodes.append(Output(expression(text)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return nodes, text
                nodes.append(statement(word, rest.strip(), depth))
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return nodes, ""

    def choice(test: str, depth: int) -> If:
        then, end = block(("elif", "else", "endif"), depth + 1)
        word, _, rest = end.partition(" ")
        other: list = []
        if word == "elif":
            other = [choice(rest, depth + 1)]
        elif word == "else":
            other, _ = block(("endif",), depth + 1)
        return If(expression(test), then, other)

    def statement(word: str, rest: str, depth: int) -> Any:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m or m[1] in _RESERVED:
                raise TemplateError(f"cannot read for {rest!r}")
            return For(m[1], expression(m[2]), block(("endfor",), depth + 1)[0])
        if word == "if":
            return choice(rest, depth)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m or m[1] in _RESERVED:
                raise TemplateError(f"cannot read set {rest!r}")
            return Set(m[1], expression(m[2]))
        if word == "generation":
            return Generation(block(("endgeneration",), depth + 1)[0])
        raise TemplateError(f"no statement {word!r}")

    return block((), 0)[0]


# ---- constant folding

Filters = dict[str, Callable[[Any], Any]]


def fold(nodes: list, filters: Filters, constants: dict[str, Any]) -> list:
    """The same tree with constant expressions computed, dead branches gone and neighbouring text joined.

    ``constants`` are names that no template may set or loop over.
    """
    out: list = []
    for node in nodes:
        match node:
            case Output(value):
                value = fold_value(value, filters, constants)
                if isinstance(value, Const):
                    value = Const(as_text(value.value))
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        value = Const(out.pop().value.value + value.value)
                    if not value.value:
                        continue
                out.append(Output(value))
            case If(test, then, other):
                test = fold_value(test, filters, constants)
                if isinstance(test, Const):
                    chosen = fold(then if test.value else other, filters, constants)
                    joined = fold([*out, *chosen], filters, constants) if out and chosen else [*out, *chosen]
                    out = joined
                else:
                    out.append(If(test, fold(then, filters, constants), fold(other, filters, constants)))
            case For(name, items, body):
                _settable(name, constants)
                out.append(For(name, fold_value(items, filters, constants), fold(body, filters, constants)))
            case Set(name, value):
                _settable(name, constants)
                out.append(Set(name, fold_value(value, filters, constants)))
            case Generation(body):
                out.append(Generation(fold(body, filters, constants)))
    return out


def _settable(name: str, constants: dict[str, Any]) -> None:
    if name in constants:
        raise TemplateError(f"{name!r} is constant")


def fold_value(node: Any, filters: Filters, constants: dict[str, Any]) -> Any:
    match node:
        case Name(name) if name in constants:
            return Const(constants[name])
        case Item(of, key):
            node = Item(fold_value(of, filters, constants), fold_value(key, filters, constants))
            parts = (node.of, node.key)
        case Unary(of):
            node = Unary(fold_value(of, filters, constants))
            parts = (node.of,)
        case Binary(op, left, right):
            node = Binary(op, fold_value(left, filters, constants), fold_value(right, filters, constants))
            if op in ("and", "or") and isinstance(node.left, Const):
                return node.right if bool(node.left.value) == (op == "and") else node.left
            parts = (node.left, node.right)
        case Filter(name, of):
            node = Filter(name, fold_value(of, filters, constants))
            parts = (node.of,)
        case _:
            return node
    if all(isinstance(p, Const) for p in parts):
        return Const(value_closure(node, filters)({}))
    return node


# ---- closures

Env = dict[str, Any]
Piece = tuple[str, bool]


def as_text(value: Any) -> str:
    return "" if value is None else str(value)


def item(of: Any, key: Any) -> Any:
    if isinstance(of, dict) and isinstance(key, str):
        return of.get(key)
    raise TemplateError(f"no item {key!r}")


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b if isinstance(b, (str, dict)) and isinstance(a, str) else False,
    "~": lambda a, b: as_text(a) + as_text(b),
}


def value_closure(node: Any, filters: Filters) -> Callable[[Env], Any]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Item(of, key):
            of_, key_ = value_closure(of, filters), value_closure(key, filters)
            return lambda env: item(of_(env), key_(env))
        case Unary(of):
            of_ = value_closure(of, filters)
            return lambda env: not of_(env)
        case Binary(op, left, right):
            left_, right_ = value_closure(left, filters), value_closure(right, filters)
            if op == "and":
                return lambda env: left_(env) and right_(env)
            if op == "or":
                return lambda env: left_(env) or right_(env)
            compute = _BINARY[op]
            return lambda env: compute(left_(env), right_(env))
        case Filter(name, of):
            of_, apply = value_closure(of, filters), filters[name]
            return lambda env: apply(of_(env))
    raise TemplateError(f"no expression {node!r}")


def block_closure(nodes: list, filters: Filters, inside: bool) -> Callable[[Env], Iterator[Piece]]:
    """A closure that yields the output of the nodes; ``inside`` tells whether that is model output."""
    steps = [node_closure(n, filters, inside) for n in nodes]

    def run(env: Env) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def node_closure(node: Any, filters: Filters, inside: bool) -> Callable[[Env], Iterable[Piece]]:
    match node:
        case Output(Const(text)):
            piece = ((text, inside),)
            return lambda env: piece
        case Output(value):
            value_ = value_closure(value, filters)
            return lambda env: ((as_text(value_(env)), inside),)
        case If(test, then, other):
            test_ = value_closure(test, filters)
            then_, other_ = block_closure(then, filters, inside), block_closure(other, filters, inside)
            return lambda env: then_(env) if test_(env) else other_(env)
        case Set(name, value):
            value_ = value_closure(value, filters)

            def assign(env: Env) -> Iterable[Piece]:
                env[name] = value_(env)
                return ()

            return assign
        case Generation(body):
            return block_closure(body, filters, True)
        case For(name, items, body):
            return loop_closure(name, value_closure(items, filters), block_closure(body, filters, inside))
    raise TemplateError(f"no node {node!r}")


def loop_closure(name: str, items: Callable[[Env], Any], body: Callable[[Env], Iterator[Piece]]) -> Callable[[Env], Iterator[Piece]]:
    """Items one at a time, with one ahead to know the last; names set inside the loop end with each turn."""

    def run(env: Env) -> Iterator[Piece]:
        found = items(env)
        if found is None or isinstance(found, (str, int)):
            raise TemplateError("loop over something that is no list")
        ahead = iter(found)
        index, current = 0, next(ahead, _END)
        while current is not _END:
            following = next(ahead, _END)
            loop = {"index": index + 1, "index0": index, "first": index == 0, "last": following is _END}
            yield from body({**env, name: current, "loop": loop})
            index, current = index + 1, following

    return run


_END = object()


def compile_template(source: str, filters: Filters | None = None, constants: dict[str, Any] | None = None) -> Callable[[Env], Iterator[Piece]]:
    """A closure from names to pieces ``(text, generated)``."""
    filters, constants = filters or {}, constants or {}
    return block_closure(fold(parse(source, filters), filters, constants), filters, False)
