"""A small sandboxed template language, compiled to Python closures.

Source is parsed to a syntax tree, constants are folded, and each node becomes a
closure ``run(scope, emit)``. There are no calls, no imports and no attribute
access on Python objects: names resolve in the scope only, and ``a.b`` is a key
lookup. ``for`` pulls from an iterator with one item of look-ahead, so a template
streams over any number of items.

    {% for m in messages %} {% endfor %}          loop.index0, loop.first, loop.last
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% generation %} {% endgeneration %}          text under the loss mask
    {{ expression }}                              == != and or not + ~ | filter ( )
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce


class TemplateError(ValueError):
    """The template's source is not valid."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    operand: object


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class If:
    branches: tuple
    otherwise: tuple = ()


@dataclass(frozen=True)
class For:
    var: str
    source: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def to_text(value: object) -> str:
    """Text of a value: null is empty, booleans are lower case."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else to_text(a) + to_text(b),
    "~": lambda a, b: to_text(a) + to_text(b),
}
_LEVELS = (("or",), ("and",), ("==", "!="), ("+", "~"))
_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<op>==|!=|[-+~|().])|(?P<word>[A-Za-z_]\w*))""")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
#: Nesting beyond this is refused, so that no source exhausts the stack.
MAX_DEPTH = 64


class _Expression:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.at, self.depth, self.tokens = filters, 0, 0, []
        end = 0
        while source[end:].strip():
            m = _TOKEN.match(source, end)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[end:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            end = m.end()

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self) -> tuple[str | None, str | None]:
        token = self.peek()
        self.at += 1
        return token

    def parse(self):
        tree = self.level(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def level(self, k: int):
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.peek()[0] in ("op", "word") and self.peek()[1] in _LEVELS[k]:
            op = self.take()[1]
            left = Binary(op, left, self.level(k + 1))
        return left

    def unary(self):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("expression is nested too deeply")
        try:
            if self.peek() == ("word", "not"):
                self.take()
                return Unary(self.unary())
            return self.postfix()
        finally:
            self.depth -= 1

    def postfix(self):
        tree = self.primary()
        while self.peek()[1] in (".", "|") and self.peek()[0] == "op":
            op, (kind, word) = self.take()[1], self.take()
            if kind != "word":
                raise TemplateError(f"a name must follow {op!r}")
            if op == "|":
                if word not in self.filters:
                    raise TemplateError(f"unknown filter {word!r}")
                tree = Filter(word, tree)
            elif isinstance(tree, Name) and not word.startswith("_"):
                tree = Name((*tree.path, word))
            else:
                raise TemplateError(f"no attribute {word!r} here")
        return tree

    def primary(self):
        kind, word = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(word))
        if kind == "word" and word in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[word])
        if kind == "word" and not word.startswith("_"):
            return Name((word,))
        if (kind, word) == ("op", "("):
            tree = self.level(0)
            if self.take() != ("op", ")"):
                raise TemplateError("missing )")
            return tree
        raise TemplateError(f"unexpected {word!r} in expression")


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.items, end = filters, [], 0
        for m in _TAG.finditer(source):
            if m.start() > end:
                self.items.append(("text", source[end : m.start()]))
            if m[1] is not None:
                self.items.append(("tag", m[1]))
            elif m[2] is not None:
                self.items.append(("out", m[2]))
            end = m.end()
        if end < len(source):
            self.items.append(("text", source[end:]))
        self.at = 0

    def expr(self, source: str):
        return _Expression(source, self.filters).parse()

    def block(self, ends: tuple[str, ...], depth: int = 0) -> tuple[tuple, str, str]:
        """Nodes up to a tag named in ``ends``; that tag's name and the rest of it."""
        if depth > MAX_DEPTH:
            raise TemplateError("blocks are nested too deeply")
        nodes: list = []
        while self.at < len(self.items):
            kind, body = self.items[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Output(Const(body)))
            elif kind == "out":
                nodes.append(Output(self.expr(body)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(nodes), word, rest
                nodes.append(self.statement(word, rest, depth))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), "", ""

    def statement(self, word: str, rest: str, depth: int):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"bad for: {rest!r}")
            return For(m[1], self.expr(m[2]), self.block(("endfor",), depth + 1)[0])
        if word == "if":
            branches, otherwise, end = [], (), "elif"
            while end == "elif":
                test = self.expr(rest)
                body, end, rest = self.block(("elif", "else", "endif"), depth + 1)
                branches.append((test, body))
            if end == "else":
                otherwise = self.block(("endif",), depth + 1)[0]
            return If(tuple(branches), otherwise)
        if word == "generation":
            return Generation(self.block(("endgeneration",), depth + 1)[0])
        raise TemplateError(f"unknown tag {word!r}")


def fold_expr(tree, filters: dict[str, Callable]):
    """The expression with every constant part evaluated."""
    match tree:
        case Unary(x):
            x = fold_expr(x, filters)
            return Const(not x.value) if isinstance(x, Const) else Unary(x)
        case Binary(op, a, b):
            a, b = fold_expr(a, filters), fold_expr(b, filters)
            if isinstance(a, Const) and isinstance(b, Const):
                return Const(_BINARY[op](a.value, b.value))
            return Binary(op, a, b)
        case Filter(name, x):
            x = fold_expr(x, filters)
            return Const(filters[name](to_text(x.value))) if isinstance(x, Const) else Filter(name, x)
    return tree


def fold(nodes: tuple, filters: dict[str, Callable]) -> tuple:
    """Nodes with constants evaluated, dead branches gone and adjacent texts joined."""
    out: list = []
    for node in nodes:
        match node:
            case Output(e):
                e = fold_expr(e, filters)
                parts = _concatenated(e)
                new = [Output(Const(to_text(p.value))) if isinstance(p, Const) else Output(p) for p in parts]
            case If(branches, otherwise):
                live: list = []
                for test, body in branches:
                    test = fold_expr(test, filters)
                    if not isinstance(test, Const):
                        live.append((test, fold(body, filters)))
                    elif test.value:
                        otherwise = body
                        break
                rest = fold(otherwise, filters)
                new = [If(tuple(live), rest)] if live else list(rest)
            case For(var, source, body):
                new = [For(var, fold_expr(source, filters), fold(body, filters))]
            case Generation(body):
                new = [Generation(fold(body, filters))]
        for n in new:
            if isinstance(n, Output) and isinstance(n.expr, Const):
                if not n.expr.value:
                    continue
                if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                    out[-1] = Output(Const(out[-1].expr.value + n.expr.value))
                    continue
            out.append(n)
    return tuple(out)


def _concatenated(e) -> list:
    """Operands of a ``~`` chain; ``+`` only where a side is constant text, so no sum of integers is split."""
    if isinstance(e, Binary) and (e.op == "~" or e.op == "+" and any(isinstance(x, Const) and isinstance(x.value, str) for x in (e.left, e.right))):
        return [*_concatenated(e.left), *_concatenated(e.right)]
    return [e]


def _evaluator(tree, filters: dict[str, Callable]) -> Callable[[dict], object]:
    match tree:
        case Const(value):
            return lambda scope: value
        case Name((one,)):
            return lambda scope: scope.get(one)
        case Name(path):
            return lambda scope: reduce(lambda v, k: v.get(k) if isinstance(v, dict) else None, path, scope)
        case Unary(x):
            inner = _evaluator(x, filters)
            return lambda scope: not inner(scope)
        case Binary("and", a, b):
            left, right = _evaluator(a, filters), _evaluator(b, filters)
            return lambda scope: left(scope) and right(scope)
        case Binary("or", a, b):
            left, right = _evaluator(a, filters), _evaluator(b, filters)
            return lambda scope: left(scope) or right(scope)
        case Binary(op, a, b):
            left, right, apply = _evaluator(a, filters), _evaluator(b, filters), _BINARY[op]
            return lambda scope: apply(left(scope), right(scope))
        case Filter(name, x):
            inner, apply = _evaluator(x, filters), filters[name]
            return lambda scope: apply(to_text(inner(scope)))
    raise TemplateError(f"cannot compile {tree!r}")


Emit = Callable[[str, bool], None]


def _compiled(nodes: tuple, filters: dict[str, Callable], masked: bool) -> Callable[[dict, Emit], None]:
    steps = [_step(n, filters, masked) for n in nodes]

    def run(scope: dict, emit: Emit) -> None:
        for step in steps:
            step(scope, emit)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters: dict[str, Callable], masked: bool) -> Callable[[dict, Emit], None]:
    match node:
        case Output(Const(text)):
            return lambda scope, emit: emit(text, masked)
        case Output(e):
            value = _evaluator(e, filters)
            return lambda scope, emit: emit(to_text(value(scope)), masked)
        case Generation(body):
            return _compiled(body, filters, True)
        case If(branches, otherwise):
            tests = [(_evaluator(t, filters), _compiled(b, filters, masked)) for t, b in branches]
            rest = _compiled(otherwise, filters, masked)

            def choose(scope: dict, emit: Emit) -> None:
                for test, body in tests:
                    if test(scope):
                        return body(scope, emit)
                return rest(scope, emit)

            return choose
        case For(var, source, body):
            items, inner = _evaluator(source, filters), _compiled(body, filters, masked)

            def loop(scope: dict, emit: Emit) -> None:
                rest = iter(items(scope) or ())
                item = next(rest, _END)
                index = 0
                while item is not _END:
                    after = next(rest, _END)
                    inner({**scope, var: item, "loop": {"index0": index, "first": index == 0, "last": after is _END}}, emit)
                    item, index = after, index + 1

            return loop
    raise TemplateError(f"cannot compile {node!r}")


_END = object()


@dataclass
class Template:
    """A compiled template. ``filters`` maps names to functions of text to text."""

    source: str
    filters: dict[str, Callable[[str], str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        nodes, _, _ = _Parser(self.source, self.filters).block(())
        self.tree = fold(nodes, self.filters)
        self._run = _compiled(self.tree, self.filters, False)

    def render(self, scope: dict, emit: Emit) -> None:
        """Call ``emit(text, masked)`` for each piece of output, in order."""
        self._run(scope, emit)

    def render_text(self, messages: Iterable[dict], **scope) -> tuple[str, list[tuple[int, int]]]:
        """Whole output and the spans of it under the loss mask, in code points."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, masked: bool) -> None:
            nonlocal at
            parts.append(text)
            if masked:
                spans.append((at, at + len(text)))
            at += len(text)

        self.render({**scope, "messages": messages}, emit)
        return "".join(parts), spans
