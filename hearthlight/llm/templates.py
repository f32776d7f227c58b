"""A sandboxed template language for conversations, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{# comment #}`` and the tags ``{% for x in y %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = expression %}`` and ``{% generation %}``, each closed by
``{% end... %}``. Expressions are strings, integers, ``true false none``, names, fields (``message.role``),
``~`` (joins texts), ``== != < > <= >=``, ``and or not``, parentheses and filters (``x | escape``).
Inside a loop there are ``loop.index0``, ``loop.first`` and ``loop.last``.

The sandbox: fields are looked up in dictionaries only, so no Python attribute can be reached; there
are no calls but the filters that the caller names; templates and their nesting are bounded.
``messages`` is a stream: it can be looped over once, and one message is held at a time besides the
next one. Rendering yields pieces of text with a mark for those between generation tags.

The template is parsed into a syntax tree; operations on constants are folded, branches with a
constant condition are chosen, and adjacent texts joined; each node of what remains becomes a closure.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

LONGEST, DEEPEST = 65_536, 32
Env = dict[str, object]
Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


# --- syntax tree ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Operation:
    """``~``, a comparison, ``and``, ``or``, ``not``, or a filter with its name."""

    name: str
    parts: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    condition: object
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser ---------------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[<>~|().]))""", re.DOTALL,
)
_COMPARE: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
}
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _string(token: str) -> str:
    def plain(match: re.Match) -> str:
        if match[1] not in _ESCAPED:
            raise TemplateError(f"unknown escape {match[0]}")
        return _ESCAPED[match[1]]
    return re.sub(r"\\(.)", plain, token[1:-1], flags=re.DOTALL)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: Iterable[str]):
        self.tokens: list[tuple[str, str]] = []
        self.filters, self.at, self.depth = filters, 0, 0
        source, at = source.strip(), 0
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()

    def whole(self) -> object:
        value = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def accept(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self) -> object:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("nested too deep")
        value = self.both()
        while self.accept("or"):
            value = Operation("or", (value, self.both()))
        self.depth -= 1
        return value

    def both(self) -> object:
        value = self.negated()
        while self.accept("and"):
            value = Operation("and", (value, self.negated()))
        return value

    def negated(self) -> object:
        turns = 0
        while self.accept("not"):
            turns += 1
        value = self.compared()
        for _ in range(turns):
            value = Operation("not", (value,))
        return value

    def compared(self) -> object:
        value = self.joined()
        if sign := self.accept(*_COMPARE):
            value = Operation(sign, (value, self.joined()))
        return value

    def joined(self) -> object:
        value = self.filtered()
        while self.accept("~"):
            value = Operation("~", (value, self.filtered()))
        return value

    def filtered(self) -> object:
        value = self.primary()
        while self.accept("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name}")
            value = Operation(name, (value,))
        return value

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"{name} is not to be had")
        return name

    def primary(self) -> object:
        if self.accept("("):
            value = self.either()
            if not self.accept(")"):
                raise TemplateError("a bracket is open")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, token = self.tokens[self.at]
        if kind == "string" or kind == "number":
            self.at += 1
            return Const(_string(token) if kind == "string" else int(token))
        if kind != "name":
            raise TemplateError(f"unexpected {token!r}")
        name = self.name()
        value: object = Const(_WORDS[name]) if name in _WORDS else Name(name)
        while self.accept("."):
            value = Field(value, self.name())
        return value


class _Parser:
    def __init__(self, source: str, filters: Iterable[str]):
        if len(source) > LONGEST:
            raise TemplateError("the template is too long")
        self.parts, self.at, self.filters = _PARTS.split(source), 0, filters

    def expression(self, source: str) -> object:
        return _Expression(source, self.filters).whole()

    def body(self, ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        """Nodes up to one of the tags ``ends``, and that tag."""
        if depth > DEEPEST:
            raise TemplateError("nested too deep")
        nodes: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(Emit(self.expression(part[2:-2])))
            elif not part.startswith("{%"):
                if part:
                    nodes.append(Emit(Const(part)))
            else:
                tag = part[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return tuple(nodes), tag
                nodes.append(self.tag(word, tag[len(word):].strip(), depth))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    def tag(self, word: str, rest: str, depth: int) -> object:
        if word == "for" and (match := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
            return For(match[1], self.expression(match[2]), self.body(("endfor",), depth + 1)[0])
        if word == "set" and (match := re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.DOTALL)):
            return Set(match[1], self.expression(match[2]))
        if word == "generation" and not rest:
            return Generation(self.body(("endgeneration",), depth + 1)[0])
        if word == "if":
            return self.branches(rest, depth)
        raise TemplateError(f"unknown tag {word} {rest}")

    def branches(self, condition: str, depth: int) -> If:
        then, tag = self.body(("elif", "else", "endif"), depth + 1)
        word, _, rest = tag.partition(" ")
        if word == "elif":
            return If(self.expression(condition), then, (self.branches(rest, depth + 1),))
        otherwise = self.body(("endif",), depth + 1)[0] if word == "else" else ()
        return If(self.expression(condition), then, otherwise)


def parse(source: str, filters: Iterable[str] = ()) -> tuple:
    return _Parser(source, filters).body((), 0)[0]


# --- folding --------------------------------------------------------------------------------


def shown(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _apply(name: str, values: list, filters: dict[str, Callable[[str], str]]) -> object:
    try:
        if name in _COMPARE:
            return _COMPARE[name](*values)
    except TypeError as wrong:
        raise TemplateError(f"{name}: {wrong}") from wrong
    if name == "~":
        return shown(values[0]) + shown(values[1])
    return not values[0] if name == "not" else filters[name](shown(values[0]))


def fold_expression(node: object, filters: dict[str, Callable[[str], str]]) -> object:
    if isinstance(node, Field):
        return Field(fold_expression(node.of, filters), node.name)
    if not isinstance(node, Operation):
        return node
    parts = tuple(fold_expression(p, filters) for p in node.parts)
    if node.name in ("and", "or"):
        if isinstance(parts[0], Const):
            return parts[1] if bool(parts[0].value) == (node.name == "and") else parts[0]
    elif all(isinstance(p, Const) for p in parts):
        return Const(_apply(node.name, [p.value for p in parts], filters))
    return Operation(node.name, parts)


def fold(nodes: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """The same template with constants folded and adjacent texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Emit):
            value = fold_expression(node.value, filters)
            if isinstance(value, Const):
                text = shown(value.value)
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Emit(Const(text)))
            else:
                out.append(Emit(value))
        elif isinstance(node, Set):
            out.append(Set(node.name, fold_expression(node.value, filters)))
        elif isinstance(node, For):
            out.append(For(node.name, fold_expression(node.over, filters), fold(node.body, filters)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body, filters)))
        else:
            condition = fold_expression(node.condition, filters)
            then, otherwise = fold(node.then, filters), fold(node.otherwise, filters)
            if isinstance(condition, Const):
                for chosen in then if condition.value else otherwise:
                    if isinstance(chosen, Emit) and isinstance(chosen.value, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(out[-1].value.value + chosen.value.value))
                    else:
                        out.append(chosen)
            else:
                out.append(If(condition, then, otherwise))
    return tuple(out)


# --- closures -------------------------------------------------------------------------------


def _value(node: object, filters: dict[str, Callable[[str], str]]) -> Callable[[Env], object]:
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        def named(env: Env, name: str = node.name) -> object:
            if name not in env:
                raise TemplateError(f"there is no {name}")
            return env[name]
        return named
    if isinstance(node, Field):
        of = _value(node.of, filters)

        def field(env: Env, name: str = node.name) -> object:
            held = of(env)
            if not isinstance(held, dict) or name not in held:
                raise TemplateError(f"there is no field {name}")
            return held[name]
        return field
    parts = [_value(p, filters) for p in node.parts]
    if node.name == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if node.name == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env, name=node.name: _apply(name, [p(env) for p in parts], filters)


Closure = Callable[[Env, bool], Iterator[Piece]]


def _sequence(nodes: tuple, filters: dict[str, Callable[[str], str]]) -> Closure:
    steps = [_closure(n, filters) for n in nodes]

    def run(env: Env, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(env, marked)
    return steps[0] if len(steps) == 1 else run


def _closure(node: object, filters: dict[str, Callable[[str], str]]) -> Closure:
    if isinstance(node, Emit):
        value = _value(node.value, filters)

        def emit(env: Env, marked: bool) -> Iterator[Piece]:
            yield shown(value(env)), marked
        return emit
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def put(env: Env, marked: bool) -> Iterator[Piece]:
            env[node.name] = value(env)
            yield from ()
        return put
    if isinstance(node, Generation):
        body = _sequence(node.body, filters)
        return lambda env, marked: body(env, True)
    if isinstance(node, If):
        condition, then, otherwise = _value(node.condition, filters), _sequence(node.then, filters), _sequence(node.otherwise, filters)
        return lambda env, marked: (then if condition(env) else otherwise)(env, marked)
    over, body = _value(node.over, filters), _sequence(node.body, filters)

    def loop(env: Env, marked: bool) -> Iterator[Piece]:
        items = over(env)
        if isinstance(items, (str, dict)) or not isinstance(items, Iterable):
            raise TemplateError("this cannot be looped over")
        items, index, missing = iter(items), 0, object()
        item = next(items, missing)
        while item is not missing:
            following = next(items, missing)
            inner = env | {
                node.name: item, "loop": {"index0": index, "first": index == 0, "last": following is missing},
            }
            yield from body(inner, marked)
            item, index = following, index + 1
    return loop


def _uses(node: object, name: str, inside: bool = False) -> list[bool]:
    """Where ``name`` is read: True for reads within a loop."""
    if isinstance(node, tuple):
        return [x for n in node for x in _uses(n, name, inside)]
    if isinstance(node, Name):
        return [inside] if node.name == name else []
    if isinstance(node, For):
        return _uses(node.over, name, inside) + _uses(node.body, name, True)
    parts = [getattr(node, f) for f in ("of", "parts", "value", "condition", "then", "otherwise", "body") if hasattr(node, f)]
    return [] if isinstance(node, Const) else _uses(tuple(parts), name, inside)


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from a stream of messages to pieces (text, whether it is to be learned)."""
    filters = filters or {}
    tree = fold(parse(source, filters), filters)
    reads = _uses(tree, "messages")
    if len(reads) > 1 or any(reads):
        raise TemplateError("messages can be looped over once")
    closure = _sequence(tree, filters)
    return lambda messages: closure({"messages": messages}, False)
