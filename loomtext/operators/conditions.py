"""Boolean conditions on tags, tag sets, scope, task and provider.

``tag:x``, ``TAGSET:set:tag``, ``TAGONLY:set:tag``, ``scope:local``, ``scope:parent``, ``task``, ``provider:a.b``,
``NOT``, ``AND``, ``OR`` (in order of falling precedence) and parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<mark>[():.])|(?P<word>\w[\w-]*)|(?P<bad>\S))")
MEDIA = tuple(f".{m}" for m in "api cli idea vscode".split())


class ConditionError(ValueError):
    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


@dataclass(frozen=True)
class Node:
    """``kind`` is a leaf's name or one of and, or, not; ``args`` are names or nodes."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.kind in ("and", "or"):
            return "(" + f" {self.kind.upper()} ".join(map(str, self.args)) + ")"
        if self.kind == "not":
            return f"NOT {self.args[0]}"
        return ":".join((self.kind, *self.args))


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                break
            kind = m.lastgroup
            if kind == "bad":
                raise ConditionError(f"unexpected character {m['bad']!r}", m.start("bad"))
            self.tokens.append((kind, m[kind], m.start(kind)))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.at = 0

    def take(self, kind: str, value: str | None = None) -> str | None:
        k, v, _ = self.tokens[self.at]
        if k != kind or value not in (None, v):
            return None
        self.at += 1
        return v

    def need(self, kind: str, value: str | None, what: str) -> str:
        got = self.take(kind, value)
        if got is None:
            raise ConditionError(f"expected {what}", self.tokens[self.at][2])
        return got

    def chain(self, word: str, kind: str, part) -> Node:
        parts = [part()]
        while self.take("word", word):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def either(self) -> Node:
        return self.chain("OR", "or", self.both)

    def both(self) -> Node:
        return self.chain("AND", "and", self.negation)

    def negation(self) -> Node:
        return Node("not", (self.negation(),)) if self.take("word", "NOT") else self.leaf()

    def leaf(self) -> Node:
        if self.take("mark", "("):
            inside = self.either()
            self.need("mark", ")", "')'")
            return inside
        start = self.tokens[self.at][2]
        word = self.take("word")
        if word == "task":
            return Node("task")
        if word in ("tag", "TAGSET", "TAGONLY", "scope"):
            names = []
            for _ in range(2 if word.startswith("TAG") else 1):
                self.need("mark", ":", "':'")
                names.append(self.need("word", None, "a name"))
            if word == "scope" and names[0] not in ("local", "parent"):
                raise ConditionError(f"a scope is local or parent, not {names[0]!r}", start)
            return Node(word, tuple(names))
        if word == "provider":
            self.need("mark", ":", "':'")
            parts = [self.need("word", None, "a provider")]
            while self.take("mark", "."):
                parts.append(self.need("word", None, "a name after '.'"))
            return Node("provider", (".".join(parts),))
        if word in PREDICATES:
            names = []
            while self.take("mark", ":"):
                names.append(self.need("word", None, "a name"))
            return Node("predicate", (word, *names))
        raise ConditionError("unexpected end" if word is None and self.tokens[self.at][0] == "end" else f"unexpected {word or self.tokens[self.at][1]!r}", start)


def parse(text: str) -> Node:
    parser = _Parser(text)
    if parser.tokens[0][0] == "end":
        raise ConditionError("empty condition", 0)
    out = parser.either()
    if parser.tokens[parser.at][0] != "end":
        raise ConditionError(f"unexpected {parser.tokens[parser.at][1]!r}", parser.tokens[parser.at][2])
    return out


def provider_base(provider: str) -> str:
    """A provider without the last part that names its medium."""
    return next((provider[: -len(m)] for m in MEDIA if provider.endswith(m)), provider)


@dataclass
class Context:
    active: set[str] = field(default_factory=set)
    tagsets: Mapping[str, set[str]] = field(default_factory=lambda: {})
    origin: str = ""
    task: str | None = None
    provider: str | None = None


#: Other leaves, ``word:name:name``: ``f(names, context) -> bool``.
PREDICATES: dict[str, Callable[[tuple[str, ...], Context], bool]] = {}


def register(word: str, f: Callable[[tuple[str, ...], Context], bool]) -> None:
    """Adds a kind of leaf. Its function must be one that workers can import or be sent."""
    PREDICATES[word] = f


def evaluate(node: Node | str, ctx: Context) -> bool:
    node = parse(node) if isinstance(node, str) else node
    a = node.args
    match node.kind:
        case "and":
            return all(evaluate(x, ctx) for x in a)
        case "or":
            return any(evaluate(x, ctx) for x in a)
        case "not":
            return not evaluate(a[0], ctx)
        case "tag":
            return a[0] in ctx.active
        case "TAGSET":
            # True as long as nothing of the set is chosen.
            chosen = set(ctx.tagsets.get(a[0], ())) & ctx.active
            return not chosen or a[1] in chosen
        case "TAGONLY":
            return set(ctx.tagsets.get(a[0], ())) & ctx.active == {a[1]}
        case "scope":
            return (ctx.origin not in ("", "self")) == (a[0] == "parent")
        case "task":
            return bool(ctx.task and ctx.task.strip())
        case "provider":
            return bool(ctx.provider) and provider_base(ctx.provider) == a[0]
        case "predicate":
            return bool(PREDICATES[a[0]](tuple(a[1:]), ctx))
    raise ValueError(node.kind)


def bound(ctx: Context):
    """``f(condition) -> bool`` over a copy of the context, which workers can be sent."""
    own, more = Context(set(ctx.active), {k: set(v) for k, v in ctx.tagsets.items()}, ctx.origin, ctx.task, ctx.provider), dict(PREDICATES)

    def holds(condition):
        PREDICATES.update(more)
        return evaluate(condition, own)

    return holds


def column(node: Node | str, active: Column, ctx: Context) -> Column:
    """The condition for rows that carry their own active tags (an array); the rest comes from ``ctx``."""
    node = parse(node) if isinstance(node, str) else node
    a = node.args
    if node.kind in ("and", "or"):
        out = column(a[0], active, ctx)
        for more in a[1:]:
            out = (out & column(more, active, ctx)) if node.kind == "and" else (out | column(more, active, ctx))
        return out
    if node.kind == "not":
        return ~column(a[0], active, ctx)
    if node.kind == "tag":
        return F.array_contains(active, a[0])
    if node.kind in ("TAGSET", "TAGONLY"):
        names = sorted(ctx.tagsets.get(a[0], ()))
        if not names:
            return F.lit(node.kind == "TAGSET")
        chosen = F.array_intersect(active, F.array(*[F.lit(n) for n in names]))
        own = F.array_contains(chosen, a[1])
        return (F.size(chosen) == 0) | own if node.kind == "TAGSET" else (F.size(chosen) == 1) & own
    return F.lit(evaluate(node, ctx))
