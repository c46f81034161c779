"""The template language: placeholders ``${…}``, directives ``{% … %}`` and comments ``{# … #}``.

Templates are parsed and evaluated on the driver: they hold no data, only which fragments come in which order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml

from loomtext.functions.markdown import Document, parse as parse_markdown
from loomtext.operators import conditions, lookup
from loomtext.plans.adaptive import Model


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """``kind``: text, section, include, md, task, if or mode. ``args`` depends on it; ``branches`` are ``(condition or None, nodes)``."""

    kind: str
    args: dict = field(default_factory=dict)
    branches: list[tuple[str | None, list[Node]]] = field(default_factory=list)


_TOKEN = re.compile(r"\{#.*?#\}|\{%-?\s*(?P<directive>.*?)\s*-?%\}|\$\{(?P<hole>[^{}\n]*(?:\"(?:\\.|[^\"\\])*\"[^{}\n]*)?)\}", re.DOTALL)
_NAME = r"[\w./-]+"
_REF = re.compile(rf"^(?:@(?:\[[^\]]+\]|[\w./-]+):)?/?{_NAME}$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"'}

#: Placeholder rules by falling priority: ``f(body) -> Node or None``. :func:`register` adds others.
RULES: list[tuple[int, str, Callable[[str], Node | None]]] = []


def register(name: str, priority: int, rule: Callable[[str], Node | None]) -> None:
    """Adds a kind of placeholder; the rule with the highest priority that returns a node wins."""
    RULES.append((priority, name, rule))
    RULES.sort(key=lambda r: (-r[0], r[1]))


#: What other kinds of placeholder become: ``f(args, evaluator) -> text``, by the kind of node; and what is done to a finished document.
EVALUATORS: dict[str, Callable[[dict, Evaluator], str]] = {}
PROCESSORS: list[Callable[[str, Evaluator], str]] = []


def register_evaluator(kind: str, f: Callable[[dict, Evaluator], str]) -> None:
    EVALUATORS[kind] = f


def register_processor(f: Callable[[str, Evaluator], str]) -> None:
    PROCESSORS.append(f)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text, flags=re.DOTALL)


def _task(body: str) -> Node | None:
    if body == "task":
        return Node("task", {"prompt": None})
    if not body.startswith("task:"):
        return None
    m = re.fullmatch(r'task\s*:\s*prompt\s*:\s*"((?:\\.|[^"\\])*)"', body, re.DOTALL)
    if not m:
        raise TemplateError(f"bad task placeholder {body!r}")
    return Node("task", {"prompt": unescaped(m[1])})


def _md(body: str) -> Node | None:
    """``md:path#anchor,level:n,strip_h1:b,if:condition``, ``md@scope:path``."""
    m = re.match(r"md(@(?:\[[^\]]*\]|[^:]+))?:(.*)", body, re.DOTALL)
    if not m:
        return None
    rest, condition = m[2], None
    if (c := re.search(r",\s*if\s*:\s*([^,]*)", rest)) is not None:
        condition, rest = c[1].strip(), rest[: c.start()] + rest[c.end() :]
    a = lookup.parse_address((m[1] + ":" if m[1] else "") + rest.strip())
    p = a["params"]
    if bad := set(p) - {"level", "strip_h1", "anchor"}:
        raise TemplateError(f"unknown parameters of md: {', '.join(sorted(bad))}")
    level = p.get("level")
    if level is not None and not re.fullmatch("[1-6]", level):
        raise TemplateError(f"level is 1 to 6, not {level!r}")
    if p.get("strip_h1") not in (None, "true", "false"):
        raise TemplateError(f"strip_h1 is true or false, not {p['strip_h1']!r}")
    path = a["path"]
    if not re.search(r"\.(md|markdown)$", path) and "*" not in path:
        path += ".md"
    return Node("md", {"origin": a["origin"], "path": path, "absolute": a["absolute"], "anchor": a["anchor"] or p.get("anchor"), "level": int(level) if level else None, "strip_h1": None if p.get("strip_h1") is None else p["strip_h1"] == "true", "if": condition})


def _include(body: str) -> Node | None:
    m = re.match(r"(tpl|ctx)(@(?:\[[^\]]*\]|[^:]+))?:(.+)$", body)
    if not m or not re.fullmatch(rf"/?{_NAME}", m[3].strip()):
        return None
    a = lookup.parse_address((m[2] + ":" if m[2] else "") + m[3].strip())
    return Node("include", {"kind": m[1], "origin": a["origin"], "path": a["path"], "absolute": a["absolute"]})


def _section(body: str) -> Node | None:
    if not _REF.match(body):
        return None
    a = lookup.parse_address(body)
    return Node("section", {"origin": a["origin"], "name": ("/" if a["absolute"] else "") + a["path"]})


register("task", 90, _task)
register("md", 80, _md)
register("include", 70, _include)
register("section", 50, _section)


def hole(body: str) -> Node | None:
    for _, _, rule in RULES:
        node = rule(body)
        if node is not None:
            return node
    return None


def parse(text: str) -> list[Node]:
    """Text that no rule takes stays text; bad directives and bad ``md`` and ``task`` placeholders raise."""
    root: list[Node] = []
    stack: list[tuple[Node | None, list[Node]]] = [(None, root)]
    at = 0

    def put(node):
        here = stack[-1][1]
        if node.kind == "text" and here and here[-1].kind == "text":
            here[-1].args["text"] += node.args["text"]
        elif node.kind != "text" or node.args["text"]:
            here.append(node)

    for m in _TOKEN.finditer(text):
        put(Node("text", {"text": text[at : m.start()]}))
        at = m.end()
        if m["directive"] is not None:
            word, _, rest = m["directive"].partition(" ")
            rest = rest.strip()
            top = stack[-1][0]
            if word == "if":
                conditions.parse(rest)
                stack.append((Node("if", {}, [(rest, [])]), []))
                stack[-1] = (stack[-1][0], stack[-1][0].branches[0][1])
            elif word in ("elif", "else"):
                if top is None or top.kind != "if" or top.branches[-1][0] is None:
                    raise TemplateError(f"{word} without if")
                if word == "elif":
                    conditions.parse(rest)
                top.branches.append((rest if word == "elif" else None, []))
                stack[-1] = (top, top.branches[-1][1])
            elif word == "mode":
                if not re.fullmatch(r"[\w.-]+:[\w.-]+", rest):
                    raise TemplateError(f"mode needs set:mode, not {rest!r}")
                node = Node("mode", dict(zip(("set", "mode"), rest.split(":"), strict=True)), [(None, [])])
                stack.append((node, node.branches[0][1]))
            elif word in ("endif", "endmode"):
                if top is None or top.kind != word[3:]:
                    raise TemplateError(f"{word} without {word[3:]}")
                stack.pop()
                stack[-1][1].append(top)
            else:
                raise TemplateError(f"unknown directive {word!r}")
        elif m["hole"] is not None:
            put(hole(m["hole"].strip()) or Node("text", {"text": m[0]}))
    put(Node("text", {"text": text[at:]}))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} isn't closed")
    return root


def front_matter(text: str) -> tuple[dict, str]:
    """The YAML between leading ``---`` lines and the rest; what isn't a mapping is no front matter."""
    m = re.match(r"---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n|\Z)", text, re.DOTALL)
    if not m:
        return {}, text
    try:
        data = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, text
    if data is not None and not isinstance(data, dict):
        return {}, text
    include = (data or {}).get("include") or []
    return {"include": [include] if isinstance(include, str) else list(include)}, text[m.end() :]


def walk(nodes: list[Node]):
    for node in nodes:
        yield node
        for _, inner in node.branches:
            yield from walk(inner)


@dataclass(frozen=True)
class HeadingContext:
    level: int
    strip_h1: bool
    in_heading: bool = False


def heading_context(text: str, at: int) -> HeadingContext:
    """What a Markdown placeholder at an offset of a template fits under.

    The nearest heading above it, no farther than the nearest rule, sets the level. Placeholders that follow each other
    without a heading between them (a chain) keep their own titles; one that stands alone under a heading loses its own.
    """
    line = text.count("\n", 0, at)
    lines = text.split("\n")
    doc: Document = parse_markdown(text)
    holes = [i for i, x in enumerate(lines) if re.search(r"\$\{md[@:]", x)]
    ruled = [i for i, x in enumerate(lines) if re.fullmatch(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})", x) and not (i and lines[i - 1].strip()) and not any(a <= i < b for a, b in doc.fences)]
    own = next((h for h in doc.headings if h.start == line), None)
    if own is not None and re.match(r" {0,3}#", lines[line]):
        return HeadingContext(own.level, True, True)
    wall = max((r for r in ruled if r < line), default=-1)
    stop = min((r for r in ruled if r > line), default=len(lines))
    above = [h for h in doc.headings if wall < h.start < line]
    if not above:
        return HeadingContext(1, False)
    near = above[-1]
    segment = [i for i in holes if wall < i < stop]
    chain = len(segment) > 1 and not any(segment[0] < h.start < segment[-1] for h in doc.headings)
    return HeadingContext(min(6, near.level + 1), not chain)


@dataclass
class State:
    """What is chosen at a point of a template."""

    tags: set[str]
    modes: dict[str, str]
    vcs_mode: str = "all"


class Evaluator:
    """Evaluates templates of one run. ``load(kind, name, scope)`` gives a template's text and directory; the handlers make texts of sections and Markdown files."""

    def __init__(self, model: Model, modes: dict[str, str], tags: set[str], task: str | None, provider: str | None, load, section, markdown):
        self.model, self.task, self.provider = model, task, provider
        self.load, self.section, self.markdown = load, section, markdown
        chosen = [model.mode(s, m) for s, m in modes.items()]
        vcs = [m.vcs_mode for m in chosen if m.vcs_mode != "all"]
        self.cli_modes = dict(modes)
        self.state = State({*tags, *(t for m in chosen for t in m.tags)}, dict(modes), vcs[-1] if vcs else "all")
        self.scopes: list[tuple[str, str]] = [("self", "")]
        self._including: list[str] = []
        self._memo: dict[str, tuple[list[Node], str, str]] = {}

    def context(self) -> conditions.Context:
        return conditions.Context(self.state.tags, self.model.tagsets, self.scopes[-1][0], self.effective_task(), self.provider)

    def holds(self, condition: str) -> bool:
        return conditions.evaluate(condition, self.context())

    def effective_task(self) -> str | None:
        """The given task, or what the run's modes ask for by default, set by set."""
        if self.task and self.task.strip():
            return self.task
        said = [self.model.mode(s, self.cli_modes[s]).default_task for s in sorted(self.cli_modes)]
        return "\n\n".join(t for t in said if t) or None

    def render(self, kind: str, name: str, origin: str | None = None, absolute: bool = False) -> str:
        scope, directory = self.scopes[-1]
        inner = scope if origin is None else "self" if origin in ("self", "/") else origin
        path = name if absolute or origin else lookup.resolved_path(name, directory)
        key = lookup.frozen([kind, inner, path])
        if key in self._including:
            raise TemplateError("templates include each other: " + " → ".join([*self._including, key]))
        if key not in self._memo:
            text, folder = self.load(kind, path, inner)
            body = front_matter(text)[1]
            self._memo[key] = (parse(body), folder, body)
        nodes, folder, body = self._memo[key]
        self._including.append(key)
        self.scopes.append((inner, folder))
        out = self.evaluate(nodes, body)
        if len(self._including) == 1:
            for f in PROCESSORS:
                out = f(out, self)
        self.scopes.pop()
        self._including.pop()
        return out

    def evaluate(self, nodes: list[Node], body: str) -> str:
        return "".join(self._one(n, body) for n in nodes)

    def _one(self, node: Node, body: str) -> str:
        a = node.args
        match node.kind:
            case "text":
                return a["text"]
            case "task":
                return self.effective_task() or a["prompt"] or ""
            case "section":
                return self.section(a["name"], a["origin"], self)
            case "include":
                return self.render(a["kind"], a["path"], a["origin"], a["absolute"])
            case "md":
                if a["if"] and not self.holds(a["if"]):
                    return ""
                return self.markdown(a, self._place(node, body), self)
            case "if":
                for condition, inner in node.branches:
                    if condition is None or self.holds(condition):
                        return self.evaluate(inner, body)
                return ""
            case "mode":
                mode = self.model.mode(a["set"], a["mode"])
                before = self.state
                # The new mode's tags come on top; those of the old one stay, and so does how changes are filtered.
                self.state = State({*before.tags, *mode.tags}, {**before.modes, a["set"]: a["mode"]}, before.vcs_mode)
                out = self.evaluate(node.branches[0][1], body)
                self.state = before
                return out
        if node.kind in EVALUATORS:
            return EVALUATORS[node.kind](a, self)
        raise TemplateError(f"nothing evaluates {node.kind!r}")

    def _place(self, node: Node, body: str) -> HeadingContext:
        at = next((m.start() for m in _TOKEN.finditer(body) if m["hole"] is not None and hole(m["hole"].strip()) == node), 0)
        return heading_context(body, at)


def collected(kind: str, name: str, load, scope: str = "self") -> tuple[list[tuple[str, str]], list[str]]:
    """All ``(scope, section)`` that a template and what it includes refer to in any branch, and its front matter's sections."""
    seen: set[str] = set()
    sections: dict[tuple[str, str], None] = {}
    front: dict[str, None] = {}

    def visit(kind, path, scope):
        key = lookup.frozen([kind, scope, path])
        if key in seen:
            return
        seen.add(key)
        text, folder = load(kind, path, scope)
        meta, body = front_matter(text)
        for ref in meta.get("include", []):
            front[ref] = None
        for node in walk(parse(body)):
            a = node.args
            inner = scope if a.get("origin") is None else a["origin"]
            if node.kind == "section":
                sections[(inner, a["name"] if a["origin"] or a["name"].startswith("/") or not folder else f"{folder}/{a['name']}")] = None
            elif node.kind == "include":
                visit(a["kind"], a["path"] if a["absolute"] or a["origin"] else lookup.resolved_path(a["path"], folder), inner)

    visit(kind, name, scope)
    return list(sections), list(front)
