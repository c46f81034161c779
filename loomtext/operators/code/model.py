"""Elements, imports, spans and edits of one source text, all in character offsets."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field


@dataclass
class Element:
    kind: str
    name: str
    start: int
    end: int
    public: bool = True
    body: tuple[int, int] | None = None
    decorators: tuple[str, ...] = ()
    docstring: tuple[int, int] | None = None
    parent: str | None = None


@dataclass
class Import:
    module: str
    items: tuple[str, ...]
    external: bool
    start: int
    end: int
    wildcard: bool = False
    aliases: dict[str, str] = field(default_factory=dict)


@dataclass(slots=True)
class Span:
    """A comment or a string: ``kind`` is line, block, doc, docstring or string."""

    kind: str
    start: int
    end: int
    inner: tuple[int, int]


@dataclass(slots=True)
class Edit:
    start: int
    end: int
    text: str = ""
    kind: str = ""
    action: str = "omitted"
    count: int = 1
    lines: int = 0
    mark: bool = True


def settle(edits: list[Edit]) -> list[Edit]:
    """Of overlapping edits the strictly wider one stays, the first of equals; what an edit covers goes with it."""
    out: list[Edit] = []
    taken: list[tuple[int, int]] = []  # in order and apart, so that only neighbours can overlap
    for e in sorted(edits, key=lambda e: e.start - e.end):
        at = bisect_left(taken, (e.start, e.end))
        if all(e.end <= a or e.start >= b for a, b in taken[max(0, at - 1) : at + 1]):
            taken.insert(at, (e.start, e.end))
            out.append(e)
    return sorted(out, key=lambda e: e.start)


class Cover:
    """Edits that are in order and apart, asked which of them another lies in."""

    def __init__(self, edits: list[Edit]):
        self.starts, self.ends = [e.start for e in edits], [e.end for e in edits]

    def __contains__(self, e: Edit) -> bool:
        at = bisect_left(self.starts, e.start + 1) - 1
        return at >= 0 and e.end <= self.ends[at]


def collapse(text: str, edits: list[Edit]) -> list[Edit]:
    """Neighbouring marked removals of the same kind in the same column, with only white space between, become one."""
    out: list[Edit] = []
    for e in edits:
        last = out[-1] if out else None
        column = lambda at: at - (text.rfind("\n", 0, at) + 1)
        if (
            last and last.mark and e.mark and not last.text and not e.text and (last.kind, last.action) == (e.kind, e.action) and not e.kind.endswith("_body")
            and not text[last.end : e.start].strip() and column(last.start) == column(e.start)
        ):
            out[-1] = Edit(last.start, e.end, "", e.kind, e.action, last.count + e.count, last.lines + e.lines)
        else:
            out.append(e)
    return out


def apply(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for e in edits:
        parts += [text[at : e.start], e.text]
        at = e.end
    return "".join([*parts, text[at:]])


def outermost(elements: list[Element]) -> list[Element]:
    """Without the elements that lie in another of them; one sweep over starts."""
    out: list[Element] = []
    for e in sorted(elements, key=lambda e: (e.start, -e.end)):
        if not out or e.end > out[-1].end:
            out.append(e)
    return out
