"""Reducing a source text: public API, bodies, comments, imports, literals, a token budget."""

from __future__ import annotations

import copy
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping

from loomtext.operators.code import model, reading
from loomtext.operators.code.languages import LANGUAGES
from loomtext.operators.code.model import Edit, Element, Span
from loomtext.operators.intervals import skip_fit

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
IRREGULAR = {"class": "classes", "body": "bodies", "property": "properties", "entry": "entries"}
LADDER = (512, 256, 128, 64, 32)
STEPS = tuple("imports_external literals comments imports_local private_bodies public_api_only public_bodies docstrings_first_sentence".split())


class OptionError(ValueError):
    pass


_WORD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
_KINDS = bytes(119 if c in _WORD else 32 for c in range(256))
_BLANK = bytes(c for c in range(128) if chr(c).isspace())


def count_tokens(text: str) -> int:
    if text.isascii():
        data = text.encode()
        kinds = data.translate(_KINDS)  # w for each character of a word
        return kinds.count(b" w") + kinds.startswith(b"w") + len(data.translate(None, _WORD + _BLANK))
    return len(TOKEN.findall(text))


def _choice(value, allowed: tuple[str, ...], what: str):
    if value not in allowed:
        raise OptionError(f"{what} is one of {', '.join(allowed)}, not {value!r}")
    return value


def options(given: Mapping | None) -> dict:
    """All options with their defaults; short forms are spelled out."""
    g = dict(given or {})
    bodies = g.get("strip_function_bodies", False)
    bodies = {"policy": "strip_all" if bodies else "keep_all"} if isinstance(bodies, bool) else dict(bodies)
    comments = g.get("comment_policy", "keep_all")
    comments = {"policy": comments} if isinstance(comments, str) else dict(comments)
    imports, literals, places, budget = (dict(g.get(k) or {}) for k in ("imports", "literals", "placeholders", "budget"))
    return {
        "public_api_only": bool(g.get("public_api_only", False)),
        "skip_trivial_files": bool(g.get("skip_trivial_files", True)),
        "bodies": {"policy": _choice(bodies.get("policy", "keep_all"), ("keep_all", "strip_all", "keep_public"), "strip_function_bodies.policy"), "max_tokens": bodies.get("max_tokens"), "except": list(bodies.get("except_patterns") or []), "annotated": list(bodies.get("keep_annotated") or [])},
        "comments": {"policy": _choice(comments.get("policy", "keep_all"), ("keep_all", "strip_all", "keep_doc", "keep_first_sentence"), "comment_policy"), "max_tokens": comments.get("max_tokens"), "keep": list(comments.get("keep_annotations") or []), "strip": list(comments.get("strip_patterns") or [])},
        "imports": {"policy": _choice(imports.get("policy", "keep_all"), ("keep_all", "strip_all", "strip_external", "strip_local"), "imports.policy"), "summarize": bool(imports.get("summarize_long", False)), "most": int(imports.get("max_items_before_summary", 10)), "external": list(imports.get("external_only_patterns") or [])},
        "literals": {"max_tokens": literals.get("max_tokens")},
        "placeholders": {"ratio": float(places.get("min_savings_ratio", 2.0)), "least": int(places.get("min_abs_savings_if_none", 5))},
        "budget": {"max_tokens": budget.get("max_tokens_per_file"), "order": list(budget.get("priority_order") or STEPS)},
    }


def plural(word: str, n: int) -> str:
    head, _, last = word.rpartition(" ")
    if n != 1:
        last = IRREGULAR.get(last) or (last + "es" if re.search("(s|x|z|ch|sh)$", last) else last[:-1] + "ies" if re.search("[^aeiou]y$", last) else last + "s")
    return f"{head} {last}".strip()


def placeholder(e: Edit) -> str:
    number = f"{e.count} " if e.count > 1 else ""
    extent = f" ({e.lines} lines)" if e.lines > 1 else ""
    return f"… {number}{plural(e.kind.replace('_', ' '), e.count)} {e.action}{extent}"


def economical(removed: str, shown: str, ratio: float, least: int, count: Callable[[str], int]) -> bool:
    before, after = count(removed), count(shown)
    saved = max(0, before - after)
    return saved > 0 and saved / max(after, 1) >= ratio and (bool(shown) or saved >= least)


def _line_start(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _filled_lines(text: str) -> int:
    return sum(bool(x.strip()) for x in text.split("\n"))


_COMMENTS = frozenset(("line", "block", "doc"))


def with_comments(text: str, e: Element, found: list[Span]) -> tuple[int, int]:
    """An element with the comments directly above it and the one after it on its last line."""
    start, end = e.start, e.end
    for k in range(bisect_right(found, start, key=lambda s: s.end) - 1, -1, -1):
        s = found[k]
        if s.kind not in _COMMENTS or text[s.end : start].strip() or text.count("\n", s.end, start) > 1 or text[_line_start(text, s.start) : s.start].strip():
            break
        start = s.start
    k = bisect_left(found, end, key=lambda s: s.start)
    if k < len(found) and found[k].kind in _COMMENTS:
        s = found[k]
        if not text[end : s.start].strip(" \t;,") and "\n" not in text[end : s.start]:
            end = s.end
    return start, end


class Source:
    """One text while it is reduced; reading happens when it is first needed."""

    def __init__(self, text: str, language: str, count: Callable[[str], int] = count_tokens):
        self.text, self.language, self.count = text, language, count
        self._memo: dict = {}
        self.edits: list[Edit] = []
        self.metrics: dict[str, int] = {}
        # Steps of a budget remove much that the steps before removed: what came of the last, what each part of the options removes, and what is shown for each edit.
        self.last: tuple | None = None
        self.parts: dict[tuple[str, str], tuple[list[Edit], dict[str, int]]] = {}
        self.shown: dict[tuple, Edit | None] = {}

    def _once(self, name, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def spans(self) -> list[Span]:
        return self._once("spans", lambda: reading.spans(self.text, self.language))

    @property
    def elements(self) -> list[Element]:
        return self._once("elements", lambda: reading.elements(self.text, self.language, None if self.language == "python" else self.code))

    @property
    def imports(self):
        return self._once("imports", lambda: reading.imports(self.text, self.language, None if self.language == "python" else self.spans))

    @property
    def code(self) -> str:
        return self._once("code", lambda: self.plain.code if self.plain else reading.blanked(self.text, self.spans))

    @property
    def plain(self) -> reading.Plain | None:
        return self._once("plain", lambda: reading.simple(self.text) if self.language == "python" else None)

    @property
    def brackets(self) -> reading.Brackets:
        return self._once("brackets", lambda: reading.Brackets(self.code))

    @property
    def largest(self) -> int:
        """Characters in the longest string, run of joined strings or pair of brackets; no literal has more tokens."""
        return self._once("largest", self._largest)

    def _largest(self) -> int:
        if self.plain is not None:
            quoted = len(self.text) if self.plain.inside is None else max(map(len, self.plain.inside), default=0)
        elif self.language in ("python", "c", "cpp") and self._once("joined", lambda: _joined_strings(self)):
            quoted = len(self.text)
        else:
            quoted = max((s.inner[1] - s.inner[0] for s in self.spans if s.kind == "string"), default=0)
        return max(quoted, self.brackets.longest)

    def size(self, start: int, end: int) -> int:
        """Tokens of a part of the text; under a budget the same parts are asked for at every step."""
        return self._once((start, end), lambda: self.count(self.text[start:end]))

    def above(self, start: int, end: int, most: int) -> bool:
        """Whether a part has more than so many tokens. The built-in counter finds none without a character."""
        return (end - start > most or self.count is not count_tokens) and self.size(start, end) > most

    def note(self, key: str, n: int = 1) -> None:
        key = f"{self.language}.removed.{key}"
        self.metrics[key] = self.metrics.get(key, 0) + n

    def remove(self, start: int, end: int, kind: str, text: str = "", action: str = "omitted", mark: bool = True) -> None:
        if end > start:
            self.edits.append(Edit(start, end, text, kind, action, 1, _filled_lines(self.text[start:end]), mark))
            self.note(kind)


def public_api(src: Source) -> None:
    """Outermost private elements go, with their comments."""
    hidden = [e for e in src.elements if not e.public]
    for e in model.outermost(hidden):
        src.remove(*with_comments(src.text, e, src.spans), e.kind)


def bodies(src: Source, o: Mapping) -> None:
    """Bodies of more than one line; a docstring stays, and with a cap so do whole leading lines and a final return."""
    if o["policy"] == "keep_all" and o["max_tokens"] is None:
        return
    for e in model.outermost([e for e in src.elements if e.body]):
        if any(re.search(p, e.name) for p in o["except"]) or any(re.search(p, d) for p in o["annotated"] for d in e.decorators):
            continue
        if o["policy"] == "keep_public" and e.public:
            continue
        start, end = e.body
        inside = src.text[start:end]
        if not inside.strip() or "\n" not in src.text[e.start : e.end]:
            continue
        if src.language == "python":
            start += len(inside) - len(inside.lstrip("\n"))
            if src.text.count("\n", start, end) < 1:
                continue
        else:
            start = start + 1 if src.text[start : start + 1] == "\n" else start
            end = _line_start(src.text, end) if not src.text[_line_start(src.text, end) : end].strip() else end
        kind = f"{'method' if e.kind in ('method', 'constructor', 'getter', 'setter') else 'function'}_body"
        if o["policy"] in ("strip_all", "keep_public"):
            src.remove(start, end, kind)
        else:
            cut = _trimmed_body(src, start, end, o["max_tokens"])
            if cut:
                src.remove(*cut, kind, action="truncated")


def _trimmed_body(src: Source, start: int, end: int, most: int) -> tuple[int, int] | None:
    body = src.text[start:end]
    if src.count(body) <= most:
        return None
    lines = body.splitlines(keepends=True)
    last = next((i for i in range(len(lines) - 1, -1, -1) if lines[i].strip()), 0)
    keep_last = bool(re.match(r"\s*return\b", lines[last])) or (src.language == "rust" and not lines[last].rstrip().endswith((";", "}")))
    tail = "".join(lines[last:]) if keep_last else ""
    left = most - src.count(tail)
    kept = 0
    for line in lines[: last if keep_last else len(lines)]:
        left -= src.count(line)
        if left < 0:
            break
        kept += len(line)
    a, b = start + kept, end - len(tail)
    return (a, b) if src.text[a:b].strip() else None


def first_sentence(text: str) -> str:
    parts = re.split(r"[.!?]+", text)
    whole = [p.strip() for p in parts if p.strip()]
    if len(parts) >= 2 and whole:
        return whole[0]
    return next((x.strip() for x in text.splitlines() if x.strip()), text)


def comments(src: Source, o: Mapping) -> None:
    """Patterns to strip beat annotations to keep, which beat the policy; then the cap on what stays."""
    policy, text = o["policy"], src.text
    if policy == "keep_all" and o["max_tokens"] is None and not o["strip"]:
        return
    for s in src.spans:
        if s.kind == "string":
            continue
        body, doc = text[s.start : s.end], s.kind in ("doc", "docstring")
        keep: bool | str = True
        if any(re.search(p, body) for p in o["strip"]):
            keep = False
        elif any(re.search(p, body) for p in o["keep"]):
            keep = True
        elif policy == "strip_all":
            keep = False
        elif policy == "keep_doc":
            keep = doc
        elif policy == "keep_first_sentence":
            keep = _short(src, s) if doc else False
        if keep is True and o["max_tokens"] is not None and src.count(body) > o["max_tokens"]:
            keep = _capped(src, s, o["max_tokens"])
        if keep is True:
            continue
        kind = "docstring" if doc else "comment"
        if keep:
            if keep != body:
                src.remove(s.start, s.end, kind, keep, "truncated", mark=False)
        else:
            src.remove(s.start, s.end, kind)


def _wrap(src: Source, s: Span, content: str) -> str:
    whole = src.text[s.start : s.end]
    if s.kind == "docstring" or s.kind == "string":
        a, b = s.inner
        return src.text[s.start : a] + content + src.text[b : s.end]
    if whole.startswith("/*"):
        return f"{re.match(r'/[*!]+', whole)[0]} {content} */"
    return f"{re.match(r'(//[/!]?|#)', whole)[0]} {content}"


def _inside(src: Source, s: Span) -> str:
    body = src.text[s.inner[0] : s.inner[1]]
    if s.kind in ("doc", "block"):
        body = "\n".join(x for x in (re.sub(r"^[*/!]+", "", line.strip()).strip() for line in body.split("\n")) if x)
    return body


def _short(src: Source, s: Span) -> str:
    body = _inside(src, s)
    short = first_sentence(body)
    if short == body.strip():
        return src.text[s.start : s.end]
    return _wrap(src, s, short.strip() + ("." if re.search(r"[.!?]", body) else ""))


def _capped(src: Source, s: Span, most: int) -> str:
    body = _inside(src, s).strip()
    n = max(1, src.count(body))
    return _wrap(src, s, body[: max(1, len(body) * most // n)].rstrip() + "…")


def imports(src: Source, o: Mapping) -> None:
    if o["policy"] == "keep_all" and not o["summarize"]:
        return
    found = src.imports
    for i in found:
        if any(re.search(p, i.module) for p in o["external"]):
            i.external = True
    gone = set()
    for k, i in enumerate(found):
        if o["policy"] == "strip_all" or (o["policy"] == "strip_external" and i.external) or (o["policy"] == "strip_local" and not i.external):
            gone.add(k)
    if o["summarize"]:
        base = lambda m: m.split("/")[0] if "/" in m else ".".join(m.split(".")[:2])
        run: list[int] = []
        for k in range(len(found) + 1):
            joins = k < len(found) and run and base(found[k].module) == base(found[run[-1]].module) and not src.text[found[run[-1]].end : found[k].start].strip()
            if not joins:
                if len(run) > o["most"]:
                    gone.update(run)
                run = []
            if k < len(found):
                run.append(k)
                if len(found[k].items) > o["most"]:
                    gone.add(k)
    for k in sorted(gone):
        src.remove(found[k].start, found[k].end, "import")


def split_elements(content: str) -> list[tuple[int, int]]:
    """The top-level elements of a collection's inside, as offsets; commas in brackets and quotes don't count."""
    return list(_split(content))


_PARTING = re.compile(r"[\"'`(\[{)\]},;]")
_ENDING = {q: re.compile(rf"{q}|\\") for q in "\"'`"}


def _split(content: str) -> Iterator[tuple[int, int]]:
    depth, start, i, n = 0, 0, 0, len(content)
    while i < n and (m := _PARTING.search(content, i)):
        c, i = m[0], m.end()
        if c in _ENDING:
            while i < n and (m := _ENDING[c].search(content, i)) and m[0] != c:
                i = m.end() + 1
            i = m.end() if i < n and m else n
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0:
            yield from _stripped(content, start, i - 1)
            start = i
    yield from _stripped(content, start, n)


def _stripped(content: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    part = content[a:b].lstrip()
    if part:
        yield b - len(part), b


def _parts(src: Source, start: int, end: int) -> Iterator[tuple[int, int]]:
    """:func:`split_elements` of a part of the text with comments and strings blanked, read only as far as is asked for."""
    done, size = 0, 1 << 8
    while True:
        cut = min(end, start + size)
        quoted = src.plain.quoted(start, cut) if src.plain else None
        if quoted is None:
            k = bisect_left(src.spans, cut, key=lambda s: s.end)
            if cut < end and k < len(src.spans) and src.spans[k].start < cut:
                cut = max(start, src.spans[k].start)  # not within a comment or string
            quoted = _quoted(src, start, cut)
        parts = list(_split(quoted))
        if cut == end:
            yield from parts[done:]
            return
        yield from parts[done:-1]  # the last may go on
        done, size = max(done, len(parts) - 1), size * 4


def _balanced_cut(text: str, at: int, marks: tuple[str, ...]) -> int:
    """``at``, or the start of the interpolation it would cut."""
    for mark in (*marks, "{"):
        a = text.rfind(mark, 0, at)
        if a >= 0 and text.count("{", a, at) > text.count("}", a, at):
            return _balanced_cut(text, a, marks)
    return at


#: Other ways to shorten a string: ``f(text with its quotes, most tokens, count) -> text or None``, by language. None leaves it to what is built in.
LITERALS: dict[str, list[Callable[[str, int, Callable[[str], int]], str | None]]] = {}


def register_literal(language: str, f: Callable[[str, int, Callable[[str], int]], str | None]) -> None:
    LITERALS.setdefault(language, []).append(f)


_INDEXING = re.compile(r"[\w\])]$")
_NO_INDEXING = re.compile(r"\b(return|in|yield|case)$|!$")


def literals(src: Source, o: Mapping) -> None:
    """Strings, collections and factory calls above the cap keep a prefix; what is nested in a trimmed one goes with it."""
    most = o["max_tokens"]
    if most is None:
        return
    if src.count is count_tokens and src.largest <= most:
        return
    lang, text, code = LANGUAGES[src.language], src.text, src.code
    short = src.plain is not None and src.count is count_tokens and src.plain.inside is not None and all(count_tokens(x) <= most for x in src.plain.inside if len(x) > most)
    joined = src._once("joined", lambda: _joined_strings(src)) if src.language in ("python", "c", "cpp") and not short else {}
    for s in () if short else src.spans:
        if s.kind == "string" and src.above(*s.inner, most) and id(s) not in joined:
            own = next((x for x in (f(text[s.start : s.end], most, src.count) for f in LITERALS.get(src.language, ())) if x is not None), None)
            if own is not None:
                src.remove(s.start, s.end, "literal_string", own, "truncated", mark=False)
                continue
            body = text[s.inner[0] : s.inner[1]]
            at = max(1, len(body) * max(0, most - 1) // src.size(*s.inner))
            src.remove(s.start, s.end, "literal_string", _cut_string(src, s, at), "truncated", mark=False)
    for group in {id(g): g for g in joined.values()}.values():
        _trim_joined(src, group, most)
    # In Python nothing declared begins right after a bracket.
    declared = set() if src.language == "python" and not reading.odd_lines(text) else {(e.body or (e.start,))[0] for e in src.elements}
    opens = [m.start() for m in re.finditer("|".join(re.escape(c) for c in lang.collections), code)] if lang.collections else []
    for f in lang.factories:
        opens += [m.end() - 1 for m in re.finditer(rf"(?<![\w.]){re.escape(f)}(?:\[[^\]]*\]|<[^>]*>)?\s*[(\[]", code)]
    blocks = _initialiser_blocks(src) if src.language == "java" else {}
    for at in sorted(set(opens)):
        end = src.brackets(at)
        if at in blocks:
            if blocks[at] is not None:
                _trim_block(src, *blocks[at], most)
            continue
        if not src.above(at + 1, end - 1, most):
            continue
        before = code[_line_start(code, at) : at].rstrip()
        if code[at] in "{(" and not _is_literal(src, at, before, declared):
            continue
        if code[at] == "[" and _INDEXING.search(before) and not _NO_INDEXING.search(before):
            continue
        inside = text[at + 1 : end - 1]
        parts, used, more_left = [], 0, False
        for a, b in _parts(src, at + 1, end - 1):
            used += src.size(at + 1 + a, at + 1 + b)
            parts.append((a, b))
            if len(parts) > 1 and used > most:
                more_left = True
                break
        if not more_left:
            continue
        kept = len(parts) - 1
        cut = at + 1 + parts[kept - 1][1]
        tail = inside[len(inside.rstrip()) :]
        many = "\n" in inside
        indent = re.match(r"[ \t]*", text[_line_start(text, at + 1 + parts[min(1, len(parts) - 1)][0]) :])[0] if many else ""
        mark = "#" if src.language == "python" else "//"
        note = f"(−{src.count(text[cut : end - 1])} tokens)"
        more = f",\n{indent}{mark} … {note}" if many else (', "…"' if src.language in ("python", "javascript", "typescript") else f", /* … {note} */")
        src.remove(cut, end - 1, "literal", more + tail, "truncated", mark=False)


def _cut_string(src: Source, s: Span, at: int) -> str:
    """A string whose content is cut at ``at`` or a little before: in no interpolation and after no lone backslash."""
    text, body = src.text, src.text[s.inner[0] : s.inner[1]]
    fmt = text[s.start : s.inner[0]].lower().startswith(("f", "rf", "fr")) or text[s.start : s.start + 1] == "`" or src.language in ("kotlin", "scala")
    at = _balanced_cut(body, at, LANGUAGES[src.language].interpolation) if fmt else at
    while at and body[at - 1] == "\\":
        at -= 1
    return text[s.start : s.inner[0]] + body[:at] + "…" + text[s.inner[1] : s.end]


def _joined_strings(src: Source) -> dict[int, list[Span]]:
    """Strings that the language joins because only white space is between them: the group of each, by the span's identity."""
    out: dict[int, list[Span]] = {}
    text, group = src.text, []
    for s in src.spans:
        if s.kind != "string":
            continue
        if group and _joins(src, text, group[-1].end, s.start):
            group.append(s)
            continue
        if len(group) > 1:
            out |= {id(m): group for m in group}
        group = [s]
    return out | {id(m): group for m in group} if len(group) > 1 else out


def _joins(src: Source, text: str, end: int, start: int) -> bool:
    first = text[end : end + 1]
    if end < start and first != "\\" and not first.isspace():
        return False
    between = text[end:start].replace("\\\n", "")
    # In Python a line may end between them only inside brackets; there the next string would begin another statement otherwise.
    return not between.strip() and not (src.language == "python" and "\n" in between and not _in_brackets(src, start))


def _in_brackets(src: Source, at: int) -> bool:
    """Whether a bracket is open at a place, whatever its kind."""
    places, depths = src._once("depths", lambda: _depths(src.code))
    k = bisect_left(places, at) - 1
    return k >= 0 and depths[k] > 0


def _depths(code: str) -> tuple[list[int], list[int]]:
    places, depths, depth = [], [], 0
    for m in re.finditer(r"[()\[\]{}]", code):
        depth = depth + 1 if m[0] in "([{" else max(0, depth - 1)
        places.append(m.start())
        depths.append(depth)
    return places, depths


def _trim_joined(src: Source, group: list[Span], most: int) -> None:
    """Joined strings are one literal: parts stay while they fit, the part that doesn't is cut, and those after it go."""
    sizes = [src.count(src.text[s.inner[0] : s.inner[1]]) for s in group]
    if sum(sizes) <= most:
        return
    left = most - 1
    for s, size in zip(group, sizes, strict=True):
        if size > left:
            body = src.text[s.inner[0] : s.inner[1]]
            shown = _cut_string(src, s, max(0 if s is not group[0] else 1, len(body) * max(0, left) // max(1, size)))
            src.remove(s.start, group[-1].end, "literal_string", shown, "truncated", mark=False)
            return
        left -= size


def _initialiser_blocks(src: Source) -> dict[int, tuple[int, int] | None]:
    """Double braces after ``new T(…)``: the inner block of each by its place; the outer brace is there without one, being no collection."""
    out: dict[int, tuple[int, int] | None] = {}
    for m in re.finditer(r"\bnew\s+[\w.]+(?:<[^;{}()]*>)?\s*\(", src.code):
        after = src.brackets(m.end() - 1)
        double = re.compile(r"\s*(\{)\s*(\{)").match(src.code, after)
        if double:
            out[double.start(1)] = None
            out[double.start(2)] = (double.start(2), src.brackets(double.start(2)))
    return out


def _trim_block(src: Source, start: int, end: int, most: int) -> None:
    """Statements of a block initialiser stay while they fit: the first, and any later one for which there is room."""
    text, inside = src.text, src.text[start + 1 : end - 1]
    if src.count(inside) <= most:
        return
    found, depth, at = [], 0, 0
    quoted = _quoted(src, start + 1, end - 1)
    for i, c in enumerate(quoted):
        depth += (c in "([{") - (c in ")]}")
        if c == ";" and depth == 0:
            found.append((at + len(quoted[at:i]) - len(quoted[at:i].lstrip()), i + 1))
            at = i + 1
    keep = trimmed_statements([inside[a:b] for a, b in found], most, src.count)
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and not keep[j]:
            j += 1
        if j > i:
            a, b = start + 1 + found[i][0], start + 1 + found[j - 1][1]
            src.remove(a, b, "literal", f"/* … {j - i} {plural('statement', j - i)} (−{src.count(text[a:b])} tokens) */", "truncated", mark=False)
        i = max(j, i + 1)


def _quoted(src: Source, start: int, end: int) -> str:
    """The text with comments blanked and strings as words, so that splitting sees neither's commas."""
    parts, at = [], start
    for k in range(bisect_left(src.spans, start, key=lambda s: s.start), len(src.spans)):
        s = src.spans[k]
        if s.start >= end:
            break
        if at <= s.start and s.end <= end:
            parts += [src.text[at : s.start], ("x" if s.kind in ("string", "docstring") else " ") * (s.end - s.start)]
            at = s.end
    return "".join([*parts, src.text[at:end]])


def _is_literal(src: Source, at: int, before: str, declared: set[int]) -> bool:
    """Whether a brace or parenthesis opens a collection and not a block or a call."""
    c = src.code[at]
    if at + 1 in declared:
        return False
    if c == "(":
        return src.language == "python" and bool(re.search(r"(^|[=(\[{,:]|\b(return|in|yield))$", before)) or any(re.search(rf"{re.escape(f)}(?:\[[^\]]*\]|<[^>]*>)?$", before) for f in LANGUAGES[src.language].factories)
    if src.language in ("python", "javascript", "typescript"):
        return bool(re.search(r"([=(\[{,:?]|\b(return|in|yield|default))$", before)) and not before.endswith("=>")
    return bool(re.search(r"([=({,]|\]\w*|\breturn|\w\[\]|map\[[^\]]*\][\w.*\[\]]*)$", before))


def trimmed_statements(statements: list[str], budget: int, count: Callable[[str], int] = count_tokens) -> list[bool]:
    """Which statements of a block initialiser stay: the first, and any later one that still fits."""
    return skip_fit([count(s) for s in statements], budget)


def finish(src: Source, ratio: float, least: int) -> str:
    """Settles overlaps, merges neighbours, and puts placeholders where they pay; what doesn't pay stays, and gives way to the edits inside it."""
    edits = list(src.edits)
    while True:
        settled = model.settle(edits)
        done, refused = [], []
        for e in model.collapse(src.text, settled):
            key = ratio, least, _key(e)
            if key not in src.shown:
                src.shown[key] = _shown(src, e, ratio, least)
            made = src.shown[key]
            (refused if made is None else done).append(e if made is None else made)
        if not refused:
            break
        back = model.Cover(refused)
        out = [e for e in settled if e in back]
        gone, over = {_key(e) for e in out}, model.Cover(out)
        edits = [e for e in edits if _key(e) not in gone]
        if not any(e in over for e in edits):
            break
    src.metrics[f"{src.language}.edits"] = len(done)
    return model.apply(src.text, done)


def _key(e: Edit) -> tuple:
    return e.start, e.end, e.text, e.kind, e.action, e.count, e.lines, e.mark


def _shown(src: Source, e: model.Edit, ratio: float, least: int) -> model.Edit | None:
    """An edit with the text that takes its place; None where it doesn't pay."""
    mark, text = LANGUAGES[src.language].line_comments[0], src.text
    if not e.mark:
        return e if src.count(e.text) < src.count(text[e.start : e.end]) else None
    head, rest = text[_line_start(text, e.start) : e.start], text[e.end : _line_end(text, e.end)]
    first = text[e.start : e.end]
    indent = re.match(r"[ \t]*", first if not head.strip() and first[:1] in " \t" else head)[0]
    words = placeholder(e)
    if src.language == "python" and e.kind == "docstring":
        shown = f'"""{words}."""'
    elif rest.strip() and mark != "#":
        shown = f"/* {words} */"
    elif head.strip() and not head.rstrip().endswith(("{", ":")) and "\n" not in first:
        shown = f"{mark} {words}"
    else:
        shown = ("" if head.strip() or head == indent else indent) + f"{mark} {words}" + ("\n" if first.endswith("\n") else "")
    if rest.strip() and mark == "#" and not first.endswith("\n"):
        shown = "" if not rest.lstrip().startswith(";") else shown
    return Edit(e.start, e.end, shown, e.kind) if economical(first, shown, ratio, least, src.count) else None


def reduced(src: Source, o: Mapping) -> tuple[str, dict]:
    """One pass; what was read of the text, and what each part of the options removes, is kept for the next."""
    parts = []
    for key, (name, run) in zip(o.get("keys") or _keys(o), _PARTS.items(), strict=True):
        if key not in src.parts:
            src.edits, src.metrics = [], {}
            run(src, o[name])
            src.parts[key] = src.edits, src.metrics
        if src.parts[key][0]:
            parts.append(key)
    src.edits, src.metrics = [], {}
    if not parts:
        return src.text, src.metrics
    made = o["placeholders"]["ratio"], o["placeholders"]["least"], parts
    if src.last is None or src.last[0] != made:
        for key in parts:
            edits, counts = src.parts[key]
            src.edits += edits
            for k, n in counts.items():
                src.metrics[k] = src.metrics.get(k, 0) + n
        src.last = made, finish(src, *made[:2]), src.metrics
    return src.last[1], dict(src.last[2])


_PARTS = {"public_api_only": lambda src, on: public_api(src) if on else None, "bodies": bodies, "comments": comments, "imports": imports, "literals": literals}


def _keys(o: Mapping) -> list[tuple[str, str]]:
    """What the edits of each part of the options depend on besides the text."""
    return [(name, repr(o[name])) for name in _PARTS]


def ladder(o: Mapping) -> list[dict]:
    """The option sets of a budget run, each harder than the one before; steps that the options already cover are left out."""
    out, now = [], copy.deepcopy(dict(o))

    def step():
        if not out or out[-1] != now:
            out.append(copy.deepcopy(now))

    step()
    for name in o["budget"]["order"]:
        policy = now["imports"]["policy"]
        if name == "imports_external" and policy == "keep_all":
            now["imports"]["policy"] = "strip_external"
        elif name == "imports_local" and policy != "strip_all":
            now["imports"]["policy"] = "strip_all" if policy == "strip_external" else "strip_local"
        elif name == "literals":
            for cap in LADDER:
                if now["literals"]["max_tokens"] is None or cap < now["literals"]["max_tokens"]:
                    now["literals"]["max_tokens"] = cap
                    step()
        elif name == "comments" and now["comments"]["policy"] == "keep_all":
            now["comments"]["policy"] = "keep_doc"
        elif name == "private_bodies" and now["bodies"]["policy"] == "keep_all":
            now["bodies"]["policy"] = "keep_public"
        elif name == "public_api_only":
            now["public_api_only"] = True
        elif name == "public_bodies":
            now["bodies"]["policy"] = "strip_all"
        elif name == "docstrings_first_sentence" and now["comments"]["policy"] != "strip_all":
            now["comments"]["policy"] = "keep_first_sentence"
        elif name not in STEPS:
            raise OptionError(f"unknown budget step {name!r}")
        step()
    return out


def process(text: str, language: str, given: Mapping | None = None, count: Callable[[str], int] = count_tokens) -> tuple[str, dict]:
    """The reduced text and its metrics. With a budget the first step of the ladder that fits is taken, or else the last."""
    limit, taken = steps(given)
    return (text, {}) if language not in LANGUAGES else processed(text, language, limit, taken, count)


def steps(given: Mapping | None) -> tuple[int | None, list[dict]]:
    """The budget and the option sets to try, which many texts can share."""
    o = options(given)
    limit = o["budget"]["max_tokens"]
    if limit is not None:
        # Under a budget any saving counts.
        o["placeholders"] = {"ratio": 0.0, "least": 1}
    taken = [o] if limit is None else ladder(o)
    return limit, [step | {"keys": _keys(step)} for step in taken]


def processed(text: str, language: str, limit: int | None, taken: list[dict], count: Callable[[str], int] = count_tokens) -> tuple[str, dict]:
    src = Source(text, language, count)
    if limit is None:
        return reduced(src, taken[0])
    best: tuple[str, dict] = text, {}
    least, last, n = None, None, 0
    for k, step in enumerate(taken):
        out, metrics = reduced(src, step)
        if out is not last:
            last, n = out, count(out)
        if least is None or n < least:
            best, least = (out, metrics | {f"{language}.budget_step": k}), n
        if least <= limit:
            break
    return best
