"""Reading a source text: comments, strings, elements and imports."""

from __future__ import annotations

import ast
import functools
import io
import re
import tokenize
from bisect import bisect_left

from loomtext.operators.code.languages import HEAD, LANGUAGES, Language, is_external
from loomtext.operators.code.model import Element, Import, Span


def spans(text: str, language: str) -> list[Span]:
    """Comments and strings in order. A delimiter inside either has no meaning."""
    if language == "python":
        return _python_spans(text)
    lang = LANGUAGES[language]
    finder, kinds = _starts(language)
    out, at = [], 0
    while m := finder.search(text, at):
        mark, kind, close = kinds[m[0]]
        a, inner = m.start(), m.end()
        if kind == "line":
            end = text.find("\n", inner)
            b = stop = len(text) if end < 0 else end
        elif kind == "block":
            end = text.find(close, inner)
            stop, b = (len(text),) * 2 if end < 0 else (end, end + len(close))
        else:
            closing, ends = close
            if mark == "'" and language in ("rust", "scala") or (mark == "'" and language in ("java", "kotlin", "c", "cpp", "go") and not re.match(r"'(?:\\.[^']*|[^'\\])'", text[a : a + 12])):
                at = inner
                continue
            b = inner
            while (found := ends.search(text, b)) and found[0] == "\\":
                b = found.end() + 1
            stop = found.start() if found else len(text)
            b = found.end() if found and found[0] == closing else stop
        if kind != "string" and text.startswith(tuple(lang.doc_marks), a) and text[a : a + 4] != "/**/" and not text.startswith("////", a):
            kind = "doc"
        out.append(Span(kind, a, b, (inner, stop)))
        at = max(b, a + 1)
    if language == "go":
        _go_docs(text, out)
    return out


@functools.cache
def _starts(language: str) -> tuple[re.Pattern, dict[str, tuple]]:
    """What finds the delimiters that open something, and for each its kind and what closes it; of a string, also what finds the next place that matters in it."""
    lang = LANGUAGES[language]
    starts = [*((o, "block", c) for o, c in lang.block_comments), *((m, "line", "\n") for m in lang.line_comments)]
    for o, c, escapes in lang.strings:
        ends = [re.escape(c), *[r"\\"] * escapes, *["\n"] * (len(o) == 1 and o != "`")]
        starts.append((o, "string", (c, re.compile("|".join(ends)))))
    starts.sort(key=lambda s: -len(s[0]))
    return re.compile("|".join(re.escape(s[0]) for s in starts)), {s[0]: s for s in starts}


_GO_DECLARED = re.compile(r"(?:func|type|var|const|package)\b")


def _go_docs(text: str, out: list[Span]) -> None:
    """A run of line comments directly above a declaration documents it."""
    for i in range(len(out) - 1, -1, -1):
        s = out[i]
        if s.kind == "line" and not text[text.rfind("\n", 0, s.start) + 1 : s.start].strip():
            after = out[i + 1] if i + 1 < len(out) else None
            runs_on = after is not None and after.kind == "doc" and not text[s.end : after.start].strip() and text.count("\n", s.end, after.start) == 1
            if runs_on or _GO_DECLARED.match(text, s.end + 1):
                s.kind = "doc"


#: Ends of lines for ``str.splitlines`` but not for Python's tokenizer, or that it reads in another way.
_ODD = re.compile("[\r\x00\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_QUOTED = re.compile(
    r"#[^\n]*|(?:(?<!\w)[bBrRuU]{1,2})?(?:\"\"\"(?P<a>(?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'''(?P<b>(?:[^'\\]|\\.|'(?!''))*+)'''|\"(?P<c>(?:[^\"\\\n]|\\.)*+)\"|'(?P<d>(?:[^'\\\n]|\\.)*+)')", re.DOTALL
)
#: Texts of tokens that can't be wrong each by itself; strings have no prefix and one line.
_SIMPLE = re.compile(r"""(?:[A-Za-z_][A-Za-z_0-9]*+|(?<![A-Za-z_0-9.])(?:0|[1-9][0-9]*+)(?![A-Za-z_0-9.])|(?<![A-Za-z_0-9])(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|#[^\n]*+|[ \n=,()\[\]{}:;+\-*/%<>.&|^~@]++)*+""", re.DOTALL)
_NESTING = re.compile(r"[()\[\]{}\n]")


def _lexed(text: str) -> list[Span]:
    """The comments and strings of a text that Python's tokenizer reads to its end and that has no formatted strings."""
    out = []
    for m in _QUOTED.finditer(text):
        a, b = m.span()
        which = m.lastgroup
        out.append(Span("line", a, b, (a + 1, b)) if which is None else Span("string", a, b, m.span(which)))
    return out


_SIMPLE_QUOTED = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'", re.DOTALL)


class Plain:
    """A Python text that needs no parsing, with what is asked of it."""

    def __init__(self, text: str):
        self.text = text
        if "\\" in text or "'" in text or "#" in text:
            self.found = [m.span() for m in _SIMPLE_QUOTED.finditer(text)]
            self.inside = None
            self.simple = _SIMPLE.fullmatch(text) is not None
            blanks, at = [], 0
            for a, b in self.found:
                blanks += (text[at:a], " " * (b - a))
                at = b
            self.code = "".join([*blanks, text[at:]])
        else:
            # All quotes are double ones: what is between them is by turns outside and inside strings.
            parts = text.split('"')
            outside, inside = parts[::2], parts[1::2]
            bare = '""'.join(outside)
            self.found = None
            #: What is in strings, unless some may have only white space between them.
            self.inside = None if "" in map(str.strip, outside[1:-1]) else inside
            self.simple = len(parts) % 2 == 1 and bare.count("\n") == text.count("\n") and _SIMPLE.fullmatch(bare) is not None
            parts[1::2] = [" " * (len(x) + 2) for x in inside]
            self.code = "".join(parts)

    @functools.cached_property
    def spans(self) -> list[Span]:
        if self.found is None:
            at = [m.start() for m in re.finditer('"', self.text)]
            return [Span("string", a, b + 1, (a + 1, b)) for a, b in zip(at[::2], at[1::2], strict=True)]
        return [Span("line", a, b, (a + 1, b)) if self.text[a] == "#" else Span("string", a, b, (a + 1, b - 1)) for a, b in self.found]

    def quoted(self, start: int, end: int) -> str | None:
        """A part that begins outside strings with strings as words, where that is simple."""
        return None if self.inside is None else re.sub('"[^"]*"?', lambda m: "x" * len(m[0]), self.text[start:end])

    def settled(self) -> bool:
        """Whether reading it so is right: simple tokens, brackets in order, nothing indented outside them, no docstring."""
        if not self.simple or ("def" in self.code or "class" in self.code) and re.search(r"\b(?:def|class)\b", self.code):
            return False
        first = self.text.find('"') if self.found is None else next((a for a, _ in self.found if self.text[a] != "#"), -1)
        if first >= 0 and not self.code[:first].strip(" \n"):
            return False
        open_ = []
        for m in _NESTING.finditer(self.code):
            c = m[0]
            if c in "([{":
                open_.append(")]}"["([{".index(c)])
                if len(open_) > 100:  # Python has a limit
                    return False
            elif c == "\n":
                if not open_ and self.code.startswith(" ", m.end()):
                    return False
            elif not open_ or open_.pop() != c:
                return False
        return not open_


@functools.lru_cache(1)
def simple(text: str) -> Plain | None:
    """A Python text read without parsing; None where that might be wrong."""
    if text[:1] == " " or odd_lines(text) or "\\\n" in text or '"""' in text or "\'\'\'" in text:
        return None
    plain = Plain(text)
    return plain if plain.settled() else None


@functools.lru_cache(1)
def _tree(text: str) -> ast.Module:
    return ast.parse(text)


def odd_lines(text: str) -> bool:
    """Whether a Python text has line ends for which offsets by lines can be wrong."""
    return _ODD.search(text) is not None


def _python_spans(text: str) -> list[Span]:
    if (known := simple(text)) is not None:
        return list(known.spans)
    out = None
    if not odd_lines(text):
        try:
            _tree(text)
            out = _lexed(text)
            # Letters right before a quote are a formatted string's, or a word's that needs no blank.
            if any(s.kind == "string" and text[s.start - 1 : s.start].isalpha() for s in out):
                out = None
        except (SyntaxError, ValueError):
            pass
    if out is None:
        out = _tokenized(text)
    docs = {(d[0], d[1]) for e in _python_elements(text, all_docs=True) if (d := e.docstring)}
    for s in out:
        if (s.start, s.end) in docs:
            s.kind = "docstring"
    return out


def _tokenized(text: str) -> list[Span]:
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    pos = lambda p: lines[min(p[0] - 1, len(lines) - 1)] + p[1]
    out, start = [], None
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append(Span("line", pos(t.start), pos(t.end), (pos(t.start) + 1, pos(t.end))))
            elif t.type == tokenize.STRING:
                q = re.match(r"[A-Za-z]*('''|\"\"\"|'|\")", t.string)
                out.append(Span("string", pos(t.start), pos(t.end), (pos(t.start) + q.end(), pos(t.end) - len(q[1]))))
            elif t.type == getattr(tokenize, "FSTRING_START", -1):
                start = start or t
            elif t.type == getattr(tokenize, "FSTRING_END", -1) and start:
                out.append(Span("string", pos(start.start), pos(t.end), (pos(start.end), pos(t.start))))
                start = None
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def blanked(text: str, found: list[Span]) -> str:
    """The text with its comments and strings as blanks, so that offsets stay."""
    parts, at = [], 0
    for s in found:
        inside = text[s.start : s.end]
        parts += [text[at : s.start], "\n".join([" " * len(x) for x in inside.split("\n")]) if "\n" in inside else " " * len(inside)]
        at = s.end
    return "".join([*parts, text[at:]])


class Brackets:
    """Where the bracket that closes the one at a place ends, or the text when none does; the text is gone through once."""

    _PLACES = re.compile(r"[()\[\]{}]")

    def __init__(self, code: str):
        self.code = code

    @functools.cached_property
    def ends(self) -> dict[int, int]:
        ends, open_ = {}, {")": [], "]": [], "}": []}
        here = {"(": open_[")"], "[": open_["]"], "{": open_["}"]}
        for m in self._PLACES.finditer(self.code):
            c = m[0]
            if c in here:
                here[c].append(m.start())
            elif open_[c]:
                ends[open_[c].pop()] = m.end()
        # Those that nothing closes end with the text.
        return ends | {a: len(self.code) for left in open_.values() for a in left}

    @functools.cached_property
    def longest(self) -> int:
        return max((b - a for a, b in self.ends.items()), default=0)

    def __call__(self, at: int) -> int:
        return self.ends[at]


_NO_NAMES = frozenset("if for while switch catch return else do try function new".split())
_DECORATORS = re.compile(r"@[\w.]+|#\[[^\]]*\]")
#: Lines that a declaration can begin with: no pattern allows for a blank line or one of these marks.
_BEGINNINGS = re.compile(r"^(?=[ \t]*+[^ \t\n(){};])", re.MULTILINE)


@functools.cache
def _declarations(language: str) -> list[tuple[str, re.Pattern, tuple[str, ...], bool]]:
    """Each kind's pattern with words of which a match has one, and whether that word is on the line the match begins on when this has no ``@`` or ``[``."""
    out = []
    for kind, pattern in LANGUAGES[language].declarations:
        head = next((h for h in (HEAD, r"^[ \t]*(?P<mods>)", "^(?P<mods>)") if pattern.startswith(h)), None)
        rest = pattern[len(head) :] if head else _after_group(pattern)
        bare = re.sub(r"^(?:\(\?:[^()]*\)\?|\(\?<=[^()]*\))", "", rest)
        word = re.match(r"\(\?:(\w+(?:\|\w+)*)\)\\s\+|(@?[a-z_]+!?)(?=\\[sb])", bare)
        words = tuple((word[1] or word[2]).split("|")) if word else ()
        near = bool(word) and bare == rest and head is not None
        if pattern.endswith("=>"):
            words = ("=>",)
        out.append((kind, re.compile(pattern, re.MULTILINE), words, near and words != ("=>",)))
    return out


def _after_group(pattern: str) -> str:
    """A pattern after its first group, which is ``mods`` in all that have another head than the usual."""
    depth = 0
    for i, c in enumerate(re.sub(r"\\.|\[[^\]]*\]", lambda m: "x" * len(m[0]), pattern)):
        depth += (c == "(") - (c == ")")
        if c == ")" and depth == 0:
            return pattern[i + 1 :]
    return ""


def _declared(code: str, language: str):
    """The matches of each kind's pattern, as ``re.finditer`` gives them, tried only on lines where there can be one."""
    lines = [m.start() for m in _BEGINNINGS.finditer(code)]
    other = None
    for kind, pattern, words, near in _declarations(language):
        if words and not any(w in code for w in words):
            continue
        tried = lines
        if near:
            if other is None:
                other = _lines_with(code, ("@", "["))
            tried = sorted(other | _lines_with(code, words))
        end = 0
        for at in tried:
            if at >= end and (m := pattern.match(code, at)):
                end = m.end()
                yield kind, m


def _lines_with(code: str, words: tuple[str, ...]) -> set[int]:
    out = set()
    for w in words:
        at = code.find(w)
        while at >= 0:
            out.add(code.rfind("\n", 0, at) + 1)
            end = code.find("\n", at)
            at = -1 if end < 0 else code.find(w, end)
    return out


def elements(text: str, language: str, code: str | None = None) -> list[Element]:
    """The elements of a text; ``code`` is the text with comments and strings blanked, where that is at hand."""
    if language == "python":
        return _python_elements(text)
    lang = LANGUAGES[language]
    if code is None:
        code = blanked(text, spans(text, language))
    found: dict[int, Element] = {}
    closing, words = Brackets(code), Words(code)
    for kind, m in _declared(code, language):
        name = m["name"]
        if name in _NO_NAMES:
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if start not in found:
            found[start] = _closed(code, kind, name, start, m.end(), lang, closing)
    out = sorted(found.values(), key=lambda e: (e.start, -e.end))
    kept: list[Element] = []
    open_: list[Element] = []
    for e in out:
        while open_ and open_[-1].end <= e.start:
            open_.pop()
        owner = open_[-1] if open_ else None
        if owner is not None and owner.kind not in lang.containers and owner.kind != "property":
            continue  # what a function declares is its own affair
        e.parent = owner.name if owner else None
        if owner is not None:
            e.kind = {"function": "method", "variable": "field", "property": "property"}.get(e.kind, e.kind) if owner.kind not in ("namespace", "mod") else e.kind
        elif e.kind in ("method", "field") and lang.name in ("javascript", "typescript"):
            continue
        e.public = _public(text, code, e, owner, lang, words)
        e.decorators = tuple(_DECORATORS.findall(text[e.start : e.start + 400].split("{")[0]))
        kept.append(e)
        open_.append(e)
    return kept


_CLOSING = re.compile(r"[(\[{;\n]")
_CLOSING_NO_LINES = re.compile(r"[(\[{;]")
_GOES_ON = re.compile(r"\s*+(?:\{|=|\.|:|->|extends|with|where)")
_FILLED = re.compile(r"\S")


def _closed(code: str, kind: str, name: str, start: int, at: int, lang: Language, closing: Brackets) -> Element:
    """Where a declaration ends, and its body: a block, or an expression up to the line's or statement's end."""
    i, n = at, len(code)
    by_lines = lang.name in ("go", "kotlin", "scala", "javascript", "typescript")
    places = _CLOSING if by_lines else _CLOSING_NO_LINES
    if code[at - 1 : at] == "(":
        i = closing(at - 1)
    while m := places.search(code, i):
        c, i = m[0], m.start()
        if c in "([":
            i = closing(i)
            continue
        if c == "{":
            end = closing(i)
            body = (i + 1, end - 1) if kind in ("function", "method", "constructor", "init", "getter", "setter", "macro") else None
            while end < n and code[end] in ";," and kind not in ("function", "method"):
                end += 1
            return Element(kind, name, start, end, body=body)
        if c == ";":
            return Element(kind, name, start, i + 1)
        before = i
        while before > start and code[before - 1].isspace():
            before -= 1
        if not (_GOES_ON.match(code, i) or code.endswith(("=", ",", "(", "=>", "&&", "||", "+", ":"), start, before)):
            return Element(kind, name, start, i)
        # What holds for this line end holds for the blank lines after it.
        after = _FILLED.search(code, i)
        i = after.start() if after else n
    return Element(kind, name, start, n)


class Words:
    """What visibility depends on besides the declaration itself, found once for a text."""

    def __init__(self, code: str):
        self.code = code

    @functools.cached_property
    def access(self) -> tuple[list[int], list[tuple[int, str]]]:
        """Where access specifiers start, and their ends and words."""
        found = [(m.start(), (m.end(), m[1])) for m in re.finditer(r"\b(public|private|protected)\s*:(?!:)", self.code)]
        return [a for a, _ in found], [x for _, x in found]

    @functools.cached_property
    def exported(self) -> set[str] | None:
        """Words that a JavaScript text exports apart from their declarations; None where there can be none."""
        if "export" not in self.code:
            return None
        said = set(re.findall(r"(?m)^[^\S\n]*export\s*default\s+(\w+)", self.code))
        for inside in [*re.findall(r"(?m)^[^\S\n]*export\s*\{([^}]*)", self.code), *re.findall(r"module\.exports\b([^\n]*)", self.code)]:
            said.update(re.findall(r"\w+", inside))
        return said

    def exports(self, name: str) -> bool:
        if self.exported is None:
            return False
        if re.fullmatch(r"\w+", name):
            return name in self.exported
        return bool(re.search(rf"(?m)^\s*export\s*(?:default\s+{re.escape(name)}\b|\{{[^}}]*\b{re.escape(name)}\b)|module\.exports\b[^\n]*\b{re.escape(name)}\b", self.code))


_WORDS = re.compile(r"[\w$]+")


def _public(text: str, code: str, e: Element, owner: Element | None, lang: Language, known: Words) -> bool:
    head = code[e.start : e.start + 200].split("{")[0].split("(")[0]
    name, words = e.name.split("::")[-1], set(_WORDS.findall(head))
    match lang.name:
        case "go":
            return name[:1].isupper()
        case "java":
            return "public" in words or (owner is not None and owner.kind in ("interface", "annotation") and "private" not in words)
        case "kotlin":
            return not words & {"private", "protected", "internal"}
        case "scala":
            return not words & {"private", "protected"}
        case "rust":
            if e.kind == "impl":
                return True
            if owner is not None and (owner.kind == "trait" or (owner.kind == "impl" and re.search(r"\bfor\b", code[owner.start : owner.start + 200].split("{")[0]))):
                return owner.public
            return bool(re.match(r"(?:#\[[^\]]*\]\s*)*pub\b(?!\(self\))", code[e.start : e.start + 300]))
        case "c":
            return "static" not in words and not name.startswith(("_", "Internal"))
        case "cpp":
            if owner is not None and owner.kind in ("class", "struct"):
                starts, said = known.access
                i = bisect_left(starts, e.start) - 1
                while i >= 0 and said[i][0] > e.start:
                    i -= 1
                return said[i][1] == "public" if i >= 0 and starts[i] >= owner.start else owner.kind == "struct"
            return "static" not in words and not (owner is not None and owner.kind == "namespace" and not owner.name) and not name.startswith("_")
        case "javascript" | "typescript":
            if owner is not None:
                return not (words & {"private", "protected"}) and not name.startswith(("#", "_"))
            return "export" in words or known.exports(name)
    return True


_NESTED = re.compile(r"\b(?:def|class)\b")


def _python_elements(text: str, all_docs: bool = False) -> list[Element]:
    try:
        tree = _tree(text)
    except (SyntaxError, ValueError):
        return []
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    plain, odd = text.isascii(), odd_lines(text)

    def at(row, col):
        if plain:
            return lines[row - 1] + col
        line = text[lines[row - 1] : lines[row]] if row < len(lines) else ""
        return lines[row - 1] + (col if line.isascii() else len(line.encode()[:col].decode("utf-8", "ignore")))

    out: list[Element] = []

    def public(name):
        return not name.startswith("_") or bool(re.fullmatch("__.*__", name))

    def doc(node):
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return at(first.lineno, first.col_offset), at(first.end_lineno, first.end_col_offset)
        return None

    def visit(body, owner):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                top = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                start, end = at(top, 0), at(node.end_lineno, node.end_col_offset)
                start += len(text[start:end]) - len(text[start:end].lstrip())
                found = doc(node)
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if owner else "function"
                span = None
                rest = node.body[1:] if found else node.body
                if kind != "class" and rest:
                    a = at(rest[0].lineno, 0)
                    a = (found[1] if found else a) if a < (found[1] if found else 0) else a
                    span = (a, end)
                e = Element(kind, node.name, start, end, public(node.name), span, tuple("@" + ast.unparse(d) for d in node.decorator_list), found, owner)
                out.append(e)
                if kind == "class":
                    visit(node.body, node.name)
                elif all_docs and (odd or _NESTED.search(text, at(node.body[0].lineno, 0), end)):
                    visit([n for n in ast.walk(node) if n is not node and isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], node.name)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                if len(targets) == 1 and isinstance(targets[0], ast.Name):
                    name = targets[0].id
                    out.append(Element("variable", name, at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), public(name), parent=owner))
            elif isinstance(node, (ast.If, ast.Try)):
                visit([*node.body, *node.orelse], owner)

    visit(tree.body, None)
    if all_docs and (module := doc(tree)):
        out.append(Element("module", "", 0, len(text), docstring=module))
    return sorted(out, key=lambda e: (e.start, -e.end))


def imports(text: str, language: str, found: list[Span] | None = None) -> list[Import]:
    """The imports of a text; ``found`` are its comments and strings, where they are at hand."""
    if language == "python":
        return _python_imports(text)
    if found is None:
        found = spans(text, language)
    lang, out = LANGUAGES[language], []
    code = blanked(text, [s for s in found if s.kind != "string"])
    closing = Brackets(code)
    block = [(m.start(), closing(m.end() - 1)) for m in re.finditer(r"(?m)^import\s*\(", code)] if language == "go" else []
    for m in re.finditer(lang.import_pattern, code, re.MULTILINE):
        if language == "go" and not m[0].lstrip().startswith("import") and not any(a <= m.start() < b for a, b in block):
            continue
        module = next(v for k, v in m.groupdict().items() if k.startswith("module") and v is not None).strip()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        names = re.search(r"\{([^}]*)\}", m[0])
        items = tuple(x.strip() for x in names[1].split(",") if x.strip()) if names else ()
        aliases = {a: b for a, b in re.findall(r"([\w.*]+)\s+as\s+(\w+)", m[0])}
        out.append(Import(module, items, is_external(language, module), start, m.start() + len(m[0].rstrip()), bool(re.search(r"(\*|\._|::\*)", m[0])), aliases))
    return out


def _python_imports(text: str) -> list[Import]:
    try:
        tree = _tree(text)
    except (SyntaxError, ValueError):
        return []
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    out = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            module = node.names[0].name if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
            items = tuple(a.name for a in node.names)
            a, b = lines[node.lineno - 1] + node.col_offset, lines[node.end_lineno - 1] + node.end_col_offset
            out.append(Import(module, items, is_external("python", module), a, b, "*" in items, {x.name: x.asname for x in node.names if x.asname}))
    return out


_TRIVIAL = {
    "python": "__init__.py", "typescript": ("index.ts", "index.tsx"), "javascript": tuple(f"index.{e}" for e in ("cjs", "mjs", "jsx", "js")), "java": "package-info.java",
    "kotlin": ("package.kt", "package-info.kt"), "scala": "package.scala", "go": "doc.go", "rust": ("mod.rs", "lib.rs"), "c": (".h",), "cpp": (".hpp", ".hh", ".hxx"),
}


def _trivial_name(name: str, language: str) -> bool:
    """Whether a file of that name can be trivial; no other needs reading."""
    return name.endswith(_TRIVIAL[language])


def is_trivial(path: str, text: str, language: str) -> bool:
    """Files that only name or re-export what others hold; an empty one of those names is trivial too."""
    name = path.rsplit("/", 1)[-1]
    if language not in LANGUAGES or not _trivial_name(name, language):
        return False
    code = blanked(text, [s for s in spans(text, language) if s.kind != "string"])
    lines = [x.strip() for x in code.splitlines() if x.strip()]
    only = lambda pattern: all(re.match(pattern, x) for x in lines)
    match language:
        case "python":
            if name != "__init__.py":
                return False
            try:
                body = ast.parse(text).body
            except SyntaxError:
                return False
            doc = lambda n: isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)
            every = lambda n: isinstance(n, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in getattr(n, "targets", [getattr(n, "target", None)]))
            return all(doc(n) or isinstance(n, (ast.Import, ast.ImportFrom)) or every(n) for n in body)
        case "typescript" | "javascript":
            names = {"typescript": ("index.ts", "index.tsx"), "javascript": tuple(f"index.{e}" for e in ("cjs", "mjs", "jsx", "js"))}[language]
            joined = re.sub(r"\{[^}]*\}", "{}", code)
            return name in names and all(re.match(r"export\s+.*\bfrom\b", x.strip()) for x in joined.splitlines() if x.strip())
        case "java":
            return name == "package-info.java"
        case "kotlin":
            return name in ("package.kt", "package-info.kt") and only(r"(package|import|@)")
        case "scala":
            return name == "package.scala" and only(r"(package|import|type\b|\}|\{)")
        case "go":
            return name == "doc.go"
        case "rust":
            return name in ("mod.rs", "lib.rs") and only(r"(pub(\([^)]*\))?\s+)?(mod|use)\b[^{]*(\{[^}]*\})?;?$|#!?\[|\}|[\w,\s]+,?$")
        case "c" | "cpp":
            headers = (".h",) if language == "c" else (".hpp", ".hh", ".hxx")
            return name.endswith(headers) and only(r"#|(struct|class|enum|union|typedef\s+struct)\s+[\w\s]+;$|namespace\b|\}|extern\s+\"C\"|using\s+namespace\b")
    return False
