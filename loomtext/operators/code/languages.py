"""What is known about each language: comments, strings, declarations, visibility, imports, trivial files.

Python is parsed by its own grammar. The other nine are read lexically: comments and strings are found exactly by their
delimiters, declarations by patterns over the text with both blanked out. See :mod:`loomtext.operators.code` for what
that approximates.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    name: str
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    doc_marks: tuple[str, ...] = ("/**",)
    #: ``(opening, closing, has escapes)``, longer openings first.
    strings: tuple[tuple[str, str, bool], ...] = (('"', '"', True), ("'", "'", True))
    #: ``(kind, pattern)`` with a group ``name``, matched at line starts of the blanked text.
    declarations: tuple[tuple[str, str], ...] = ()
    containers: frozenset[str] = frozenset()
    import_pattern: str = r"(?!)"
    interpolation: tuple[str, ...] = ()
    collections: tuple[str, ...] = ("[", "{")
    factories: tuple[str, ...] = ()
    external: tuple[str, ...] = field(default=())


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|override|open|sealed|data|inline|suspend|async|export|default|declare|readonly|virtual|synchronized|native|implicit|lazy|case|const|extern|constexpr|explicit|noexcept|friend|unsafe|strictfp|transient|volatile|companion|operator|tailrec|infix|lateinit|annotation|value|inner|enum(?=\s+class))(?:\[[^\]]*\])?[ \t]+)*"
_ANN = r"(?:@[\w.]+(?:\([^)]*\))?\s+)*"
_HEAD = rf"^[ \t]*(?P<mods>{_ANN}{_MOD})"
#: What most declarations begin with: annotations and modifiers.
HEAD = _HEAD
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"

_JS_DECL = (
    ("class", rf"{_HEAD}class\s+{_NAME}"), ("function", rf"{_HEAD}function\s*\*?\s*{_NAME}\s*(?:<[^>]*>)?\s*\("), ("function", rf"{_HEAD}(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::\s*[^=\n]+)?=>"),
    ("variable", rf"{_HEAD}(?:const|let|var)\s+{_NAME}\b"), ("method", rf"{_HEAD}(?:get\s+|set\s+|\*\s*)?(?P<name>[#A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{{;=\n]+)?(?=\{{)"),
    ("field", rf"{_HEAD}(?P<name>[#A-Za-z_$][\w$]*)\??\s*(?::[^=;\n]+)?(?:=[^=>]|;)"),
)
_TS_DECL = (("interface", rf"{_HEAD}interface\s+{_NAME}"), ("type", rf"{_HEAD}type\s+{_NAME}[^=\n]*="), ("enum", rf"{_HEAD}(?:const\s+)?enum\s+{_NAME}"), ("namespace", rf"{_HEAD}(?:namespace|module)\s+(?P<name>[\w$.]+)"), *_JS_DECL)
_C_FUNC = rf"{_HEAD}(?!(?:return|else|if|for|while|switch|case|goto|throw|new|delete|typedef|using|namespace|struct\s*\{{|enum\s*\{{)\b|(?:public|private|protected)\s*:(?!:))[A-Za-z_][\w:<>,*&\s~]*?[\s*&](?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const|override|noexcept|final|\s)*(?:->\s*[\w:<>]+\s*)?(?::[^;{{]*)?(?=\{{|;)"

LANGUAGES: dict[str, Language] = {
    "python": Language("python", ("#",), (), (), (), containers=frozenset({"class"}), collections=("[", "{", "(")),
    "javascript": Language("javascript", strings=(("`", "`", True), ('"', '"', True), ("'", "'", True)), declarations=_JS_DECL, containers=frozenset({"class"}), import_pattern=r"^[ \t]*(?:import\b[^;\n]*?(?:\{[^}]*\}[^;\n]*?)?['\"](?P<module>[^'\"]+)['\"]|(?:const|let|var)\s+[\w{},\s]+=\s*require\(\s*['\"](?P<module2>[^'\"]+)['\"]\s*\))[^\n]*", interpolation=("${",)),
    "typescript": Language("typescript", strings=(("`", "`", True), ('"', '"', True), ("'", "'", True)), declarations=_TS_DECL, containers=frozenset({"class", "interface", "namespace"}), import_pattern=r"^[ \t]*import\b[^;\n]*?(?:\{[^}]*\}[^;\n]*?)?['\"](?P<module>[^'\"]+)['\"][^\n]*", interpolation=("${",)),
    "java": Language("java", strings=(('"""', '"""', True), ('"', '"', True), ("'", "'", True)), containers=frozenset({"class", "interface", "enum", "annotation"}), collections=("{",), factories=("Map.of", "Map.ofEntries", "List.of", "Set.of", "Arrays.asList", "Stream.of"),
        declarations=(("class", rf"{_HEAD}(?:class|record)\s+{_NAME}"), ("annotation", rf"{_HEAD}@interface\s+{_NAME}"), ("interface", rf"{_HEAD}interface\s+{_NAME}"), ("enum", rf"{_HEAD}enum\s+{_NAME}"), ("method", rf"{_HEAD}(?:<[^>]+>\s*)?(?!(?:return|new|else|throw)\b)[\w<>\[\],.? \t]+?[ \t]+{_NAME}\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{|;)"), ("constructor", rf"{_HEAD}(?P<name>[A-Z]\w*)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{{)"), ("field", rf"{_HEAD}(?!(?:return|package|import|throw)\b)[\w<>\[\],.?]+(?:[ \t]+[\w<>\[\],.?]+)*[ \t]+{_NAME}\s*(?:=|;)")), import_pattern=r"^[ \t]*import\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;[^\n]*"),
    "kotlin": Language("kotlin", strings=(('"""', '"""', False), ('"', '"', True), ("'", "'", True)), containers=frozenset({"class", "interface", "object"}), collections=(), factories=("mapOf", "listOf", "setOf", "mutableMapOf", "mutableListOf", "mutableSetOf", "arrayOf", "hashMapOf"), interpolation=("${",),
        declarations=(("class", rf"{_HEAD}(?:enum\s+|annotation\s+)?class\s+{_NAME}"), ("interface", rf"{_HEAD}interface\s+{_NAME}"), ("object", rf"{_HEAD}object\b[ \t]*(?P<name>\w*)"), ("function", rf"{_HEAD}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?.]+\.)?{_NAME}\s*\("), ("constructor", rf"{_HEAD}(?P<name>constructor)\s*\("), ("init", r"^[ \t]*(?P<mods>)(?P<name>init)\s*(?=\{)"), ("property", rf"{_HEAD}(?:val|var)\s+{_NAME}"), ("getter", r"^[ \t]*(?P<mods>)(?P<name>get)\s*\(\)"), ("setter", r"^[ \t]*(?P<mods>(?:private\s+)?)(?P<name>set)\s*\(")), import_pattern=r"^[ \t]*import\s+(?P<module>[\w.*]+)(?:\s+as\s+\w+)?[^\n]*"),
    "scala": Language("scala", strings=(('"""', '"""', False), ('"', '"', True)), containers=frozenset({"class", "case_class", "trait", "object"}), collections=(), factories=("Map", "List", "Set", "Seq", "Vector", "Array"), interpolation=("${",),
        declarations=(("case_class", rf"{_HEAD}(?<=case\s)class\s+{_NAME}"), ("class", rf"{_HEAD}class\s+{_NAME}"), ("trait", rf"{_HEAD}trait\s+{_NAME}"), ("object", rf"{_HEAD}object\s+{_NAME}"), ("type", rf"{_HEAD}type\s+{_NAME}"), ("function", rf"{_HEAD}def\s+(?P<name>[^\s(\[:=]+)"), ("variable", rf"{_HEAD}(?:val|var)\s+{_NAME}")), import_pattern=r"^[ \t]*import\s+(?P<module>[\w.]+(?:\.\{[^}]*\}|\._|\.\*)?)[^\n]*"),
    "go": Language("go", doc_marks=(), strings=(("`", "`", False), ('"', '"', True), ("'", "'", True)), containers=frozenset({"struct", "interface"}), collections=("{",),
        declarations=(("struct", r"^[ \t]*(?P<mods>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^[ \t]*(?P<mods>)type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^[ \t]*(?P<mods>)type\s+(?P<name>\w+)"), ("method", r"^(?P<mods>)func\s+\([^)]*\)\s*(?P<name>\w+)\s*\("), ("function", r"^(?P<mods>)func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), ("constant", r"^(?P<mods>)const\s+(?P<name>\w+)"), ("variable", r"^(?P<mods>)var\s+(?P<name>\w+)")), import_pattern=r"^[ \t]*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<module>[^\"\n]+)\"[ \t]*$"),
    "rust": Language("rust", doc_marks=tuple("/// //! /** /*!".split()), strings=(('r##"', '"##', False), ('r#"', '"#', False), ('r"', '"', False), ('"', '"', True)), containers=frozenset({"impl", "trait", "mod"}), collections=("[",), factories=("vec!",),
        declarations=tuple((kind, rf"^[ \t]*(?P<mods>(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern|default)\s+)*){word}\s+(?P<name>\w+)") for kind, word in (("struct", "struct"), ("trait", "trait"), ("union", "union"), ("enum", "enum"), ("mod", "mod"), ("type", "type"), ("function", "fn"), ("static", r"static(?:\s+mut)?"), ("const", "const"))) + (("impl", r"^[ \t]*(?P<mods>)(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?P<name>[\w:<>,\s&']+?)(?=\s*(?:where\b|\{))"), ("macro", r"^[ \t]*(?P<mods>(?:#\[[^\]]*\]\s*)*)macro_rules!\s*(?P<name>\w+)")), import_pattern=r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use|extern\s+crate)\s+(?P<module>[^;]+);[^\n]*"),
    "c": Language("c", strings=(('"', '"', True), ("'", "'", True)), containers=frozenset({"struct", "union", "enum"}), collections=("{",),
        declarations=(("typedef", r"^[ \t]*(?P<mods>)typedef\b[^;{]*?(?P<name>\w+)\s*(?=;)"), ("struct", r"^[ \t]*(?P<mods>(?:typedef\s+)?)struct\s+(?P<name>\w+)\s*(?=\{)"), ("union", r"^[ \t]*(?P<mods>(?:typedef\s+)?)union\s+(?P<name>\w+)\s*(?=\{)"), ("enum", r"^[ \t]*(?P<mods>(?:typedef\s+)?)enum\s+(?P<name>\w+)\s*(?=\{)"), ("function", _C_FUNC), ("variable", rf"^(?P<mods>(?:static\s+|extern\s+|const\s+)*)(?!(?:return|typedef|struct\s+\w+\s*\{{)\b)[A-Za-z_][\w\s*]*?[\s*]{_NAME}\s*(?:\[[^\]]*\]\s*)*(?:=|;)")), import_pattern=r"^[ \t]*#[ \t]*include[ \t]*(?P<module>[<\"][^>\"\n]+[>\"])[^\n]*"),
}
LANGUAGES["cpp"] = Language(
    "cpp", strings=(('R"(', ')"', False), ('"', '"', True), ("'", "'", True)), containers=frozenset({"class", "struct", "union", "namespace"}), collections=("{",),
    declarations=(("namespace", r"^[ \t]*(?P<mods>(?:inline\s+)?)namespace\s*(?P<name>[\w:]*)\s*(?=\{)"), ("class", rf"^[ \t]*(?P<mods>(?:template\s*<[^>]*>\s*)?)class\s+{_NAME}[^;{{]*(?=\{{)"), ("enum", rf"^[ \t]*(?P<mods>)enum\s+(?:class\s+|struct\s+)?{_NAME}[^;{{]*(?=\{{)"), ("struct", rf"^[ \t]*(?P<mods>(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?)struct\s+{_NAME}[^;{{]*(?=\{{)"), *LANGUAGES["c"].declarations),
    import_pattern=LANGUAGES["c"].import_pattern,
)

#: Modules that ship with a language, or whole families of them; what they don't cover is told by :func:`is_external`.
GO_DOMAINS = ("example.com", "example.org")
JVM_STANDARD = ("java", "javax", "kotlin", "kotlinx", "scala", "android", "androidx", "jakarta")
JVM_ORGS = ("apache", "springframework", "junit", "google", "fasterxml", "slf4j", "jetbrains", "hibernate", "mockito", "github", "typesafe", "akka")
NODE = frozenset("assert buffer child_process cluster console crypto dns events fs http http2 https net os path process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split())
C_STANDARD = frozenset("assert complex ctype errno fenv float inttypes iso646 limits locale math setjmp signal stdalign stdarg stdatomic stdbool stddef stdint stdio stdlib stdnoreturn string tgmath threads time uchar wchar wctype".split())
PYTHON_KNOWN = frozenset("numpy pandas scipy requests flask django fastapi pydantic pytest sqlalchemy torch tensorflow sklearn matplotlib yaml click rich attrs boto3 redis celery jinja2 aiohttp httpx pyspark pyarrow".split())


def is_external(language: str, module: str) -> bool:
    """Whether an import comes from outside the project, by the module's name alone."""
    m = module.strip()
    head = re.split(r"[./:]", m)[0]
    if language == "python":
        return not m.startswith(".") and (head in sys.stdlib_module_names or head in PYTHON_KNOWN)
    if language in ("javascript", "typescript"):
        bare = m.removeprefix("node:")
        if m.startswith((".", "/", "@/", "~/", "#")):
            return False
        return bare.split("/")[0] in NODE or m.startswith("@") or (language == "javascript" and re.fullmatch(r"[a-z][a-z0-9-]*", m) is not None) or re.match(r"(react|vue|angular|lodash|express|rxjs|jquery|axios)\b", m) is not None
    if language in ("java", "kotlin", "scala"):
        parts = m.split(".")
        return parts[0] in JVM_STANDARD or (len(parts) > 1 and parts[0] in ("org", "com", "net", "io") and parts[1] in JVM_ORGS)
    if language == "go":
        first = m.split("/")[0]
        return "." not in first or not (first in GO_DOMAINS or first.endswith(tuple("." + d for d in GO_DOMAINS)))
    if language == "rust":
        if head in ("std", "core", "alloc", "proc_macro", "test"):
            return True
        return head not in ("crate", "super", "self") and "::" not in m
    name = m.strip('<>"')
    base = re.sub(r"\.(h|hpp|hh|hxx)$", "", name)
    if language == "c":
        return base in C_STANDARD or "/" not in name
    return base in C_STANDARD or (m.startswith("<") and "/" not in name and "." not in name) or base.removeprefix("c") in C_STANDARD
