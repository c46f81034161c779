"""Per-path lookups: language, adapter, target overrides, option merging, labels, resource keys."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions.globs import name_pattern

def _spread(spec: str, dot: str = "") -> dict[str, str]:
    """``"lang: a b; other: c"`` as ``{a: lang, b: lang, c: other}``; ``-`` stands for no language."""
    return {dot + name: lang.strip().replace("-", "") for lang, _, names in (x.partition(":") for x in spec.split(";")) for name in names.split()}


#: The language of a code fence, by extension and by file name.
BY_EXTENSION = _spread("bash: bash sh zsh; c: h c; cpp: cpp; css: css; go: go; html: html; java: java; javascript: jsx js; json: json; markdown: markdown md; python: py; rust: rs; scss: scss; sql: sql; toml: toml; typescript: tsx ts; xml: xml; yaml: yaml yml; -: cfg ini txt", ".")
BY_NAME = _spread("dockerfile: Dockerfile; groovy: build.gradle; javascript: webpack.config.js; json: tsconfig.json package.json; kotlin: build.gradle.kts; make: Makefile; toml: pyproject.toml; xml: pom.xml; -: README Pipfile")
#: Which adapter treats a file; any other extension is passed through unchanged.
ADAPTER_OF = _spread("c: h c; cpp: hxx hpp hh cxx cpp cc; go: go; java: java; javascript: mjs jsx js cjs; kotlin: kts kt; markdown: markdown md; python: py; rust: rs; scala: scala sc; typescript: tsx ts", ".")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower case, with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def _map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def language(path: Column) -> Column:
    """By exact name, then by the name in lower case, then by extension; otherwise empty."""
    name, names = file_name(path), _map(BY_NAME)
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(names, F.lower(name)), F.try_element_at(_map(BY_EXTENSION), extension(path)), F.lit(""))


def adapter(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(ADAPTER_OF), extension(path)), F.lit("base"))


def is_doc_only(language_col: Column) -> Column:
    """An aggregate: whether there are rows and all are Markdown or plain text."""
    return (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(language_col.isin("markdown", "")), F.lit(False))


def resolved_options(base: Mapping, conditional: Iterable[tuple[str, Mapping]], holds: Callable[[str], bool]) -> dict:
    """Options with those of each condition that holds laid over them in order; a bad condition raises."""
    out = dict(base)
    for condition, options in conditional:
        if holds(condition):
            out.update(options)
    return out


def merged_options(section: Column, override: Column) -> Column:
    """Two string maps; the override's entries win."""
    s, o = F.coalesce(section, F.create_map().cast("map<string,string>")), F.coalesce(override, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(s, lambda k, _: ~F.map_contains_key(o, k)), o)


def specificity(patterns: Iterable[str]) -> int:
    return len(re.sub("[*?]", "", "".join(patterns)))


def target_overrides(path: Column, targets: list[tuple[list[str], Mapping[str, str]]]) -> Column:
    """``map<string,string>``: the options of all targets that match a path, those of more specific and later ones on top."""
    order = sorted(range(len(targets)), key=lambda i: (specificity(targets[i][0]), i))
    keys = sorted({k for _, options in targets for k in options})
    entries = []
    for key in keys:
        value = F.lit(None).cast("string")
        for i in order:
            patterns, options = targets[i]
            if key in options:
                rx = "|".join(name_pattern(p.lstrip("/")).replace("(?s)", "(?s:", 1) + ")" for p in patterns)
                value = F.when(path.rlike(rx), F.lit(options[key])).otherwise(value)
        entries.append(F.struct(F.lit(key).alias("key"), value.alias("value")))
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def frozen(options: Mapping) -> str:
    """A canonical text of nested options, and so a key for what was made with them."""
    return json.dumps(options, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=sorted)


def config_key(options: Mapping) -> str:
    return hashlib.sha1(frozen(options).encode()).hexdigest()


def numeric_meta(meta: Column) -> Column:
    """Of a string map the entries that are numbers or Booleans, as integers: floats lose their fraction, true is 1."""
    number = F.transform_values(meta, lambda _, v: F.when(F.lower(v).isin("true", "false"), (F.lower(v) == "true").cast("bigint")).otherwise(v.try_cast("double").cast("bigint")))
    return F.map_filter(number, lambda _, v: v.isNotNull())


def relative_label(path: Column, origin: str = "self") -> Column:
    """The path, without the scope it comes from."""
    origin = origin.rstrip("/")
    if not origin or origin == "self":
        return path
    return F.when(path.startswith(origin + "/"), F.substring(path, F.lit(len(origin) + 2), F.length(path))).when(path == origin, file_name(path)).otherwise(path)


def unique_suffixes(paths: DataFrame, path_col: str = "rel_path", label_col: str = "label") -> DataFrame:
    """The distinct paths, each with its shortest suffix of segments that no other path ends in; failing that the whole path.

    One shuffle on the suffixes: every suffix knows how many paths share it, and a path takes its shortest lonely one.
    """
    parts = F.filter(F.split(F.col(path_col), "/"), lambda p: p != "")
    paths = paths.select(path_col).where(F.col(path_col).isNotNull()).distinct()
    steps = paths.select(path_col, parts.alias("p")).select(path_col, "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1)))).alias("k"))
    keyed = steps.select(path_col, "k", (F.col("k") == F.size("p")).alias("whole"), F.array_join(F.slice("p", F.greatest(F.size("p") - F.col("k") + 1, F.lit(1)), F.col("k")), "/").alias("s"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("s", "k"))
    return keyed.withColumn("n", shared).where("n = 1 OR whole").groupBy(path_col).agg(F.min_by("s", "k").alias(label_col))


def common_directory(paths: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """One row: the directory prefix that all paths share; that of the least and the greatest is that of all."""
    folder = F.regexp_replace(F.regexp_extract(path_col, r"^(.*/)?", 1), "/$", "")
    pair = paths.agg(F.min(folder).alias("a"), F.max(folder).alias("b")).select(F.split("a", "/").alias("a"), F.split("b", "/").alias("b"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda k: F.slice("a", 1, k) == F.slice("b", 1, k))
    return pair.select(F.array_join(F.slice("a", 1, F.coalesce(F.array_max(same), F.lit(0))), "/").alias("prefix"))


def resource_key(kind: Column, scope: Column, name: Column) -> Column:
    """``kind:name`` in the own scope, ``kind@scope:name`` in another."""
    return F.when(F.coalesce(scope, F.lit("self")).isin("self", ""), F.concat(kind, F.lit(":"), name)).otherwise(F.concat(kind, F.lit("@"), scope, F.lit(":"), name))


class AddressError(ValueError):
    pass


_ADDRESS = re.compile(r"^(?:@(?:\[(?P<boxed>[^\]]*)\]|(?P<plain>[^:\[\]]*)):)?(?P<path>[^#,]*)(?:#(?P<anchor>[^,]*))?(?P<params>(?:,.*)?)$", re.DOTALL)


def parse_address(raw: str) -> dict:
    """``@origin:path``, ``@[origin]:path``, ``/absolute``; then ``#anchor`` and ``,key:value`` parameters."""
    m = _ADDRESS.match(raw.strip())
    if not m:
        raise AddressError(f"bad address {raw!r}")
    origin = m["boxed"] if m["boxed"] is not None else m["plain"]
    if origin is not None and not origin.strip():
        raise AddressError(f"empty origin in {raw!r}")
    path = m["path"].strip()
    if not path:
        raise AddressError(f"empty path in {raw!r}")
    params = dict((x.split(":", 1) + [""])[:2] for x in filter(None, (p.strip() for p in m["params"].split(","))))
    origin = origin.strip("/ ") if origin else None
    return {"origin": origin or None, "path": path.lstrip("/"), "absolute": path.startswith("/"), "anchor": m["anchor"], "params": {k.strip(): v.strip() for k, v in params.items()}}


def resolved_path(path: str, base: str = "", absolute: bool = False) -> str:
    """The path seen from ``base``, without ``.`` and ``..``; leaving the root raises."""
    out = posixpath.normpath(path.lstrip("/") if absolute or path.startswith("/") else posixpath.join(base, path))
    if out == ".." or out.startswith("../"):
        raise AddressError(f"{path!r} leaves the root")
    return "" if out == "." else out
