"""Code operators on DataFrames. Each file is read once in an Arrow batch; nothing is shuffled."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomtext.functions import batches, markdown
from loomtext.operators.code import reading, transforms
from loomtext.operators.code.languages import LANGUAGES


def elements(files: DataFrame, path_col: str = "rel_path", text_col: str = "text", language_col: str = "adapter") -> DataFrame:
    """One row an element: ``rel_path, kind, name, parent, public, start, end, body_start, body_end, decorators``."""

    def run(parts):
        for pdf in parts:
            rows = [
                (path, e.kind, e.name, e.parent, e.public, e.start, e.end, *(e.body or (None, None)), list(e.decorators))
                for path, text, lang in zip(pdf[path_col], pdf[text_col], pdf[language_col], strict=True)
                if lang in LANGUAGES and text
                for e in reading.elements(text, lang)
            ]
            out = pd.DataFrame(rows, columns=["rel_path", "kind", "name", "parent", "public", "start", "end", "body_start", "body_end", "decorators"])
            yield out.astype({"body_start": "Int64", "body_end": "Int64"})

    batches.limited(files.sparkSession)
    return files.select(path_col, text_col, language_col).mapInPandas(run, "rel_path string, kind string, name string, parent string, public boolean, start bigint, end bigint, body_start bigint, body_end bigint, decorators array<string>")


def imports(files: DataFrame, path_col: str = "rel_path", text_col: str = "text", language_col: str = "adapter") -> DataFrame:
    """One row an import: ``rel_path, module, items, external, wildcard, aliases, start, end``."""

    def run(parts):
        for pdf in parts:
            rows = [
                (path, i.module, list(i.items), i.external, i.wildcard, i.aliases, i.start, i.end)
                for path, text, lang in zip(pdf[path_col], pdf[text_col], pdf[language_col], strict=True)
                if lang in LANGUAGES and text
                for i in reading.imports(text, lang)
            ]
            yield pd.DataFrame(rows, columns=["rel_path", "module", "items", "external", "wildcard", "aliases", "start", "end"])

    batches.limited(files.sparkSession)
    return files.select(path_col, text_col, language_col).mapInPandas(run, "rel_path string, module string, items array<string>, external boolean, wildcard boolean, aliases map<string,string>, start bigint, end bigint")


def trivial(path: Column, text: Column, language: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(paths: pd.Series, texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([reading.is_trivial(p, t or "", a) for p, t, a in zip(paths, texts, languages, strict=True)])

    return run(path, text, language)


#: Other adapters: name → ``f(text, options, label) -> (text, metadata)``. They take the place of the built-in ones.
ADAPTERS: dict[str, Callable[[str, dict, str], tuple[str, dict]]] = {}


def register(name: str, f: Callable[[str, dict, str], tuple[str, dict]]) -> None:
    ADAPTERS[name] = f


def _rule(d: dict) -> markdown.Rule:
    m = d.get("match") or {}
    return markdown.Rule(m.get("kind"), m.get("pattern", ""), m.get("flags") or "", tuple(d.get("path") or ()), d.get("level_exact"), d.get("level_at_most"), d.get("level_at_least"), d.get("reason"), d.get("placeholder"))


def markdown_options(o: dict) -> markdown.MarkdownOptions:
    """From a section's Markdown options; unknown keys raise."""
    known = set("directive_prefix drop empty_policy enable_templating keep max_heading_level placeholder placeholder_inside_heading strip_h1".split())
    if bad := set(o) - known:
        raise markdown.MarkdownError(f"unknown Markdown options: {', '.join(sorted(bad))}")
    drop, keep, place = o.get("drop") or {}, o.get("keep") or {}, o.get("placeholder") or {}
    template = None if place.get("mode") == "none" else place.get("template") or "> *(omitted)*"
    prefix = o.get("directive_prefix", "doc") if o.get("enable_templating", True) else None
    return markdown.MarkdownOptions(
        tuple(map(_rule, drop.get("sections") or ())), tuple(map(_rule, keep.get("sections") or ())), bool(drop.get("frontmatter") or keep.get("frontmatter")), template,
        o.get("max_heading_level"), bool(o.get("strip_h1", False)), bool(o.get("placeholder_inside_heading", False)), prefix,
    )


#: The metadata's key for what is wrong with a document, which then is left as it is.
PROBLEM = "problem"


def processed_files(files: DataFrame, holds: Callable[[str], bool] = lambda _: False, count: Callable[[str], int] = transforms.count_tokens, keep_trivial: bool = False) -> DataFrame:
    """Adds ``processed_text`` and ``meta`` to ``rel_path, text, adapter, options (JSON), label``. Texts end in one newline.

    Trivial files go, or with ``keep_trivial`` have a null text. Of a Markdown document that breaks its options' rules
    the metadata say so, under :data:`PROBLEM`.
    """
    extra, literals = dict(ADAPTERS), dict(transforms.LITERALS)

    def run(parts):
        transforms.LITERALS.update(literals)
        memo: dict[str, dict] = {}
        plans: dict[str, tuple] = {}
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("rel_path", "text", "adapter", "options", "label")]
            made = []
            for path, text, name, option, label in zip(*columns, strict=True):
                text, option = text or "", option or "{}"
                o = memo.get(option)
                if o is None:
                    o = memo.setdefault(option, json.loads(option))
                if name in extra:
                    out, meta = extra[name](text, o, label)
                elif name == "markdown":
                    options = markdown_options(o)
                    try:
                        out, meta = markdown.process(text, options, label, holds)
                    except markdown.MarkdownError as error:
                        out, meta = text, {PROBLEM: str(error)}
                elif name in LANGUAGES:
                    if o.get("skip_trivial_files", True) and reading.is_trivial(path, text, name):
                        made.append((False, None, None))
                        continue
                    plan = plans.get(option)
                    if plan is None:
                        plan = plans.setdefault(option, transforms.steps(o))
                    out, meta = transforms.processed(text, name, *plan, count)
                else:
                    out, meta = text, {}
                made.append((True, out.rstrip("\n") + "\n" if out else out, [(k, str(v)) for k, v in meta.items()]))
            if not keep_trivial:
                stays = [x[0] for x in made]
                part, made = part.filter(pa.array(stays, pa.bool_())), [x for x in made if x[0]]
            kind = part.schema.field("text").type
            texts, metas = pa.array([x[1] for x in made], kind), pa.array([x[2] for x in made], pa.map_(kind, kind))
            yield pa.RecordBatch.from_arrays([*part.columns, texts, metas], names=[*part.schema.names, "processed_text", "meta"])

    text = S.StringType()
    schema = S.StructType([*files.schema.fields, S.StructField("processed_text", text), S.StructField("meta", S.MapType(text, text))])
    return batches.mapped(files, run, schema)
