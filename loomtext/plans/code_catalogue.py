"""Queries over source code in nine languages, which documents are turned into: a declaration for each line."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.code import frames


@dataclass(frozen=True)
class Sample:
    """What files of a language look like. ``one`` is a declaration with ``{p}`` for its visibility, ``{i}`` for the line and ``{n}`` for the line's length."""

    head: str
    one: str
    public: str
    private: str
    imports: tuple[tuple[str, bool], ...]
    kind: str = "function"
    foot: str = ""
    holder: str | None = None
    comment: str = "comment"
    capital: bool = False


_C = "// {n}\n{p}int f{i}(int x) {\n  int y = x + {i};\n  return y;\n}"
SAMPLES = {
    "typescript": Sample('import { a } from "react";\nimport { b } from "./near";\n\n', "// {n}\n{p}function f{i}(x: number): number {\n  const y = x + {i};\n  return y;\n}", "export ", "", (("react", True), ("./near", False))),
    "javascript": Sample('import { a } from "react";\nimport { b } from "./near";\n\n', "// {n}\n{p}function f{i}(x) {\n  const y = x + {i};\n  return y;\n}", "export ", "", (("react", True), ("./near", False))),
    "java": Sample("import java.util.List;\nimport own.near.Thing;\n\npublic class All {\n", "  // {n}\n  {p}int f{i}(int x) {\n    int y = x + {i};\n    return y;\n  }", "public ", "private ", (("java.util.List", True), ("own.near.Thing", False)), "method", "}\n", "class"),
    "kotlin": Sample("import java.util.List\nimport own.near.Thing\n\n", "// {n}\n{p}fun f{i}(x: Int): Int {\n  val y = x + {i}\n  return y\n}", "", "private ", (("java.util.List", True), ("own.near.Thing", False))),
    "scala": Sample("import java.util.List\nimport own.near.Thing\n\nobject All {\n", "  // {n}\n  {p}def f{i}(x: Int): Int = {\n    val y = x + {i}\n    y\n  }", "", "private ", (("java.util.List", True), ("own.near.Thing", False)), "method", "}\n", "object"),
    "go": Sample('package all\n\nimport "fmt"\nimport "github.com/lib/thing"\n\n', "// {n}\nfunc {p}{i}(x int) int {\n\ty := x + {i}\n\treturn y\n}", "F", "f", (("fmt", True), ("github.com/lib/thing", True)), comment="docstring", capital=True),
    "rust": Sample("use std::fmt;\nuse crate::near::thing;\n\n", "// {n}\n{p}fn f{i}(x: i32) -> i32 {\n    let y = x + {i};\n    y\n}", "pub ", "", (("std::fmt", True), ("crate::near::thing", False))),
    "c": Sample('#include <stdio.h>\n#include "near/thing.h"\n\n', _C, "", "static ", (("<stdio.h>", True), ('"near/thing.h"', False))),
    "cpp": Sample('#include <vector>\n#include "near/thing.h"\n\n', _C, "", "static ", (("<vector>", True), ('"near/thing.h"', False))),
}

QUERIES = {}
ORACLE_SQL = {}
_PARTS = re.compile(r"\{[pin]\}")


def _spark(template: str, values: dict[str, Column]) -> Column:
    marks, texts = _PARTS.findall(template), _PARTS.split(template)
    return F.concat(F.lit(texts[0]), *[x for m, t in zip(marks, texts[1:], strict=True) for x in (values[m], F.lit(t))])


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _sql(template: str, values: dict[str, str]) -> str:
    marks, texts = _PARTS.findall(template), _PARTS.split(template)
    return "(" + " || ".join([_quote(texts[0]), *[x for m, t in zip(marks, texts[1:], strict=True) for x in (values[m], _quote(t))]]) + ")"


def sources(spark: SparkSession, sf_dir: str, language: str, options: str = "{}") -> DataFrame:
    """Every document as a file with a declaration for each line, private where the line's length is odd."""
    s = SAMPLES[language]

    def one(line, i):
        p = F.when(F.length(line) % 2 == 1, s.private).otherwise(s.public)
        return _spark(s.one, {"{p}": p, "{i}": i.cast("string"), "{n}": F.length(line).cast("string")})

    text = F.concat(F.lit(s.head), F.array_join(F.transform(F.split("text", "\n"), one), "\n\n"), F.lit("\n" + s.foot))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{language}")).alias("rel_path"), text.alias("text"), F.lit(language).alias("adapter"), F.lit("x").alias("label"), F.lit(options).alias("options"))


_LINES = "l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, length(unnest(string_split(text, chr(10)))) AS n FROM documents)"


def _name(s: Sample) -> str:
    return f"CASE WHEN n % 2 = 1 THEN '{s.private}' ELSE '{s.public}' END || i" if s.capital else "'f' || i"


def _registered(language: str) -> None:
    s, path = SAMPLES[language], f"doc_id || '.{language}' AS rel_path"

    def add(what, run, sql):
        QUERIES[f"{language}_{what}"], ORACLE_SQL[f"{language}_{what}"] = run, sql

    def elements(spark, sf_dir):
        return frames.elements(sources(spark, sf_dir, language)).select("rel_path", "kind", "name", "public")

    holder = f" UNION ALL SELECT DISTINCT {path}, '{s.holder}', 'All', true FROM documents" if s.holder else ""
    add("elements", elements, f"WITH {_LINES} SELECT {path}, '{s.kind}' AS kind, {_name(s)} AS name, n % 2 = 0 AS public FROM l{holder}")

    def imports(spark, sf_dir):
        return frames.imports(sources(spark, sf_dir, language)).select("rel_path", "module", "external")

    rows = ", ".join(f"({_quote(m)}, {str(e).lower()})" for m, e in s.imports)
    add("imports", imports, f"SELECT {path}, m AS module, e AS external FROM documents, (VALUES {rows}) AS t(m, e)")

    def removed(what: str, given: str):
        def run(spark, sf_dir):
            out = frames.processed_files(sources(spark, sf_dir, language, given))
            return out.select("rel_path", F.col("meta")[f"{language}.removed.{what}"].cast("bigint").alias("removed"))

        return run

    lines = f"SELECT {path}, len(string_split(text, chr(10)))::BIGINT AS removed FROM documents"
    add("bodies", removed(f"{s.kind}_body", '{"strip_function_bodies": true}'), lines)
    add("comments", removed(s.comment, '{"comment_policy": "strip_all"}'), lines)

    def public_api(spark, sf_dir):
        out = frames.processed_files(sources(spark, sf_dir, language, '{"public_api_only": true, "placeholders": {"min_savings_ratio": 0}}'))
        return out.select("rel_path", F.md5("processed_text").alias("digest"))

    # A run of private declarations becomes one placeholder.
    indent = " " * (len(s.one) - len(s.one.lstrip(" ")))
    shown = _sql(s.one, {"{p}": f"'{s.public}'", "{i}": "i", "{n}": "n"})
    gone = f"'{indent}// … ' || CASE WHEN k > 1 THEN k || ' {s.kind}s' ELSE '{s.kind}' END || ' omitted (' || 5 * k || ' lines)'"
    add("public_api", public_api, f"""WITH {_LINES}, g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN n % 2 = 1 AND lag(n % 2) OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 0 ELSE 1 END AS new FROM l)),
p AS (SELECT doc_id, min(i) AS i, min(n) AS n, count(*) AS k FROM g GROUP BY doc_id, run)
SELECT {path}, md5({_quote(s.head)} || string_agg(CASE WHEN n % 2 = 1 THEN {gone} ELSE {shown} END, chr(10) || chr(10) ORDER BY i) || chr(10) || {_quote(s.foot)}) AS digest FROM p GROUP BY doc_id""")  # fmt: skip


for _language in SAMPLES:
    _registered(_language)
