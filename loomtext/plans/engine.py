"""The public API: render a target, report on it, and list what there is."""

from __future__ import annotations

import json
import os
import platform
import re
import sys
import zipfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomtext
from loomtext.functions import markdown, tokens
from loomtext.operators import conditions, ignore, lookup, render, report
from loomtext.operators.code import frames
from loomtext.plans import adaptive, sections, template
from loomtext.sources import cache, changes, files
from loomtext.storage import discard, written


class EngineError(ValueError):
    """Something the caller can put right; the command line turns it into exit code 2."""


@dataclass(frozen=True)
class Options:
    modes: Mapping[str, str] = field(default_factory=dict)
    tags: frozenset[str] = frozenset()
    task: str | None = None
    provider: str | None = None
    target_branch: str | None = None
    tokenizer: str | None = None
    encoder: str = ""
    limit: int = report.CONTEXT_LIMIT
    #: A folder for processed texts and token counts; without one nothing is kept between runs.
    cache: str | None = None


def task_text(given: str | None, stdin=None) -> str | None:
    """A task as it is, ``@file`` for a file's content, ``-`` for standard input; blank means none."""
    if given is None:
        return None
    if given == "-":
        given = (stdin or sys.stdin).read()
    elif given.startswith("@"):
        path = Path(given[1:])
        if not path.is_file():
            raise EngineError(f"no task file {path}")
        given = path.read_text(encoding="utf-8")
    return given.strip() or None


class Engine:
    """One run over a tree.

    ``corpus`` may be any DataFrame with ``rel_path, size_bytes, text``; by default it is the tree below ``root``.
    Configuration is read on the driver; each section is one plan over the corpus.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options = Options(), config_dir: str = sections.CONFIG_DIR, corpus: DataFrame | None = None, vcs: changes.ChangeSource | None = None):
        self.spark, self.root, self.options, self.config_dir = spark, root, options, config_dir
        self._corpus = corpus
        self.vcs = vcs or (changes.GitChanges(root) if os.path.isdir(os.path.join(root, ".git")) else changes.NoChanges())
        self._catalogs: dict[str, sections.Catalog] = {}
        self._rendered: dict[str, str] = {}
        self._used: list[tuple[str, DataFrame, str]] = []
        self._held: list[DataFrame] = []
        self._stats: list[DataFrame] = []
        self._cache = cache.Store(spark, options.cache) if options.cache else None
        self.warnings: list[str] = []

    # Sources

    @property
    def corpus(self) -> DataFrame:
        """The whole tree, or the table given in its place."""
        return self._tree() if self._corpus is None else self._corpus

    def _tree(self, descend=None) -> DataFrame:
        found = files.listing(self.spark, self.root, descend=descend)
        return files.with_text(found, self.root).select("rel_path", "size_bytes", "text")

    def catalog(self, scope: str = "") -> sections.Catalog:
        scope = "" if scope == "self" else scope
        if scope not in self._catalogs:
            made = sections.Catalog(os.path.join(self.root, scope), self.config_dir)
            if not made.folder.is_dir():
                raise EngineError(f"no configuration folder {made.folder}")
            self._catalogs[scope] = made
        return self._catalogs[scope]

    def ignore_rules(self) -> list[tuple[int, bool, str]]:
        found = {}
        for here, names, there in os.walk(self.root):
            names[:] = [n for n in names if n != ".git"]
            if ".gitignore" in there:
                rel = os.path.relpath(here, self.root)
                found["" if rel == "." else rel] = Path(here, ".gitignore").read_bytes().decode("utf-8", "ignore").splitlines()
        return ignore.compiled(found)

    def load(self, kind: str, name: str, scope: str) -> tuple[str, str]:
        folder = self.catalog(scope).folder
        path = folder / f"{name}.{kind}.md"
        if not path.resolve().is_relative_to(folder.resolve()):
            raise EngineError(f"{name!r} leaves the configuration folder")
        if not path.is_file():
            raise EngineError(f"no {'context' if kind == 'ctx' else 'template'} {name!r} in {folder}")
        return path.read_text(encoding="utf-8"), os.path.dirname(name)

    # Resolution

    def target(self, text: str) -> tuple[str, str]:
        """``ctx:name``, ``sec:name``, ``sec@scope:name``; a bare name is a context if there is one, or else a section."""
        if text.startswith("ctx:"):
            return "context", text[4:]
        if text.startswith("sec:"):
            return "section", text[4:]
        if text.startswith("sec@"):
            return "section", text[3:]
        return ("context", text) if (self.catalog().folder / f"{text}.ctx.md").is_file() else ("section", text)

    def _section_loader(self, scope: str):
        def load(ref: str, seen_from: str):
            a = lookup.parse_address(ref)
            at = a["origin"] or (seen_from.split("\0")[0] if "\0" in seen_from else scope)
            name = ("/" if a["absolute"] else "") + a["path"]
            catalog = self.catalog(at)
            try:
                key = catalog.find(name, os.path.dirname(seen_from.split("\0")[-1]))
            except sections.SectionError as error:
                raise EngineError(f"{error} (extended by {seen_from.split(chr(0))[-1]!r})" if seen_from else str(error)) from error
            return f"{at}\0{key}", catalog.raw(key)

        return load

    def model(self, kind: str, name: str) -> adaptive.Model:
        """The modes and tags that a target offers: those of its own section, or of all sections of a context in any branch."""
        if kind == "section":
            a = lookup.parse_address(name)
            return adaptive.resolve(("/" if a["absolute"] else "") + a["path"], self._section_loader(a["origin"] or "self")).model
        named, front = template.collected("ctx", name, self.load)
        out = adaptive.Model()
        for scope, ref in [*named, *(("self", r) for r in front)]:
            try:
                out = out.merged(adaptive.resolve(ref, self._section_loader(scope)).model)
            except EngineError:
                base = ref.rsplit("/", 1)[-1]
                out = out.merged(adaptive.resolve(base, self._section_loader(scope)).model)
        return out

    # Sections

    def section_frame(self, raw: Mapping, name: str, scope: str, holds, vcs_mode: str, origin: str = "self", corpus: DataFrame | None = None) -> DataFrame:
        """A section's files with their processed texts."""
        where = "" if scope == "self" else scope
        section = sections.parsed(name, raw, holds, self.warnings.append)
        rules = self.ignore_rules()
        local = section.tree.mode == "allow" and section.tree.allow and all(_ignored("/".join(filter(None, (where, p.lstrip("/")))), rules) for p in section.tree.allow)
        paths = changes.for_mode(self.vcs, vcs_mode, self.options.target_branch)
        changed = None if paths is None else changes.relation(self.spark, paths)
        outside = [p for p in section.tree.allow if ".." in p.split("/")]
        if corpus is not None:
            base = corpus
        else:
            # Of a tree only the directories are listed that the section's filters may take something from.
            base = self._tree(files.pruning(section.tree, where)) if self._corpus is None and not outside else self.corpus
        plan = sections.planned(base, section, where, origin, changed, None if local else rules)
        if outside:
            more = sections.planned(files.external(base, outside, where), sections.Section(name, section.extensions, sections.filters.FilterNode(), section.skip_empty, section.path_labels, section.adapters, section.targets), "", origin)
            # A path that both name is the section's own.
            plan = files.first_by(plan.withColumn("turn", F.lit(0)).unionByName(more.select(plan.columns).withColumn("turn", F.lit(1))), "rel_path", "turn").drop("turn")
        if self._cache is None:
            return frames.processed_files(plan, holds)
        o = self.options
        run = {"tags": sorted(o.tags), "modes": dict(o.modes), "task": o.task, "provider": o.provider, "origin": origin, "name": name, "vcs": vcs_mode}
        keyed = plan.withColumn("key", cache.processed_key(F.concat_ws("\0", "adapter", "rel_path", "options", "text"), F.col("label"), run))
        done = self._cache.through("processed", keyed, lambda todo: frames.processed_files(todo, holds, keep_trivial=True).select("key", "processed_text", "meta"))
        return done.where("processed_text IS NOT NULL").drop("key")

    def _counts(self, df: DataFrame, **columns: str) -> DataFrame:
        """Adds the token counts of text columns; with a cache each text is counted once for all runs."""
        o = self.options
        count = lambda c: tokens.counts(c, o.tokenizer, o.encoder)
        for name, text in columns.items():
            if self._cache is None:
                df = df.withColumn(name, count(F.col(text)))
                continue
            keyed = df.withColumn("key", cache.token_key(F.coalesce(F.col(text), F.lit("")), o.tokenizer or "builtin", o.encoder))
            df = self._cache.through("tokens", keyed, lambda todo, t=text: todo.select("key", count(F.col(t)).alias("n"))).withColumnRenamed("n", name).drop("key")
        return df

    def _checked(self, done: DataFrame) -> DataFrame:
        """Keeps a section's frame for this run; what went wrong with a document is the caller's error."""
        done = done.persist()
        self._held.append(done)
        bad = done.where(F.col("meta")[frames.PROBLEM].isNotNull()).orderBy("rel_path").select("rel_path", F.col("meta")[frames.PROBLEM].alias("problem")).first()
        if bad:
            raise EngineError(f"{bad.rel_path}: {bad.problem}")
        return done

    def _release(self) -> None:
        for done in self._held:
            done.unpersist()
        self._held = []

    def section_text(self, done: DataFrame) -> str:
        """Files in path order. The document goes to one place, so it is gathered here."""
        plan = done.select(F.lit(0).alias("g"), F.col("rel_path").alias("pos"), "rel_path", "label", "language", "use_fence")
        rows = render.rendered(plan, done.select(F.lit(0).alias("g"), "rel_path", "processed_text"), ["g"]).collect()
        return rows[0].text if rows else ""

    def _section(self, name: str, origin: str | None, ev: template.Evaluator) -> str:
        scope, directory = ev.scopes[-1]
        scope = origin or scope
        catalog = self.catalog(scope)
        key = catalog.find(name, "" if origin else directory)
        canon = (f"sec:{key}" if scope == "self" else f"sec@{scope}:{key}")
        memo = lookup.frozen([canon, sorted(ev.state.tags), ev.state.vcs_mode, ev.scopes[-1][0]])
        if memo not in self._rendered:
            done = self.section_frame(catalog.raw(key), key, scope, conditions.bound(ev.context()), ev.state.vcs_mode, scope if scope != ev.scopes[0][0] else "self")
            done = self._checked(done)
            self._rendered[memo] = self.section_text(done)
            self._frames[memo] = done
        self._used.append((canon, self._frames[memo], self._rendered[memo]))
        return self._rendered[memo].rstrip("\n") if self._in_context else self._rendered[memo]

    def _markdown(self, a: dict, place: template.HeadingContext, ev: template.Evaluator) -> str:
        scope = a["origin"] or ev.scopes[-1][0]
        where = "" if scope == "self" else scope
        pattern = lookup.resolved_path(a["path"], "", True)
        full = "/".join(filter(None, (where, pattern)))
        options: dict = {"max_heading_level": a["level"] or place.level, "strip_h1": place.strip_h1 if a["strip_h1"] is None else a["strip_h1"], "placeholder_inside_heading": place.in_heading}
        if a["anchor"]:
            anchor = markdown.slug(markdown.anchor_words(a["anchor"]))
            options["keep"] = dict(sections=[dict(match=dict(pattern=anchor, kind="slug"))])
            options["placeholder"] = {"mode": "none"}
        raw = dict(extensions=[".md", ".markdown"], filters=dict(mode="allow", allow=["/" + pattern]), markdown=options)
        done = self._checked(self.section_frame(raw, f"md:{full}", scope, conditions.bound(ev.context()), "all"))
        text = self.section_text(done)
        if not text.strip() and "*" not in pattern and done.limit(1).count() == 0:
            raise EngineError(f"no Markdown file {full!r}")
        self._used.append((f"md:{full}", done, text))
        return text.rstrip("\n")

    # Verbs

    _frames: dict[str, DataFrame]
    _in_context = False

    def render(self, target: str) -> str:
        try:
            return self._render(target)
        finally:
            self._release()

    def _render(self, target: str) -> str:
        self._frames, self._used, self._rendered = {}, [], {}
        kind, name = self.target(target)
        model = self.model(kind, name)
        if self.options.provider and kind == "context" and any(s.integration for s in model.modes.values()):
            model.require_provider(conditions.provider_base(self.options.provider) if self.options.provider not in {p for s in model.modes.values() for p in s.providers} else self.options.provider, name)
        ev = template.Evaluator(model, dict(self.options.modes), set(self.options.tags), self.options.task, self.options.provider, self.load, self._section, self._markdown)
        self._in_context = kind == "context"
        if kind == "section":
            a = lookup.parse_address(name)
            return self._section(("/" if a["absolute"] else "") + a["path"], a["origin"], ev)
        return ev.render("ctx", name)

    def report_frames(self, target: str) -> tuple[DataFrame, DataFrame, dict]:
        """Per-file rows and totals as plans over a stored table of the files' measures, and the context block."""
        try:
            return self._report_frames(target)
        finally:
            self._release()

    def _report_frames(self, target: str) -> tuple[DataFrame, DataFrame, dict]:
        text = self._render(target)
        kind, name = self.target(target)
        o = self.options
        every = self.spark.createDataFrame([], "path string, section string, ord int, size_bytes bigint, tokens_raw bigint, tokens_processed bigint, meta map<string,string>")
        for i, (canon, done, _) in enumerate(self._used):
            rows = self._counts(done, tokens_raw="text", tokens_processed="processed_text")
            every = every.unionByName(rows.select(F.col("rel_path").alias("path"), F.lit(canon).alias("section"), F.lit(i).alias("ord"), F.col("size_bytes").cast("bigint"), "tokens_raw", "tokens_processed", "meta"))
        stats = written(report.file_stats(every), "file-stats")
        self._stats.append(stats)
        # The sections' texts are on the driver anyway, as parts of the document that was asked for, and so they are counted there.
        count = tokens.counter(o.tokenizer, o.encoder)
        rendered = [(canon, i, count(body), 0) for i, (canon, _, body) in enumerate(self._used)]
        per_section = report.section_stats(self.spark.createDataFrame(rendered, "section string, ord int, tokens_rendered bigint, size_bytes bigint"))
        total = report.totals(stats, per_section, o.limit)
        block = {}
        if kind == "context":
            r = per_section.agg(F.coalesce(F.sum("tokens_rendered"), F.lit(0)).alias("s")).select(*report.context_block(F.lit(count(text)).cast("bigint"), F.col("s"), o.limit)).first()
            block = {"templateName": f"ctx:{name}", "sectionsUsed": {x.section: x.uses for x in per_section.select("section", "uses").collect()}, **r.asDict()}
        return report.file_rows(stats, o.limit), total, block

    def report(self, target: str) -> dict:
        self._stats = []
        try:
            return self._report(target)
        finally:
            for stats in self._stats:
                discard(stats)

    def _report(self, target: str) -> dict:
        rows, total, block = self.report_frames(target)
        o = self.options
        out = json.loads(report.result(rows, total, "section" if self.target(target)[0] == "section" else "context", target, o.tokenizer or "builtin", o.encoder, o.limit).first().json)
        meta: dict[str, int] = {}
        for f in out["files"]:
            f.setdefault("meta", {})
        for r in report.meta_summary(report.meta_entries(rows)).collect():
            meta[r.key] = r.value
        out["total"]["metaSummary"] = meta
        if block:
            out["context"] = block
        return out

    # Lists

    def list_sections(self, context: str | None = None) -> list[dict]:
        """Of this scope and those below; with a context, those that it refers to."""
        out = []
        if context is None:
            for scope in sections.child_scopes(self.root, self.config_dir):
                out += [{"scope": scope, "name": n} for n in self.catalog(scope).names()]
        else:
            named, front = template.collected("ctx", context, self.load)
            out = [{"scope": "" if s == "self" else s, "name": n} for s, n in dict.fromkeys([*named, *(("self", f) for f in front)])]
        for row in out:
            m = adaptive.resolve(row["name"], self._section_loader(row["scope"] or "self")).model
            row |= {"mode-sets": sorted(m.modes), "tag-sets": sorted(m.tags)}
        return sorted(out, key=lambda r: (r["scope"], r["name"]))

    def list_contexts(self, provider: str | None = None) -> list[str]:
        folder = self.catalog().folder
        names = sorted(p.relative_to(folder).as_posix()[: -len(".ctx.md")] for p in folder.rglob("*.ctx.md"))
        return names if provider is None else adaptive.supported(((n, self.model("context", n)) for n in names), provider)

    def list_mode_sets(self, context: str, provider: str) -> DataFrame:
        model = self.model("context", context)
        model.require_provider(provider, context)
        return adaptive.mode_table(self.spark, model.for_provider(provider))

    def list_tag_sets(self, context: str) -> DataFrame:
        return adaptive.tag_table(self.spark, self.model("context", context))

    def diagnose(self) -> dict:
        """The environment, the configuration and what is wrong with it."""
        checks = []
        for scope in sections.child_scopes(self.root, self.config_dir):
            for name in self.catalog(scope).names():
                try:
                    sections.parsed(name, self.catalog(scope).raw(name), lambda _: False)
                    adaptive.resolve(name, self._section_loader(scope or "self"))
                    checks.append({"check": f"section {name}", "scope": scope, "ok": True, "detail": ""})
                except ValueError as error:
                    checks.append({"check": f"section {name}", "scope": scope, "ok": False, "detail": str(error)})
        for name in self.list_contexts():
            try:
                self.model("context", name)
                checks.append({"check": f"context {name}", "scope": "", "ok": True, "detail": ""})
            except ValueError as error:
                checks.append({"check": f"context {name}", "scope": "", "ok": False, "detail": str(error)})
        return {
            "protocol": report.PROTOCOL, "version": loomtext.__version__, "python": platform.python_version(), "spark": pyspark.__version__, "platform": platform.platform(), "root": os.path.abspath(self.root),
            "config": {"folder": str(self.catalog().folder), "fingerprint": sections.config_fingerprint(str(self.catalog().folder)), "sections": self.catalog().names(True), "contexts": self.list_contexts()},
            "tokenizers": tokens.libraries(), "checks": checks,
        }

    def bundle(self, path: str) -> str:
        """The diagnosis and the configuration files as a zip archive."""
        folder = self.catalog().folder
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("diagnosis.json", json.dumps(self.diagnose(), ensure_ascii=False, indent=2))
            for f in sorted(p for p in folder.rglob("*") if p.is_file()):
                z.write(f, f"config/{f.relative_to(folder).as_posix()}")
        return path


def _ignored(path: str, rules: list[tuple[int, bool, str]]) -> bool:
    hit = [not negated for _, negated, rx in rules if re.search(rx, path.lower())]
    return bool(hit) and hit[-1]


PRESETS = {
    "basic": {
        "sections.yaml": "all:\n  extensions: [.py, .md]\n  filters:\n    mode: block\n    block: ['/.git/', '**/*.log']\n",
        "all.ctx.md": "# Everything\n\n${all}\n",
    },
    "advanced": {
        "sections.yaml": "base:\n  mode-sets:\n    work:\n      title: Work\n      modes:\n        write: {title: Write, tags: [write]}\n        review: {title: Review, tags: [review], vcs_mode: changes}\n  tag-sets:\n    parts:\n      title: Parts\n      tags: {tests: Tests, docs: Docs}\n\nsrc:\n  extends: [base]\n  extensions: [.py]\n  filters:\n    mode: block\n    when:\n      - {condition: 'NOT tag:tests', block: ['/tests/']}\n  python:\n    strip_function_bodies: false\n    when:\n      - {condition: 'tag:review', comment_policy: keep_doc}\n",
        "work.ctx.md": "# Task\n\n${task:prompt:\"Describe the task.\"}\n\n{% if NOT tag:docs %}\n## Source\n\n${src}\n{% endif %}\n",
    },
}


def initialise(root: str, preset: str = "basic", force: bool = False, config_dir: str = sections.CONFIG_DIR) -> dict:
    """Writes a preset's files; files that are there are left, and named as conflicts, unless forced."""
    if preset not in PRESETS:
        raise EngineError(f"unknown preset {preset!r}; there are: {', '.join(sorted(PRESETS))}")
    folder = Path(root) / config_dir
    conflicts = [n for n in PRESETS[preset] if (folder / n).exists()]
    if conflicts and not force:
        return {"ok": False, "created": [], "conflicts": conflicts}
    for name, text in PRESETS[preset].items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    return {"ok": True, "created": sorted(PRESETS[preset]), "conflicts": conflicts}
