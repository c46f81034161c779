"""Sections: where they are defined, how they are found, and the plan that each one is."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import filters, lookup
from loomtext.plans.adaptive import SECTION_KEYS, MetaSectionError

CONFIG_DIR = "context"
LABELS = tuple("scope_relative basename relative".split())


class SectionError(ValueError):
    pass


def _yaml(path: Path) -> dict:
    with path.open(encoding="utf-8") as file:
        data = yaml.safe_load(file) or {}
    if not isinstance(data, dict):
        raise SectionError(f"{path} doesn't hold a mapping")
    # An old file may still carry the number of its schema.
    data.pop("schema_version", None)
    return {str(name): raw for name, raw in data.items()}


@dataclass
class Catalog:
    """The sections below a scope's configuration folder, read again when one of their files has changed."""

    root: str
    config_dir: str = CONFIG_DIR
    _files: dict[str, float] = field(default_factory=dict)
    _sections: dict[str, tuple[str, str]] = field(default_factory=dict)
    _loaded: dict[str, dict] = field(default_factory=dict)

    @property
    def folder(self) -> Path:
        return Path(self.root) / self.config_dir

    def _paths(self) -> tuple[list[Path], list[Path]]:
        return sorted(self.folder.rglob("sections.yaml")), sorted(self.folder.rglob("*.sec.yaml"))

    def refresh(self) -> None:
        whole, parts = self._paths()
        times = {str(p): p.stat().st_mtime for p in (*whole, *parts)}
        if times.keys() == self._files.keys() and all(abs(times[p] - self._files[p]) <= 0.001 for p in times):
            return
        self._files, self._sections, self._loaded = times, {}, {}
        for path in whole:
            prefix = path.parent.relative_to(self.folder).as_posix()
            for name in self._read(path):
                self._sections[name if prefix == "." else f"{prefix}/{name}"] = (str(path), name)
        for path in parts:
            stem = path.relative_to(self.folder).as_posix()[: -len(".sec.yaml")]
            names = list(self._read(path))
            for name in names:
                full = f"{stem}/{name}" if len(names) > 1 else posixpath.join(posixpath.dirname(stem), name)
                self._sections.setdefault(full, (str(path), name))

    def _read(self, path: Path | str) -> dict:
        return self._loaded.setdefault(str(path), _yaml(Path(path)))

    def names(self, meta: bool = False) -> list[str]:
        """Sorted; sections without filters only serve to be extended and are left out unless asked for."""
        self.refresh()
        return sorted(n for n in self._sections if meta or "filters" in self.raw(n))

    def find(self, name: str, directory: str = "") -> str:
        """The key of a section: below the directory it is named in, or else at the top; a leading slash means the top."""
        self.refresh()
        tried = [name.lstrip("/")] if name.startswith("/") else [*([f"{directory}/{name}"] if directory else []), name]
        for key in tried:
            if key in self._sections:
                return key
        raise SectionError(f"no section {name!r}; looked for {', '.join(tried)}")

    def raw(self, key: str) -> dict:
        path, name = self._sections[key]
        return dict(self._read(path)[name] or {})


@dataclass
class Section:
    """A section ready to run: its configuration with conditions decided."""

    name: str
    extensions: list[str]
    tree: filters.FilterNode
    skip_empty: bool
    path_labels: str
    adapters: dict[str, dict]
    targets: list[tuple[list[str], dict[str, dict]]]


def _decided(options: Mapping, holds: Callable[[str], bool]) -> dict:
    base = {k: v for k, v in options.items() if k != "when"}
    when = [(w["condition"], {k: v for k, v in w.items() if k != "condition"}) for w in options.get("when") or []]
    out = lookup.resolved_options(base, when, holds)
    if isinstance(out.get("skip_empty"), bool):  # the old spelling of empty_policy
        out["empty_policy"] = "exclude" if out.pop("skip_empty") else "include"
    return out


def parsed(name: str, raw: Mapping, holds: Callable[[str], bool], warn: Callable[[str], None] = lambda _: None) -> Section:
    if "filters" not in raw:
        raise MetaSectionError(f"section {name!r} has no filters and can only be extended")
    labels = str(raw.get("path_labels", LABELS[0])).lower().strip()
    if labels not in LABELS:
        raise SectionError(f"section {name!r}: path_labels {labels!r}")
    adapters = {k: _decided(v, holds) for k, v in raw.items() if k not in SECTION_KEYS and _mapping(name, k, v)}
    targets = []
    for t in raw.get("targets") or []:
        match = [t["match"]] if isinstance(t["match"], str) else list(t["match"])
        targets.append((match, {k: _decided(v, holds) for k, v in t.items() if k != "match" and _mapping(name, k, v)}))
    tree = filters.conditioned(filters.expanded(filters.FilterNode.parse(raw["filters"])), holds, warn)
    return Section(name, [str(e) for e in raw.get("extensions", (".py",))], tree, bool(raw.get("skip_empty", True)), labels, adapters, targets)


def _mapping(section: str, key: str, value) -> bool:
    if not isinstance(value, dict):
        raise SectionError(f"section {section!r}: the options of {key!r} must be a mapping")
    return True


def planned(files: DataFrame, section: Section, scope: str = "", origin: str = "self", changed: DataFrame | None = None, rules: list | None = None) -> DataFrame:
    """``rel_path, text, size_bytes, language, adapter, options, label, use_fence`` of a section's files.

    One scan: whether the section holds documents only is an aggregate of the same relation. Such a section ignores the
    change filter and has no fences.
    """
    from loomtext.sources.files import scanned

    path = F.col("rel_path")
    found = scanned(files, section.extensions, section.tree, rules, scope)
    found = found.withColumns({"language": lookup.language(path), "adapter": lookup.adapter(path)})
    policy = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in section.adapters.items() for x in (F.lit(k), F.lit(str(v.get("empty_policy", "inherit"))))]), F.col("adapter")), F.lit("inherit")) if section.adapters else None
    found = found.where(~filters.skips_empty(F.col("size_bytes"), section.skip_empty, policy)).dropDuplicates(["rel_path"])
    docs = found.agg(lookup.is_doc_only(F.col("language")).alias("__docs"))
    found = found.crossJoin(F.broadcast(docs))
    if changed is not None:
        hit = changed.select("rel_path", F.lit(True).alias("__hit")).distinct()
        found = found.join(hit, "rel_path", "left").where(F.col("__docs") | F.col("__hit")).drop("__hit")
    found = found.withColumn("use_fence", ~F.col("__docs")).drop("__docs").withColumn("options", _options(section, path))
    if section.path_labels == "basename":
        return found.join(lookup.unique_suffixes(found), "rel_path")
    return found.withColumn("label", path if section.path_labels == "relative" else lookup.relative_label(path, origin))


def _options(section: Section, path):
    """The options of each file as JSON: those of its adapter, with every target that matches laid over them in turn."""
    out = F.lit("{}")
    names = {*section.adapters, *(k for _, a in section.targets for k in a)}
    order = sorted(range(len(section.targets)), key=lambda i: (lookup.specificity(section.targets[i][0]), i))
    own = lookup.adapter(path)
    for name in sorted(names):
        states = [(F.lit(True), dict(section.adapters.get(name, {})))]
        for i in order:
            patterns, adapters = section.targets[i]
            if name in adapters:
                rx = "|".join("(?s:" + lookup.name_pattern(p.lstrip("/"))[4:] + ")" for p in patterns)
                states = [x for cond, o in states for x in ((cond & path.rlike(rx), {**o, **adapters[name]}), (cond & ~path.rlike(rx), o))]
        for cond, o in states:
            out = F.when((own == name) & cond, F.lit(json.dumps(o, sort_keys=True))).otherwise(out)
    return out


def config_fingerprint(folder: str) -> str:
    """Of a configuration tree; see :func:`fingerprint`."""
    return fingerprint((path.relative_to(folder).as_posix(), path.read_bytes()) for path in Path(folder).rglob("*") if path.is_file())


def fingerprint(entries: Iterable[tuple[str, bytes]]) -> str:
    """The digest of the digests of files ``(path, content)``, sorted."""
    lines = [f"F {hashlib.sha1(content).hexdigest()} {path}" for path, content in entries]
    return hashlib.sha1("\n".join(sorted(lines)).encode()).hexdigest()


def child_scopes(root: str, config_dir: str = CONFIG_DIR) -> list[str]:
    """Directories below the root that have a configuration of their own."""
    out = []
    for here, names, _ in os.walk(root):
        names[:] = [n for n in names if not n.startswith(".")]
        if config_dir in names:
            rel = os.path.relpath(here, root)
            out.append("" if rel == "." else rel)
    return sorted(out)
