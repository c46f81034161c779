"""Mode sets and tag sets: what a run may choose, merged along ``extends``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

CLIPBOARD = "clipboard"


class AdaptiveError(ValueError):
    pass


class CycleError(AdaptiveError):
    def __init__(self, cycle: list[str]):
        super().__init__("sections extend each other: " + " → ".join(cycle))
        self.cycle = cycle


class UnknownModeError(AdaptiveError):
    pass


class IntegrationError(AdaptiveError):
    pass


class ProviderError(AdaptiveError):
    pass


class MetaSectionError(AdaptiveError):
    pass


@dataclass(frozen=True)
class Mode:
    id: str
    title: str
    description: str = ""
    tags: tuple[str, ...] = ()
    default_task: str | None = None
    vcs_mode: str = "all"
    runs: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, key: str, data) -> Mode:
        if isinstance(data, str):
            return cls(key, data)
        data = data or {}
        mode = str(data.get("vcs_mode", "all"))
        if mode not in ("all", "changes", "branch-changes"):
            raise AdaptiveError(f"mode {key!r}: vcs_mode {mode!r}")
        return cls(key, str(data.get("title", key)), str(data.get("description", "")), tuple(data.get("tags") or ()), data.get("default_task"), mode, dict(data.get("runs") or {}))

    def supports(self, provider: str) -> bool:
        return provider == CLIPBOARD or provider in self.runs


@dataclass(frozen=True)
class ModeSet:
    id: str
    title: str
    modes: Mapping[str, Mode]

    @property
    def integration(self) -> bool:
        """Whether its modes name what they run with."""
        return any(m.runs for m in self.modes.values())

    @property
    def providers(self) -> set[str]:
        return {p for m in self.modes.values() for p in m.runs}

    def for_provider(self, provider: str) -> ModeSet:
        return replace(self, modes={k: m for k, m in self.modes.items() if m.supports(provider)}) if self.integration else self


@dataclass(frozen=True)
class TagSet:
    id: str
    title: str
    tags: Mapping[str, tuple[str, str]]


@dataclass(frozen=True)
class Model:
    modes: Mapping[str, ModeSet] = field(default_factory=dict)
    tags: Mapping[str, TagSet] = field(default_factory=dict)

    @classmethod
    def parse(cls, section: Mapping) -> Model:
        modes = {k: ModeSet(k, str(v.get("title", k)), {m: Mode.parse(m, d) for m, d in (v.get("modes") or {}).items()}) for k, v in (section.get("mode-sets") or {}).items()}
        tags = {}
        for k, v in (section.get("tag-sets") or {}).items():
            named = {t: (d, "") if isinstance(d, str) else (str((d or {}).get("title", t)), str((d or {}).get("description", ""))) for t, d in (v.get("tags") or {}).items()}
            tags[k] = TagSet(k, str(v.get("title", k)), named)
        return cls(modes, tags)

    def merged(self, child: Model) -> Model:
        """Set by set; the child's title and entries win."""
        modes, tags = dict(self.modes), dict(self.tags)
        for k, s in child.modes.items():
            modes[k] = replace(s, modes={**modes[k].modes, **s.modes}) if k in modes else s
        for k, t in child.tags.items():
            tags[k] = replace(t, tags={**tags[k].tags, **t.tags}) if k in tags else t
        return Model(modes, tags)

    def for_provider(self, provider: str) -> Model:
        return replace(self, modes={k: s.for_provider(provider) for k, s in self.modes.items()})

    @property
    def tagsets(self) -> dict[str, set[str]]:
        return {k: set(t.tags) for k, t in self.tags.items()}

    def mode(self, set_id: str, mode_id: str) -> Mode:
        if set_id not in self.modes:
            raise UnknownModeError(f"no mode set {set_id!r}; there are: {', '.join(sorted(self.modes))}")
        if mode_id not in self.modes[set_id].modes:
            raise UnknownModeError(f"no mode {mode_id!r} in {set_id!r}; there are: {', '.join(self.modes[set_id].modes)}")
        return self.modes[set_id].modes[mode_id]

    def integration(self, context: str = "") -> ModeSet:
        """The one mode set with runs; none or several raise."""
        found = [s for s in self.modes.values() if s.integration]
        if len(found) != 1:
            raise IntegrationError(f"context {context!r} needs one integration mode set, not {len(found)}: {', '.join(sorted(s.id for s in found))}")
        return found[0]

    def require_provider(self, provider: str, context: str = "") -> None:
        if provider != CLIPBOARD and provider not in self.integration(context).providers:
            raise ProviderError(f"context {context!r} doesn't support {provider!r}")


@dataclass
class Resolved:
    """A section with what it inherits."""

    model: Model = field(default_factory=Model)
    extensions: tuple[str, ...] = ()
    adapters: dict = field(default_factory=dict)
    skip_empty: bool = True
    path_labels: str = "scope_relative"


def merged_adapters(base: Mapping, child: Mapping) -> dict:
    """Adapter by adapter: the child's options win, conditional ones follow the parent's."""
    out = dict(base)
    for name, options in child.items():
        if name in out:
            when = [*(out[name].get("when") or []), *(options.get("when") or [])]
            out[name] = {**out[name], **options, **({"when": when} if when else {})}
        else:
            out[name] = options
    return out


def resolve(name: str, load: Callable[[str, str], tuple[str, Mapping]]) -> Resolved:
    """Folds a section's ancestors, in order, under it. ``load(name, seen_from)`` gives a key and the raw section."""
    memo: dict[str, Resolved] = {}
    stack: list[str] = []

    def visit(ref: str, seen_from: str) -> Resolved:
        key, raw = load(ref, seen_from)
        if key in memo:
            return memo[key]
        if key in stack:
            raise CycleError([*stack[stack.index(key) :], key])
        stack.append(key)
        out = Resolved()
        parents = raw.get("extends") or []
        for parent in [parents] if isinstance(parents, str) else parents:
            p = visit(parent, key)
            out = Resolved(out.model.merged(p.model), tuple(dict.fromkeys((*out.extensions, *p.extensions))), merged_adapters(out.adapters, p.adapters), p.skip_empty, p.path_labels)
        own = {k: v for k, v in raw.items() if k not in SECTION_KEYS}
        exts = tuple(map(str, raw.get("extensions", (".py",))))
        out = Resolved(
            out.model.merged(Model.parse(raw)), tuple(dict.fromkeys((*out.extensions, *exts))), merged_adapters(out.adapters, own), bool(raw.get("skip_empty", True)), str(raw.get("path_labels", "scope_relative"))
        )
        memo[key] = out
        stack.pop()
        return out

    return visit(name, "")


SECTION_KEYS = set("extends extensions filters mode-sets path_labels skip_empty tag-sets targets".split())


def mode_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(s.id, s.title, m.id, m.title, m.description, list(m.tags), m.default_task, m.vcs_mode, dict(m.runs)) for s in model.modes.values() for m in s.modes.values()]
    return spark.createDataFrame(rows, "set_id string, set_title string, mode_id string, title string, description string, tags array<string>, default_task string, vcs_mode string, runs map<string,string>").orderBy("set_id", "mode_id")


def tag_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(s.id, s.title, t, title, about) for s in model.tags.values() for t, (title, about) in s.tags.items()]
    return spark.createDataFrame(rows, "set_id string, set_title string, tag_id string, title string, description string").orderBy("set_id", "tag_id")


def supported(contexts: Iterable[tuple[str, Model]], provider: str) -> list[str]:
    """The contexts whose one integration set supports a provider; the clipboard is supported by all."""
    out = []
    for name, model in contexts:
        try:
            model.require_provider(provider, name)
        except AdaptiveError:
            continue
        out.append(name)
    return sorted(out)
