"""Hierarchical allow/block rules for paths, folded into one Boolean expression on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions import globs

BARE_NAMES = tuple("Dockerfile Makefile README pyproject.toml".split())


class FilterError(ValueError):
    pass


@dataclass
class FilterNode:
    """Rules of a directory. ``when`` holds ``(condition, allow, block)`` that add to them; children are subdirectories."""

    mode: str = "block"
    allow: list[str] = field(default_factory=list)
    block: list[str] = field(default_factory=list)
    children: dict[str, FilterNode] = field(default_factory=dict)
    when: list[tuple[str, list[str], list[str]]] = field(default_factory=list)

    @classmethod
    def parse(cls, tree: Mapping | None) -> FilterNode:
        tree = tree or {}
        mode = tree.get("mode", "block")
        if mode not in ("allow", "block"):
            raise FilterError(f"a filter's mode is allow or block, not {mode!r}")
        when = [(w["condition"], list(w.get("allow") or []), list(w.get("block") or [])) for w in tree.get("when") or []]
        return cls(mode, list(tree.get("allow") or []), list(tree.get("block") or []), {k: cls.parse(v) for k, v in (tree.get("children") or {}).items()}, when)


def conditioned(node: FilterNode, holds: Callable[[str], bool], warn: Callable[[str], None] = lambda _: None) -> FilterNode:
    """The tree with the rules of all conditions that hold; one that can't be evaluated is reported and left out."""
    allow, block = list(node.allow), list(node.block)
    for condition, more_allow, more_block in node.when:
        try:
            if holds(condition):
                allow += more_allow
                block += more_block
        except ValueError as error:
            warn(f"condition {condition!r}: {error}")
    return FilterNode(node.mode, allow, block, {k: conditioned(c, holds, warn) for k, c in node.children.items()}, list(node.when))


def expanded(node: FilterNode) -> FilterNode:
    """Children whose key is a path become chains of children.

    A directory made on the way allows only the next one, and what its parent's rules allowed below it. Two definitions
    of one directory by different routes raise :class:`FilterError`.
    """
    keyed = {k.strip("/").lower(): v for k, v in node.children.items()}
    flat = {k: v for k, v in keyed.items() if "/" not in k}
    deep = {k: v for k, v in keyed.items() if "/" in k}
    for key in deep:
        parts = key.split("/")
        for i in range(1, len(parts)):
            head, following = "/".join(parts[:i]), parts[i]
            owner = flat.get(head) or deep.get(head)
            if owner is not None and following in {c.strip("/").lower().split("/")[0] for c in owner.children}:
                raise FilterError(f"filter path {key!r} conflicts with what {head!r} defines")
    out = {k: FilterNode(v.mode, list(v.allow), list(v.block), dict(v.children), list(v.when)) for k, v in flat.items()}
    for key, target in sorted(deep.items()):
        parts, level, above = key.split("/"), out, None
        for part, following in zip(parts, parts[1:], strict=False):
            step = f"/{following}/"
            if part not in level:
                prefix = f"/{part}/"
                inherited = ["/" + rule[len(prefix) :].lstrip("/") for rule in (above.allow if above else []) if rule.startswith(prefix) and rule != prefix]
                level[part] = FilterNode("allow", [step, *inherited])
            elif step not in level[part].allow:
                level[part].allow.append(step)
            above, level = level[part], level[part].children
        level[parts[-1]] = target
    return FilterNode(node.mode, list(node.allow), list(node.block), {k: expanded(v) for k, v in out.items()}, list(node.when))


def included(node: FilterNode, path: Column) -> Column:
    """Whether the tree lets a path through.

    The rules of every directory on the way to the path are asked, each about the path below it: a block match rejects,
    and so does an allow list that doesn't match. Case doesn't matter. What nobody rejects is included.
    """
    return _included(expanded(node), F.lower(path))


def _included(node: FilterNode, sub: Column) -> Column:
    lower = lambda rules: [r.lower() for r in rules]
    below = F.lit(True)
    for name, child in node.children.items():
        prefix = name.strip("/").lower() + "/"
        below = F.when(sub.startswith(prefix), _included(child, F.substring(sub, F.lit(len(prefix) + 1), F.length(sub)))).otherwise(below)
    if node.block:
        below = F.when(globs.any_match(sub, lower(node.block)), F.lit(False)).otherwise(below)
    if node.mode == "allow":
        below = F.when(globs.any_match(sub, lower(node.allow)), below).otherwise(F.lit(False))
    return below


def includes(node: FilterNode, path: str):
    """:func:`included` for one path on the driver; the tree must be expanded."""
    sub, now = path.lower(), node
    while True:
        if globs.matches(sub, [r.lower() for r in now.block]) or (now.mode == "allow" and not globs.matches(sub, [r.lower() for r in now.allow])):
            return False
        head, slash, rest = sub.partition("/")
        if not slash or head not in now.children:
            return True
        sub, now = rest, now.children[head]


def may_descend(node: FilterNode, directory: str) -> bool:
    """Whether anything below a directory could be included; it errs towards yes. The tree must be expanded."""
    sub, now, decided = directory.lower().strip("/"), node, None
    while sub:
        allow, block = ([r.lower() for r in rules] for rules in (now.allow, now.block))
        if any(globs.matches(p, block) for p in (sub, sub + "/")):
            return False
        here = any(globs.matches(p, allow) for p in (sub, sub + "/", sub + "/x"))
        if now.mode == "allow":
            if not (here or any("**" in p or "/" not in p or p.lstrip("/").startswith(sub + "/") for p in allow)):
                return False
            decided = True
        elif here:
            decided = True
        head, slash, rest = sub.partition("/")
        if head not in now.children:
            break
        sub, now = rest, now.children[head]
    if not sub:
        # The directory is a node's own: what that node allows lies below.
        return now.mode == "block" or bool(now.allow)
    return decided if decided is not None else now.mode == "block"


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """Paths that end in one of the extensions, whatever their case, and the four bare names."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    wanted = sorted({e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions})
    return F.lower(F.regexp_extract(name, r".(\.[^./]+)$", 1)).isin(wanted) | name.isin(*BARE_NAMES)


def in_scope(path: Column, scope: str) -> Column:
    scope = scope.strip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def skips_empty(size: Column, default: bool, policy: Column | None = None) -> Column:
    """Whether an empty file is left out: a policy of ``include`` or ``exclude`` beats the section's default."""
    policy = F.lit("inherit") if policy is None else F.coalesce(policy, F.lit("inherit"))
    return (size == 0) & F.when(policy == "include", False).when(policy == "exclude", True).otherwise(F.lit(default))
