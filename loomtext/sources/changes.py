"""Changed paths as a relation: from a git working tree, from a branch, or none."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = ("main", "master", "develop", "origin/main", "origin/master", "origin/develop")
SCHEMA = "rel_path string"


class ChangeSource(Protocol):
    def changed(self) -> set[str]: ...

    def branch_changed(self, target: str | None = None) -> set[str]: ...


class NoChanges:
    """For trees without version control."""

    def changed(self) -> set[str]:
        return set()

    def branch_changed(self, target: str | None = None) -> set[str]:
        return set()


class GitChanges:
    def __init__(self, root: str):
        self.root = root

    def _git(self, *args: str) -> list[str] | None:
        done = subprocess.run(["git", "-C", self.root, *args], capture_output=True, text=True)
        return [x for x in done.stdout.splitlines() if x.strip()] if done.returncode == 0 else None

    def changed(self) -> set[str]:
        """Unstaged, staged and untracked files."""
        kinds = ("diff --name-only", "diff --cached --name-only", "ls-files --exclude-standard --others")
        return {path for kind in kinds for path in self._git(*kind.split()) or ()}

    def merge_base(self, target: str | None = None) -> str | None:
        """With the named branch, here or at origin; failing that with the first usual main branch there is."""
        names = [target, f"origin/{target}"] if target else []
        for name in [*names, *CANDIDATES]:
            found = self._git("merge-base", "HEAD", name)
            if found:
                return found[0]
        return None

    def branch_changed(self, target: str | None = None) -> set[str]:
        """What the branch changed since it left its target, and what isn't committed; without a base only the latter."""
        base = self.merge_base(target)
        return (set(self._git("diff", "--name-only", f"{base}..HEAD") or ()) if base else set()) | self.changed()


def relation(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(set(paths))], SCHEMA)


def for_mode(source: ChangeSource, mode: str, target: str | None = None) -> set[str] | None:
    """The paths that count for ``all`` (None: any), ``changes`` or ``branch-changes``."""
    if mode == "all":
        return None
    return source.changed() if mode == "changes" else source.branch_changed(target)


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """A left-semi join on the path; Spark broadcasts the changed paths when they are few."""
    return files.join(changed.select("rel_path"), "rel_path", "left_semi")
