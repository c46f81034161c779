"""Ignore files: ordered patterns, of which the last that matches decides."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.globs import ignore_pattern


def rebased(pattern: str, directory: str) -> str:
    """A pattern of a directory's ignore file, as one of the root's."""
    mark, body = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
    if body.startswith("/"):
        body = body[1:]
        body = f"{directory}/{body}" if directory else f"/{body}"
    elif directory:
        body = f"{directory}/{body}" if "/" in body and not body.startswith("**/") else f"{directory}/**/{body}"
    elif "/" not in body:
        body = f"**/{body}"
    return mark + body


def compiled(files: Mapping[str, Iterable[str]], fold_case: bool = False) -> list[tuple[int, bool, str]]:
    """``(order, negated, regex)`` from the lines of each directory's ignore file; deeper directories come later.

    Paths are compared in lower case. Unless ``fold_case`` is set patterns are not, so one with a capital matches nothing.
    """
    out = []
    for directory in sorted(files, key=lambda d: (d.strip("/").count("/") + bool(d.strip("/")), d)):
        for line in files[directory]:
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            text = rebased(line, directory.strip("/"))
            found = ignore_pattern(text.lower() if fold_case else text)
            if found:
                out.append((len(out), *found))
    return out


def is_ignored(path: Column, rules: list[tuple[int, bool, str]]) -> Column:
    """For rules few enough to be an expression; the last match wins."""
    low = F.lower(path)
    out = F.lit(False)
    for _, negated, regex in rules:
        out = F.when(low.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def is_directory_ignored(directory: Column, rules: list[tuple[int, bool, str]]) -> Column:
    bare = F.regexp_replace(directory, "^/+|/+$", "")
    return is_ignored(bare, rules) | is_ignored(F.concat(bare, F.lit("/")), rules)


#: Rules are broadcast in blocks of so many.
BLOCK = 1_000


def ensure_entry(root: str, entry: str, comment: str | None = None) -> bool:
    """Adds a line to the root's ``.gitignore``, after a comment where one is given; False where it is there or blank. A missing file is made."""
    entry, path = entry.strip(), Path(root, ".gitignore")
    lines = path.read_text(encoding="utf-8", errors="replace").splitlines() if path.is_file() else []
    if not entry or entry in (x.strip() for x in lines):
        return False
    more = [*([""] if lines and lines[-1].strip() else []), *([f"# {comment}"] if comment else []), entry]
    path.write_text("\n".join([*lines, *more]) + "\n", encoding="utf-8")
    return True


def ignored_paths(paths: DataFrame, rules: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """For rules in a table ``(ord, negated, regex)``: the distinct paths that they ignore.

    Regular expressions are no join key, so the rules meet all paths, a block at a time, and of each block the last hit
    goes on. Paths are not shuffled but for the last step.
    """
    low = paths.select(path_col).distinct()
    first, last = rules.agg(F.min("ord"), F.max("ord")).first()
    hits = None
    for start in range(first or 0, (last if last is not None else -1) + 1, BLOCK):
        block = F.broadcast(rules.where(F.col("ord").between(start, start + BLOCK - 1)))
        met = low.join(block, F.expr(f"lower(`{path_col}`) RLIKE regex")).select(path_col, "ord", "negated")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return low.where("false")
    return hits.groupBy(path_col).agg(F.max_by("negated", "ord").alias("negated")).where(~F.col("negated")).select(path_col)
