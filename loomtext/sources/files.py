"""Corpora from directories: a listing of paths and sizes, and texts where they are asked for."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import filters, ignore


#: A tree is listed on the driver until so many directories are found; each is then listed by a task.
FANOUT = 256
_SCHEMA = "rel_path string, abs_path string, size_bytes bigint, modified timestamp"


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The filesystem and the path of a URI; a path without a scheme is local."""
    return fs.FileSystem.from_uri(root) if re.match("[A-Za-z][A-Za-z0-9+.-]*:", root) else (fs.LocalFileSystem(), os.path.abspath(root))


def _entries(system: fs.FileSystem, base: str, directory: str, descend: Callable[[str], bool]) -> tuple[list[tuple], list[str]]:
    """The files of one directory, and those of its directories that are worth listing, by their paths below ``base``."""
    found, below = [], []
    for info in system.get_file_info(fs.FileSelector(f"{base}/{directory}" if directory else base)):
        rel = info.path[len(base) :].lstrip("/")
        if info.type == fs.FileType.Directory:
            if info.base_name != ".git" and descend(rel):
                below.append(rel)
        elif info.type == fs.FileType.File:
            found.append((rel, info.path, info.size or 0, info.mtime))
    return found, below


def listing(spark: SparkSession, root: str, glob: str | None = None, descend: Callable[[str], bool] | None = None) -> DataFrame:
    """``rel_path, abs_path, size_bytes, modified`` of every file below ``root`` outside ``.git``, empty ones too.

    Only the first :data:`FANOUT` directories are listed on the driver; those below them are each a task's work, so the
    paths of a large tree never meet in one place. Directories that ``descend`` refuses aren't looked into.
    """
    enter = descend or (lambda _: True)
    system, base = _filesystem(root.rstrip("/") or "/")
    rows, todo = [], [""]
    while todo and len(todo) < FANOUT:
        found, below = _entries(system, base, todo.pop(0), enter)
        rows += found
        todo += below

    def walk(batches):
        system, _ = _filesystem(root)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                stack = [start]
                while stack:
                    found, below = _entries(system, base, stack.pop(), enter)
                    stack += below
                    columns = list(zip(*found, strict=True)) or [[], [], [], []]
                    types = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rel_path", "abs_path", "size_bytes", "modified"])

    near = spark.createDataFrame(rows, _SCHEMA)
    files = near
    if todo:
        starts = spark.createDataFrame([(t,) for t in todo], "d string").repartition(min(len(todo), 8 * spark.sparkContext.defaultParallelism))
        # Directories differ in size: files are spread anew before anyone reads them.
        files = near.unionByName(starts.mapInArrow(walk, _SCHEMA).repartition("rel_path"))
    if glob:
        files = files.where(F.regexp_extract("rel_path", "([^/]*)$", 1).rlike(fnmatch.translate(glob).replace("\\Z", "\\z")))
    return files


def text_of(abs_path: Column, root: str) -> Column:
    """The text of a file in UTF-8, of which bytes that are not are dropped. Only the rows that are left of a plan's filters are read."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        system, _ = _filesystem(root)

        def read(path):
            with system.open_input_stream(path) as stream:
                return stream.read().decode("utf-8", "ignore")

        return paths.map(read, na_action="ignore")

    return run(abs_path)


def scanned(files: DataFrame, extensions: Iterable[str], tree: filters.FilterNode | None = None, rules: list[tuple[int, bool, str]] | None = None, scope: str = "") -> DataFrame:
    """The files that a section takes: by scope, extension, ignore rules and filter tree; each path once."""
    path = F.col("rel_path")
    out = files.where(filters.in_scope(path, scope) & filters.has_extension(path, extensions))
    if rules:
        out = out.where(~ignored_anywhere(path, rules))
    if tree is not None:
        sub = F.substring(path, F.lit(len(scope.strip("/")) + 2), F.length(path)) if scope.strip("/") else path
        out = out.where(filters.included(tree, sub))
    return out


def ignored_anywhere(path: Column, rules: list[tuple[int, bool, str]]) -> Column:
    return ignore.is_ignored(path, rules)


def external(files: DataFrame, globs: Iterable[str], scope: str = "") -> DataFrame:
    """Files that allow patterns with ``..`` name from the scope's directory; no filter tree applies to them."""
    from loomtext.functions.globs import ignore_pattern
    from loomtext.operators.lookup import resolved_path

    wanted = F.lit(False)
    for pattern in globs:
        found = ignore_pattern("/" + resolved_path(pattern.lstrip("/"), scope))
        if found:
            wanted = wanted | F.col("rel_path").rlike(found[1])
    return files.where(wanted)


def with_text(files: DataFrame, root: str = "/") -> DataFrame:
    return files.withColumn("text", text_of(F.col("abs_path"), root))


def first_by(files: DataFrame, key: str = "abs_path", order: str = "rel_path") -> DataFrame:
    """One row for each resolved path: the first in order."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(files.columns)


def pruning(tree: filters.FilterNode, scope: str = "") -> Callable[[str], bool]:
    """For :func:`listing`: whether a directory may hold a file that a section of ``scope`` with this filter tree takes."""
    full, scope = filters.expanded(tree), scope.strip("/")

    def descend(directory: str) -> bool:
        if not scope:
            return filters.may_descend(full, directory)
        if f"{scope}/".startswith(f"{directory}/"):
            return True
        return directory.startswith(f"{scope}/") and filters.may_descend(full, directory[len(scope) + 1 :])

    return descend
