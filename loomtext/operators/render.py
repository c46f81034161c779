"""Assembling processed files into documents, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trimmed_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\r\f\x0b"))


def _without_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def fence(language: Column, label: Column, text: Column) -> Column:
    """A file's fenced block, headed by its language and label."""
    return F.concat(F.lit("```"), language, F.lit(":"), label, F.lit("\n"), _without_newlines(text), F.lit("\n```\n"))


def rendered(plan: DataFrame, processed: DataFrame, group: list[str], order: str = "pos", key: str = "rel_path") -> DataFrame:
    """``text`` of each group: planned files that were processed, in plan order.

    ``plan`` has ``group, order, key, label, language, use_fence``; ``processed`` has ``group, key, processed_text``.
    Fenced files are blocks with a blank line between them; others follow each other after a blank line. Trailing white
    space becomes one newline. A group whose files all fell out is one newline, and one without a plan has no row.
    """
    both = plan.join(processed.select(*group, key, "processed_text"), [*group, key], "left")
    there = F.col("processed_text").isNotNull()
    part = F.when(F.col("use_fence"), F.concat(fence(F.col("language"), F.col("label"), F.col("processed_text")), F.lit("\n"))).otherwise(F.concat(_without_newlines(F.col("processed_text")), F.lit("\n\n")))
    parts = F.array_sort(F.collect_list(F.when(there, F.struct(F.col(order).alias("o"), part.alias("t")))))
    return both.groupBy(*group).agg(parts.alias("p")).select(*group, F.concat(trimmed_end(F.array_join(F.transform("p", lambda x: x["t"]), "")), F.lit("\n")).alias("text"))


def joined(df: DataFrame, group: list[str], order: str, text: str, separator: str = "\n\n", out: str = "text") -> DataFrame:
    """Texts of a group in order, with a separator; nothing is left of an empty group."""
    body = f"listagg({text}, '{separator.encode('unicode_escape').decode()}') WITHIN GROUP (ORDER BY {order})"
    return df.groupBy(*group).agg(F.coalesce(F.expr(body), F.lit("")).alias(out))
