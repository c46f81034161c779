"""Token statistics of files, sections and the whole, with every ratio guarded against an empty denominator."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import ratio, saved_percent

CONTEXT_LIMIT = 128_000
PROTOCOL = 5


def file_stats(files: DataFrame, order: str = "ord") -> DataFrame:
    """One row a path from ``path, section, ord, size_bytes, tokens_raw, tokens_processed[, meta]``.

    The first registration's measures count; later ones only add their section, in order of first use.
    """
    first = [F.min_by(c, order).alias(c) for c in files.columns if c not in ("path", "section", order)]
    uses = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("section"))))
    return files.groupBy("path").agg(*first, F.array_distinct(F.transform(uses, lambda u: u["section"])).alias("sections"))


def file_rows(stats: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """The report's file table: savings, share of all processed tokens, share of the context limit.

    ``stats`` is read twice, for the total and for the rows: where its counts cost something it should be a written table.
    """
    raw, processed = F.col("tokens_raw"), F.col("tokens_processed")
    return with_share(stats, "tokens_processed", "promptShare").select(
        F.col("path"), F.col("size_bytes").alias("sizeBytes"), raw.alias("tokensRaw"), processed.alias("tokensProcessed"), (raw - processed).alias("savedTokens"), saved_percent(raw, processed).alias("savedPct"),
        "promptShare", ratio(processed, F.lit(limit)).alias("ctxShare"), *[F.col(c) for c in ("meta",) if c in stats.columns],
    )


def with_share(df: DataFrame, value: str, share_col: str = "share") -> DataFrame:
    """Adds ``value``'s share of its total. The total is one row, aggregated before the shuffle and joined back, so rows stay where they are."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(share_col, ratio(F.col(value), F.col("__total"))).drop("__total")


def section_stats(rendered: DataFrame, order: str = "ord") -> DataFrame:
    """One row a section from ``section, ord, tokens_rendered, size_bytes``: the last registration's measures, and how often it was used."""
    last = [F.max_by(c, order).alias(c) for c in rendered.columns if c not in ("section", order)]
    return rendered.groupBy("section").agg(*last, F.count(F.lit(1)).alias("uses"))


def totals(stats: DataFrame, sections: DataFrame | None = None, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """One row of totals; an empty table has zeros. Saved tokens and overhead may be negative.

    Rendered tokens come from ``sections``, or from a column ``tokens_rendered`` of ``stats`` in the same pass.
    """
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = [zero("tokens_rendered").alias("renderedTokens")] if sections is None and "tokens_rendered" in stats.columns else []
    one = stats.agg(zero("size_bytes").alias("sizeBytes"), zero("tokens_processed").alias("tokensProcessed"), zero("tokens_raw").alias("tokensRaw"), *own)
    if sections is not None:
        one = one.crossJoin(F.broadcast(sections.agg(zero("tokens_rendered").alias("renderedTokens"))))
    raw, processed = F.col("tokensRaw"), F.col("tokensProcessed")
    over = [F.col("renderedTokens"), (F.col("renderedTokens") - processed).alias("renderedOverheadTokens")] if "renderedTokens" in one.columns else []
    return one.select("sizeBytes", "tokensProcessed", "tokensRaw", (raw - processed).alias("savedTokens"), saved_percent(raw, processed).alias("savedPct"), ratio(processed, F.lit(limit)).alias("ctxShare"), *over)


def meta_summary(meta: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Numeric metadata summed by key, from one row an entry; sums and counts combine before the shuffle."""
    return meta.groupBy(key).agg(F.sum(value).alias(value))


def meta_entries(files: DataFrame, meta: str = "meta") -> DataFrame:
    from loomtext.operators.lookup import numeric_meta

    return files.select(F.explode(numeric_meta(F.col(meta))).alias("key", "value"))


def section_usage(rendered: DataFrame) -> DataFrame:
    return rendered.groupBy("section").agg(F.count(F.lit(1)).alias("uses"))


def context_block(final_tokens: Column, section_tokens: Column, limit: int = CONTEXT_LIMIT) -> list[Column]:
    """What the template adds to its sections, never below zero."""
    extra = F.greatest(F.lit(0).cast("bigint"), final_tokens - section_tokens)
    return [final_tokens.alias("finalRenderedTokens"), extra.alias("templateOnlyTokens"), ratio(extra, final_tokens).alias("templateOverheadPct"), ratio(final_tokens, F.lit(limit)).alias("finalCtxShare")]


def merged_metrics(metrics: DataFrame, order: str = "ord") -> DataFrame:
    """Metrics ``key, ord, number, text`` over many collectors: numbers add up, and of texts the last stays."""
    return metrics.groupBy("key").agg(F.sum("number").alias("number"), F.max_by("text", order).alias("text"))


def result(files: DataFrame, total: DataFrame, scope: str, target: str, library: str, encoder: str, limit: int = CONTEXT_LIMIT, context: dict | None = None) -> DataFrame:
    """The whole report as one JSON text; file rows are gathered in path order, as that document needs them all."""
    by_path = lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in files.columns if c != "path"])), by_path).alias("files"))
    head = [F.lit(PROTOCOL).alias("protocol"), F.lit(scope).alias("scope"), F.lit(target).alias("target"), F.lit(library).alias("tokenizerLib"), F.lit(encoder).alias("encoder"), F.lit(limit).cast("bigint").alias("ctxLimit")]
    extra = [F.from_json(F.lit(json.dumps(context)), F.schema_of_json(F.lit(json.dumps(context)))).alias("context")] if context is not None else []
    return total.select(F.struct(*total.columns).alias("total")).crossJoin(listed).select(F.to_json(F.struct(*head, "total", "files", *extra)).alias("json"))
