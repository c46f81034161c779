"""Change sets as streams: which files are affected, and running token totals, as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import token_count


def latest(events: DataFrame, time_col: str = "modified", late: str = "10 minutes") -> DataFrame:
    """Each version of a file once: repeats of ``rel_path`` and time within the watermark are dropped."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["rel_path", time_col])


def affected(files: DataFrame, changed: DataFrame) -> DataFrame:
    """A stream of file events without those whose path isn't in the change set; the set is a static table."""
    return files.join(changed.select("rel_path"), "rel_path", "left_semi")


def running_totals(files: DataFrame, by: str, time_col: str = "modified", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Files, bytes and tokens of each window and group; a window closes once it is older than the watermark."""
    measured = files.withWatermark(time_col, late).select(time_col, by, F.octet_length("text").cast("bigint").alias("bytes"), token_count(F.col("text")).alias("tokens"))
    return measured.groupBy(F.window(time_col, every), by).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
