"""Reusing what was computed: processed texts and token counts as keyed Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.lookup import config_key


def processed_key(text: Column, label: Column, options: dict) -> Column:
    """Of all that a processed text depends on: content, label, and the options with tags, task, provider and origin among them."""
    return F.sha2(F.concat_ws("\0", text, label, F.lit(config_key(options))), 256)


def token_key(text: Column, library: str, encoder: str) -> Column:
    return F.concat_ws(":", F.lit(library), F.lit(encoder), F.sha2(text, 256))


class Store:
    """Append-only Parquet tables below a folder; a reader takes any one row of a key, as all of a key are equal."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        target, fs = self._fs(self._path(name))
        return bool(fs.exists(target))

    def _read(self, name: str) -> DataFrame:
        """The table as it is now. Spark takes scans of one path for equal, though files came between them; an option of their own keeps them apart."""
        return self.spark.read.option("loomtext.read", uuid.uuid4().hex).parquet(self._path(name))

    def through(self, name: str, keyed: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
        """``compute`` of the distinct keys that aren't stored yet, appended; then all of ``keyed`` with its stored columns."""
        todo = keyed.dropDuplicates([key])
        if self.exists(name):
            todo = todo.join(self._read(name).select(key), key, "left_anti")
        compute(todo).write.mode("append").parquet(self._path(name))
        known = self._read(name).dropDuplicates([key])
        return keyed.join(known, key, "left")

    def snapshot(self) -> dict[str, tuple[int, int]]:
        """Files and bytes of each table."""
        target, fs = self._fs(self.folder)
        if not fs.exists(target):
            return {}
        out = {}
        for status in fs.listStatus(target):
            summary = fs.getContentSummary(status.getPath())
            out[status.getPath().getName()] = (int(summary.getFileCount()), int(summary.getLength()))
        return out

    def purge(self) -> None:
        target, fs = self._fs(self.folder)
        fs.delete(target, True)

    def rebuild(self) -> None:
        self.purge()
        target, fs = self._fs(self.folder)
        fs.mkdirs(target)


def counted_once(texts: DataFrame, count: Callable[[Column], Column], text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Each distinct text is counted once and the counts are joined back on the text's digest."""
    keyed = texts.withColumn("__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    once = keyed.groupBy("__key").agg(F.first(text_col).alias("__text")).select("__key", count(F.col("__text")).alias(out))
    return keyed.join(once, "__key").drop("__key")
