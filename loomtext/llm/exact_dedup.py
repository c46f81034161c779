"""Exact deduplication by content sort.

Sampled splitters cut the order of normalised texts into ranges; one shuffle sends each range to a partition of its own,
Spark's external sort (which spills) places equal texts side by side, and a streaming pass compares each text in full
with the one before it. Nothing is decided by a hash of the content.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.arrow_text import mapped
from loomtext.llm.storage import fresh

#: Splitters come from so many rows at most, of which the driver sees so many leading characters and a hash. They only balance the ranges.
SAMPLE_ROWS, SAMPLE_CHARS = 100_000, 128


def normalised(text):
    """Line ends become ``\\n`` and white space at either end of the text goes; nothing else counts as equal."""
    return F.btrim(F.regexp_replace(text, "\r\n?", "\n"), F.lit(" \t\n\f"))


def splitters(docs: DataFrame, norm, ranges: int, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most ``ranges - 1`` cuts of the order by leading characters and then hash, even over the distinct texts of a sample of rows.

    Texts with the same beginning are told apart by the hash, so that a heading that many share makes no large range.
    """
    most = min(sample_rows, 40 * ranges)
    share = min(1.0, 1.1 * most / max(1, docs.count()))
    picked = docs.select(F.substring(norm, 1, SAMPLE_CHARS).alias("s"), F.xxhash64(norm).alias("h")).where("s IS NOT NULL")
    got = sorted({(r.s, r.h) for r in picked.sample(share, seed=1).limit(most).collect()})
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def _tie(docs: DataFrame):
    """A hash over all columns, which orders rows of one id and equal text."""
    odd = lambda c: any(k in docs.schema[c].dataType.simpleString() for k in ("map<", "variant", "interval"))
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if odd(c) else F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row of ``docs`` for each distinct normalised text, that of the smallest ``id_col``; all columns are kept as they are.

    Null texts equal each other and nothing else (an empty text is not null); a null id loses to any other. Of several
    rows with the smallest id the one whose columns hash lowest stays, whatever the partitioning, and of repeated rows
    one. Other columns may have any names and hold nulls. A very long text is a row like any other: it is sorted and
    compared whole. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = spark.sparkContext.broadcast(splitters(docs, norm, ranges, sample_rows))
    n_, own_, tie_, hash_, part_ = fresh(docs.columns, "norm", "own", "tie", "hash", "range")
    rest = [c for c in docs.columns if c != text_col]
    # The text itself travels only where it differs from its normalised form.
    flat = docs.select(*[F.col(f"`{c}`") for c in rest], norm.alias(n_), F.when(~norm.eqNullSafe(F.col(text_col)), F.col(text_col)).alias(own_), _tie(docs).alias(tie_))
    kept_schema = T.StructType([f for f in flat.schema.fields if f.name != tie_])
    schema = T.StructType([*flat.schema.fields, T.StructField(part_, T.IntegerType())])

    def ranged(batches):
        """Adds each row's range, and drops the rows of a batch that another of that batch beats: hot texts shrink before the shuffle."""
        bounds = cuts.value
        for batch in batches:
            hashes = batch.column(hash_)
            texts, batch = batch.column(n_), batch.drop_columns([hash_])
            order = pc.sort_indices(pa.table([batch.column(id_col), batch.column(tie_)], names=["id", "tie"]), sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_end").to_numpy()
            codes = texts.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            best = pa.array(np.sort(order[np.unique(codes[order], return_index=True)[1]]))
            head = pc.utf8_slice_codeunits(texts.take(best), 0, SAMPLE_CHARS).to_pylist()
            where = [0 if s is None else bisect_right(bounds, (s, h)) for s, h in zip(head, hashes.take(best).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.take(best).columns, pa.array(where, pa.int32())], names=[*batch.schema.names, part_])

    def first_of_each(batches):
        """Sorted rows in; those out that differ from the row before, which may be in the batch before."""
        last, begun = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column(n_)
            before = pa.concat_arrays([pa.array([last if begun else None], texts.type), texts[:-1]])
            same = pc.or_(pc.fill_null(pc.equal(texts, before), False), pc.and_(pc.is_null(texts), pc.is_null(before)))
            keep = ~same.to_numpy(zero_copy_only=False)
            keep[0] |= not begun
            last, begun = texts[-1].as_py(), True
            yield batch.filter(pa.array(keep)).drop_columns([tie_, part_])

    sorted_ = (
        mapped(flat.withColumn(hash_, F.xxhash64(n_)), ranged, schema)
        .repartitionById(ranges, F.col(part_))
        .sortWithinPartitions(F.col(n_).asc_nulls_first(), F.col(f"`{id_col}`").asc_nulls_last(), F.col(tie_))
    )
    out = mapped(sorted_, first_of_each, kept_schema)
    return out.select(*[F.coalesce(own_, n_).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
