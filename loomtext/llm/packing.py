"""Packing documents into fixed-length sequences, shortest pack first over the histogram of lengths.

Only the histogram, of at most ``capacity`` counts, reaches the driver. There each length, longest first, goes to the
open packing pattern with the most room, whole counts at a time. Documents then find their pattern by their rank among
those of their length; ranks come from sorted buckets and running counts, so no length is ranked by one task.
"""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomtext.llm.storage import written

CAPACITY = 2048
#: Slot tables up to so many rows are broadcast. At most ``2 * capacity`` patterns come of as many lengths, and a pattern has
#: at most ``sqrt(2 * capacity)`` distinct ones: for packs of 2048 that is 262,144 rows, however many documents there are.
BROADCAST_SLOTS = 500_000
#: Larger tables are joined by length and block of so many ranks, so that no length meets in one task.
RANK_BLOCK = 1 << 18


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)``: packs of equal content, by shortest-pack-first, in order of completion."""
    room: list[tuple[int, int]] = []  # a heap by most room; the second names the pattern
    open_: dict[int, list] = {}
    made = 0

    def push(count, lengths, left):
        nonlocal made
        open_[made] = [count, lengths, left]
        heapq.heappush(room, (-left, made))
        made += 1

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while todo:
            if not room or -room[0][0] < length:
                # A new pack has the most room until it can't take another of this length.
                many = min(todo, capacity // length)
                push(todo // many, (length,) * many, capacity - many * length)
                todo %= many
                continue
            _, at = heapq.heappop(room)
            count, lengths, left = open_.pop(at)
            used = min(count, todo)
            if count > used:
                push(count - used, lengths, left)
            push(used, (*lengths, length), left - length)
            todo -= used
    return [(count, lengths) for count, lengths, _ in open_.values()]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, first pack, offset, times)``: where the documents of each length go, by rank.

    A length that a pattern holds ``times`` takes consecutive ranks, ``times`` to a pack.
    """
    ranks: Counter[int] = Counter()
    out, pack = [], 0
    for count, lengths in found:
        offset = 0
        for length, run in groupby(lengths):
            times = len(list(run))
            out.append((length, ranks[length], ranks[length] + count * times, pack, offset, times))
            ranks[length] += count * times
            offset += length * times
        pack += count
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length=None) -> DataFrame:
    """``id_col, piece, begin, length, pack_id, pack_offset``: one row for each piece of each document.

    ``length`` is a Column, by default the number of white-space separated words; with one, ``text_col`` is not read. A document longer than ``capacity``
    is cut: full pieces, then the rest; ``begin`` is where a piece begins in its document. A pack's pieces lie one
    after another without overlap and never exceed ``capacity``. A null, empty or blank text has one row of length 0
    and no pack. Repeated rows are packed each; a null id is kept. Ties between equal lengths are broken by hash, id
    and piece; which of two equal rows comes first doesn't matter. Other columns are not read.
    """
    spark = docs.sparkSession
    if length is None:
        bare = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
        length = F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.translate(bare, " ", "")) + 1)
    sized = docs.select(F.col(id_col).alias("id"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    pieces = sized.select("id", "size", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "id", "piece", (F.col("piece").cast("bigint") * capacity).alias("begin"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("length")
    )
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int")), "pieces")
    whole = pieces.where("length > 0")
    counts = written(whole.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(patterns(histogram, capacity))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece"))
    ranked = whole.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "first", "end", "pack", "offset", "times")])
    where = spark.createDataFrame(rows, schema)
    # An inner join on the length, then the rank's interval: exactly one slot is left of each row's.
    if len(rows) <= BROADCAST_SLOTS:
        met = ranked.join(F.broadcast(where), "length")
    else:
        block = lambda x: F.floor(x / RANK_BLOCK)
        met = ranked.withColumn("block", block(F.col("rank"))).join(where.select("*", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1))).alias("block")), ["length", "block"])
    placed = met.where("rank >= first AND rank < end")
    nth = F.col("rank") - F.col("first")
    pack = F.col("pack") + F.floor(nth / F.col("times")).cast("bigint")
    out = placed.select("id", "piece", "begin", "length", pack.alias("pack_id"), (F.col("offset") + F.col("length") * (nth % F.col("times"))).alias("pack_offset"))
    none = F.lit(None).cast("bigint")
    out = out.unionByName(pieces.where("length = 0").select("id", "piece", "begin", "length", none.alias("pack_id"), none.alias("pack_offset")))
    return out.withColumnRenamed("id", id_col)
