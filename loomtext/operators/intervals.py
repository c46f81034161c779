"""Intervals, runs and running budgets, as window plans: one sort per group, never a square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _so_far(group: list[str], *order):
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def merged(df: DataFrame, group: list[str], start: str = "start", end: str = "end", sums: tuple[str, ...] = (), widest: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Intervals that overlap or touch become one. ``sums`` are added up; ``widest`` columns come from the widest interval, the earlier of equals."""
    by = [F.col(start), F.col(end), *([F.col(order)] if order else [])]
    reach = F.max(end).over(_so_far(group, *by))
    marked = df.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    w = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    islands = marked.withColumn("__island", F.sum("__new").over(w)).withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
    rank = F.struct((F.col(end) - F.col(start)).alias("w"), (-F.col("__at")).alias("a"))
    out = islands.groupBy(*group, "__island").agg(
        F.min(start).alias(start), F.max(end).alias(end), *[F.sum(c).alias(c) for c in sums], *[F.max_by(c, rank).alias(c) for c in widest], F.count(F.lit(1)).alias("parts")
    )
    return out.drop("__island")


def inverted(df: DataFrame, lengths: DataFrame, group: list[str], start: str = "start", end: str = "end", length: str = "length") -> DataFrame:
    """What the intervals leave of ``[0, length)``; a group of ``lengths`` without intervals is left whole."""
    kept = merged(df, group, start, end).select(*group, start, end)
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*group).orderBy(start)), F.lit(0).cast("bigint"))
    gaps = kept.select(*group, before.alias("__a"), F.col(start).alias("__b"))
    tail = lengths.join(kept.groupBy(*group).agg(F.max(end).alias("__m")), group, "left").select(*group, F.coalesce("__m", F.lit(0).cast("bigint")).alias("__a"), F.col(length).cast("bigint").alias("__b"))
    return gaps.unionByName(tail).where("__a < __b").withColumnsRenamed({"__a": start, "__b": end})


def outermost(df: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Without the intervals that lie in a different one; equal intervals all stay."""
    w = Window.partitionBy(*group).orderBy(F.col(start), F.col(end).desc())
    every = df.withColumn("__reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__rank", F.rank().over(w))
    # Equal intervals follow each other and share a rank; the reach before the first of them counts for all.
    first = F.first("__reach").over(Window.partitionBy(*group, "__rank").orderBy(F.col("__reach").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.withColumn("__before", first).where(F.col("__before").isNull() | (F.col("__before") < F.col(end))).drop("__reach", "__rank", "__before")


def nested(df: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The intervals that lie in some other one; of two equal ones each lies in the other."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group, start, end))
    flat = Window.partitionBy(*group).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__n", n).withColumn("__reach", F.max(end).over(flat)).where((F.col("__n") > 1) | (F.col("__reach") >= F.col(end))).drop("__n", "__reach")


def runs(df: DataFrame, group: list[str], order: list[str], key: list[str], breaks: Column | None = None, run_col: str = "run") -> DataFrame:
    """Numbers the runs of consecutive rows with equal ``key``; ``breaks`` forces a new run."""
    w = Window.partitionBy(*group).orderBy(*order)
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    new = ~same | (F.row_number().over(w) == 1)
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    return df.withColumn("__new", new.cast("int")).withColumn(run_col, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def budget_prefix(df: DataFrame, group: list[str], order: list[str], cost: str, budget: Column | int, min_keep: int = 0, keep_col: str = "kept") -> DataFrame:
    """Marks the leading rows whose running cost stays within the budget, up to the first that doesn't; the first ``min_keep`` stay anyway and count."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy(*group).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.sum(cost).over(frame) <= budget) | (F.row_number().over(w) <= min_keep)
    return df.withColumn("__fits", fits).withColumn(keep_col, F.min(F.col("__fits").cast("int")).over(frame) == 1).drop("__fits")


def skip_fit(group_costs: list[int], budget: int) -> list[bool]:
    """The first is kept, and then each that still fits, also after one that doesn't."""
    left, out = budget, []
    for i, cost in enumerate(group_costs):
        take = i == 0 or cost <= left
        left -= cost if take else 0
        out.append(take)
    return out


def ladder_step(costs: list[Column], limit: Column | int) -> Column:
    """The number of the first cost within the limit; the last number when none is."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    out = F.lit(len(costs) - 1)
    for i in range(len(costs) - 2, -1, -1):
        out = F.when(costs[i] <= limit, F.lit(i)).otherwise(out)
    return out


def as_of(df: DataFrame, group: list[str], order: list[str], value: Column, segment: Column | None = None) -> Column:
    """The last value that isn't null before the row, in its segment where one is given."""
    keys = [F.col(g) for g in group] + ([segment] if segment is not None else [])
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def in_any(points: DataFrame, ranges: DataFrame, group: list[str], at: str, start: str = "start", end: str = "end", flag: str = "inside") -> DataFrame:
    """Whether each point lies in one of the group's half-open ranges, by a sweep: openings less closings up to the point."""
    edges = ranges.select(*group, F.col(start).alias("__p"), F.lit(1).alias("__d")).unionAll(ranges.select(*group, F.col(end).alias("__p"), F.lit(-1).alias("__d")))
    both = points.withColumn("__p", F.col(at).cast("bigint")).withColumn("__d", F.lit(0)).withColumn("__own", F.lit(True))
    every = both.unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy(*group).orderBy("__p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn(flag, F.sum("__d").over(w) > 0).where("__own").drop("__p", "__d", "__own")


def within_band(left: DataFrame, right: DataFrame, group: list[str], reach: int = 10) -> DataFrame:
    """Pairs of an edit of ``left`` and one of ``right`` that begins in it or at most ``reach`` after its end."""
    a, b = left.alias("a"), right.alias("b")
    same = F.lit(True)
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    return a.join(b, same & (F.col("b.start") >= F.col("a.start")) & (F.col("b.start") <= F.col("a.end") + reach))
