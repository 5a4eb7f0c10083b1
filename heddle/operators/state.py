"""Cursor and partition state: interval merges, running maxima, checkpoints, file history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import cut


def merged_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, gap: Column | None = None) -> DataFrame:
    """Intervals of each group merged where one starts at or before the end of those before it, plus ``gap``."""
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = before + gap if gap is not None else before
    fresh = F.when(before.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_new", fresh).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def running_cursor(df: DataFrame, by: Sequence[str], order: Sequence[str], cursor: str) -> DataFrame:
    """``df`` with the highest cursor so far and whether a row comes out of order."""
    seen = Window.partitionBy(*by).orderBy(*order)
    before = F.max(cursor).over(seen.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("max_cursor", F.greatest(F.coalesce(before, F.col(cursor)), F.col(cursor))).withColumn("out_of_order", F.coalesce(F.col(cursor) < before, F.lit(False)))


def checkpoints(df: DataFrame, by: Sequence[str], order: Sequence[str], every: int) -> DataFrame:
    """``df`` with its place in its group and the number of its checkpoint: a new one after ``every`` rows.

    A group may hold most rows, so it is dealt out by ranges of the order; places come from the counts of the ranges before,
    one row for each group and range. ``order`` has to be unique within a group.
    """
    names = [*by, *order]
    # The ranges are drawn from a sample: a checkpoint keeps the counts and the rows of one and the same draw.
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("_p", F.spark_partition_id()).withColumn("_i", low))
    group = F.struct(*[F.col(c) for c in by])
    counts = ranged.groupBy("_p", group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_p", "_g", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    placed = ranged.withColumn("_g", group).alias("r").join(starts.alias("s"), (F.col("r._p") == F.col("s._p")) & F.col("r._g").eqNullSafe(F.col("s._g")))
    place = (F.col("_i") + F.col("_shift")).cast("long")
    return placed.select(*[F.col(f"r.`{c}`") for c in df.columns], place.alias("place"), F.floor((place - 1) / every).cast("long").alias("checkpoint"))


def rate(df: DataFrame, by: Sequence[str], seconds_column: str, window: int = 3600, name: str = "in_window") -> DataFrame:
    """``df`` with the number of rows of its group in the last ``window`` seconds, itself included."""
    last = Window.partitionBy(*by).orderBy(seconds_column).rangeBetween(-window, 0)
    return df.withColumn(name, F.count(F.lit(1)).over(last))


def files_to_sync(listing: DataFrame, history: DataFrame, full: bool, window_start) -> DataFrame:
    """Files to read: new ones, changed ones; with a full history only those at or after its start, and at its start
    only those whose name comes after the boundary's."""
    seen = history.select(F.col("uri"), F.col("last_modified").alias("_seen"))
    edge = history.agg(F.min(F.struct("last_modified", "uri")).alias("_edge"))
    joined = listing.join(seen, "uri", "left").join(F.broadcast(edge))
    changed = F.col("_seen").isNotNull() & (F.col("last_modified") > F.col("_seen"))
    fresh = F.col("_seen").isNull()
    if full:
        at_edge = (F.col("last_modified") == F.col("_edge.last_modified")) & (F.col("uri") > F.col("_edge.uri"))
        fresh = fresh & ((F.col("last_modified") > F.lit(window_start)) | at_edge)
    return joined.where(changed | fresh).drop("_seen", "_edge")


def file_cursor(history: DataFrame) -> DataFrame:
    """One row: the latest file by time and name."""
    top = history.agg(F.max(F.struct("last_modified", "uri")).alias("c"))
    return top.select("c.last_modified", "c.uri")


def window_start(history: DataFrame, now: Column, days: int, full: bool) -> DataFrame:
    """One row: the earliest time of the history; with a full one not later than ``days`` before now."""
    low = F.min("last_modified")
    return history.agg((F.least(low, now - F.make_dt_interval(F.lit(days))) if full else low).alias("window_start"))
