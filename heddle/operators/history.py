"""Type-2 history, deduplication, change data capture, incremental loads and merges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.values import surrogate_key


@dataclass(frozen=True)
class StreamConfig:
    """A stream: its key, its cursor, what breaks ties, and the columns that tell deletes."""

    key: tuple[str, ...]
    cursor: str
    emitted: str
    tie: tuple[str, ...] = ()
    deleted: str | None = None
    extra_order: tuple[str, ...] = ()
    text_keys: tuple[str, ...] = field(default=())


def _order(config: StreamConfig) -> list[Column]:
    newest = [F.col(c).desc_nulls_last() for c in (config.cursor, *config.extra_order)]
    return [*newest, F.col(config.emitted).desc(), *[F.col(t).desc() for t in config.tie]]


def _keys(config: StreamConfig) -> list[Column]:
    """Float keys are compared as text."""
    return [F.col(k).cast("string") if k in config.text_keys else F.col(k) for k in config.key]


def scd2(df: DataFrame, config: StreamConfig) -> DataFrame:
    """``df`` with unique_key, start_at, end_at and active_row: a version ends where the next newer one begins, the
    newest is active unless it is a delete. One shuffle by key."""
    newest = Window.partitionBy(*_keys(config)).orderBy(*_order(config))
    active = F.row_number().over(newest) == 1
    if config.deleted:
        active = active & F.col(config.deleted).isNull()
    return df.select(
        "*", surrogate_key(_keys(config)).alias("unique_key"), F.col(config.cursor).alias("start_at"),
        F.lag(config.cursor).over(newest).alias("end_at"), active.cast("int").alias("active_row"),
    )


def deduplicated(history: DataFrame, config: StreamConfig, also: Sequence[str] = ()) -> DataFrame:
    """One row per key, start and emission (and, as text, ``also``): active ones first, then by what breaks ties."""
    same = Window.partitionBy("unique_key", "start_at", config.emitted, *[F.col(c).cast("string") for c in also])
    rank = F.row_number().over(same.orderBy(F.col("active_row").desc(), *[F.col(t) for t in config.tie]))
    return history.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def active_rows(history: DataFrame) -> DataFrame:
    return history.where("active_row = 1")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def newer_than(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Rows above the highest cursor of ``target``; all of them if it is empty, and rows without a cursor. The maximum
    is one row, so its broadcast has a fixed size."""
    top = target.agg(F.max(target_column).alias("_top"))
    return df.join(F.broadcast(top)).where(F.coalesce(F.col(column) > F.col("_top"), F.lit(True))).drop("_top")


def newer_than_literal(df: DataFrame, column: str, top) -> DataFrame:
    """The same with a value known beforehand, which files can be pruned by."""
    return df if top is None else df.where(F.coalesce(F.col(column) > F.lit(top), F.lit(True)))


def last_batch(df: DataFrame, column: str) -> DataFrame:
    """Rows of the highest emission."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top")).drop("_top")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``. Columns that one side lacks are null."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def without_keys(target: DataFrame, dead: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(dead.select(*key).distinct(), list(key), "left_anti")


def inactive_keys(history: DataFrame, recent: DataFrame) -> DataFrame:
    """Recent keys without an active version."""
    live = history.where("active_row = 1").select("unique_key")
    return recent.select("unique_key").distinct().join(live, "unique_key", "left_anti")


def incremental_scd2(history: DataFrame, new: DataFrame, config: StreamConfig) -> DataFrame:
    """History after a load: versions of touched keys are rebuilt from their active row and the new rows, closed
    versions and other keys stay as they are."""
    names = [c for c in new.columns]
    touched = new.select(surrogate_key(_keys(config)).alias("unique_key")).distinct()
    previous = history.where("active_row = 1").join(touched, "unique_key", "left_semi").select(*names)
    rebuilt = deduplicated(scd2(previous.unionByName(new), config), config)
    live = F.col("active_row") == 1
    rest = history.where(~live).unionByName(history.where(live).join(touched, "unique_key", "left_anti"))
    return rest.unionByName(rebuilt)


def type_and_dedupe(final: DataFrame, raw: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Final table after the raw rows that are not loaded yet: newest row of each key."""
    return latest(final.unionByName(raw, allowMissingColumns=True), key, order)


def cdc_envelope(df: DataFrame, before: str, after: str, op: str, ts: str, position: str | None = None, names: Sequence[str] = ("updated_at", "deleted_at", "log_position")) -> DataFrame:
    """Change events as rows: the row after the change, or before it for a delete, with its update and delete times and,
    where there is one, its position in the log. ``names`` are those of the added columns."""
    row, at = F.coalesce(F.col(after), F.col(before)), F.col(ts)
    log = [F.col(position).alias(names[2])] if position else []
    return df.select(row.alias("row"), at.alias(names[0]), F.when(F.col(op) == "d", at).alias(names[1]), *log)


def soft_reset(raw: DataFrame, loaded_at: str) -> DataFrame:
    """All raw rows count as not loaded again."""
    return raw.withColumn(loaded_at, F.lit(None).cast("timestamp"))
