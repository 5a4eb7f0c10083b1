"""Structured streams: maps, change capture, checkpoints, rates, event windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heddle.operators.history import upserted


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A topic as (key, value, ts), where the session has the Kafka package; ``starting`` may be offsets for a replay."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"))


def enriched(stream: DataFrame, value: str = "value", mark: str = "|risk-evaluated") -> DataFrame:
    """A stateless map: every value with a mark."""
    return stream.withColumn(value, F.concat(F.col(value), F.lit(mark)))


def run_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write all that is there now and end; a restart goes on where the checkpoint stands."""
    stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call ``do`` for each micro-batch: until the source has no more, or every so often."""
    writer = stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def apply_changes(target: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str], deleted: str) -> DataFrame:
    """A table after a batch of changes: the newest change of each key counts, deletes take the key out."""
    newest = batch.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), F.struct(*order)).alias("_r")).select("_r.*")
    return upserted(target, newest, key).where(F.col(deleted).isNull())


def once_each(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Rows without repeats of their keys, for as long as they may come late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, by: Sequence[str | Column] = (), slide: str | None = None) -> DataFrame:
    """Counts per window of event time."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in counted.columns if c != "w"])
