"""Queries of keyed stream state over the events, each fed in several runs with restarts between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.base import Plan, table
from heddle.session import shared_dir
from heddle.streaming import stateful as S

EVENTS = "user_id long, ts timestamp, event_id long"
#: Events come in up to this much out of order: more than all of them span, as ids of one half come before those of the other.
LATE = "60 days"
#: Rows of a checkpoint, its seconds at most, and seconds of silence that end a run.
ROWS, SECONDS, IDLE = 5, 86_400, 172_800
#: Rows that may run within so many seconds.
MOST, WINDOW = 3, 172_800


def fed(spark: SparkSession, d: str, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over all events puts out: the even ids first, then the query is started again for the odd ones. A row
    without a user, far ahead in time, ends the stream: the watermark passes all others."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select(F.col("user_id").cast("long"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long"))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit(-1).cast("long").alias("event_id"))
    for i, part in enumerate((rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0").unionByName(end.where("ts IS NOT NULL")))):
        part.write.parquet(f"{at}/in/{i}")
        source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        S.run_stateful(stream(source), f"{at}/out", f"{at}/state")
    return S.batches(stream(source), f"{at}/out")


def _checkpoints(spark, d):
    out = fed(spark, d, lambda s: S.checkpoint_stream(s, "user_id", "ts", "event_id", LATE, ROWS, SECONDS, IDLE))
    return out.where("user_id IS NOT NULL")


def _rate(spark, d):
    out = fed(spark, d, lambda s: S.limited_stream(s, "user_id", "ts", "event_id", LATE, MOST, WINDOW))
    return out.where("user_id IS NOT NULL").select("user_id", F.col("id").alias("event_id"), "running", "allowed")


def _intervals(spark, d):
    """Each event completes the hour it lies in; hours that touch are one interval."""
    hour = (F.floor(F.unix_micros("ts") / 3_600_000_000) * 3600).alias("start")
    out = fed(spark, d, lambda s: S.interval_stream(s.select("user_id", hour).withColumn("end", F.col("start") + 3599), "user_id", "start", "end", 1))
    last = out.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by("spans", "version").alias("spans"))
    return last.select("user_id", F.explode("spans").alias("s")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


CHECKPOINTS_SQL = f"""
WITH RECURSIVE e AS (
    SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), r AS (
    SELECT user_id, i, us, 1::BIGINT AS records, us AS since, 0::BIGINT AS number, NULL::BIGINT AS c_records, NULL::BIGINT AS c_cursor, NULL::BOOLEAN AS c_final FROM e WHERE i = 1
    UNION ALL
    SELECT e.user_id, e.i, e.us,
        CASE WHEN e.us - r.us > {IDLE}000000 OR r.records >= {ROWS} OR e.us - r.since > {SECONDS}000000 THEN 1 ELSE r.records + 1 END,
        CASE WHEN e.us - r.us > {IDLE}000000 OR r.records >= {ROWS} OR e.us - r.since > {SECONDS}000000 THEN e.us ELSE r.since END,
        r.number + CASE WHEN e.us - r.us > {IDLE}000000 OR r.records >= {ROWS} OR e.us - r.since > {SECONDS}000000 THEN 1 ELSE 0 END,
        CASE WHEN e.us - r.us > {IDLE}000000 OR r.records >= {ROWS} OR e.us - r.since > {SECONDS}000000 THEN r.records END,
        CASE WHEN e.us - r.us > {IDLE}000000 OR r.records >= {ROWS} OR e.us - r.since > {SECONDS}000000 THEN r.us END,
        e.us - r.us > {IDLE}000000
    FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1
)
SELECT user_id, number, c_records AS records, c_cursor AS cursor, c_final AS final FROM r WHERE c_records IS NOT NULL
UNION ALL
SELECT user_id, number + 1, records, us, true FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1
"""

RATE_SQL = f"""
WITH RECURSIVE e AS (
    SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), r AS (
    SELECT user_id, event_id, i, 0::BIGINT AS running, true AS allowed, [us] AS ran FROM e WHERE i = 1
    UNION ALL
    SELECT user_id, event_id, i, len(kept), len(kept) < {MOST}, CASE WHEN len(kept) < {MOST} THEN list_append(kept, us) ELSE kept END
    FROM (SELECT e.user_id, e.event_id, e.i, e.us, list_filter(r.ran, lambda t: t > e.us - {WINDOW}000000) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
)
SELECT user_id, event_id, running, allowed FROM r
"""

INTERVALS_SQL = """
WITH h AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS h FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
i AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS island FROM h)
SELECT user_id, min(h) * 3600 AS start, max(h) * 3600 + 3599 AS "end" FROM i GROUP BY user_id, island
"""

PLANS = {
    "stream_checkpoints": Plan(_checkpoints, CHECKPOINTS_SQL),
    "stream_rate": Plan(_rate, RATE_SQL),
    "stream_intervals": Plan(_intervals, INTERVALS_SQL),
}
