"""Queries of tables that are kept: generations, and change streams that are applied once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.plans.base import Plan, table
from heddle.session import shared_dir
from heddle.sources.generations import GenerationTable
from heddle.streaming.changes import ChangeTable
from heddle.streaming.streams import each_batch

ORDERS = "o_orderkey long, o_totalprice double, generation int"


def _generations(spark, d):
    """Two generations of all orders: the second is published, read, and rolled back. Totals of each reading."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long"), "o_totalprice")
    kept = GenerationTable(spark, f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}", ORDERS)
    first, second = o.withColumn("generation", F.lit(1)), o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("generation", F.lit(2))
    kept.refresh([first.where("o_orderkey % 3 = 0"), first.where("o_orderkey % 3 <> 0")], 1)
    # A second refresh is broken off after a batch: readers still have the first.
    kept.write(second.where("o_orderkey % 4 = 0"), 2, 0)
    readings = [("broken off", kept.read())]
    kept.refresh([second.where("o_orderkey % 4 = 0"), second.where("o_orderkey % 4 <> 0")], 2)
    readings.append(("published", kept.read()))
    kept.rollback()
    readings.append(("rolled back", kept.read()))
    readings.append(("snapshot", kept.read(1)))
    out = None
    for name, rows in readings:
        one = rows.groupBy("generation").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total")).withColumn("reading", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


CHANGES = T.StructType().add("user_id", "long").add("event_id", "long").add("ts", "timestamp").add("event_type", "string").add("value", "double").add("gone", "boolean")


def _changes(spark, d):
    """Events as changes of their users, streamed in three runs, one of them twice; an error takes the user out."""
    at = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    e = table(spark, d, "events").where("user_id IS NOT NULL")
    e = e.select("user_id", "event_id", F.col("ts").cast("timestamp"), "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    kept = ChangeTable(spark, f"{at}/table", CHANGES, ["user_id"], ["ts", "event_id"], "gone", buckets=8)
    for run in (1, 0, 2):
        e.where(F.col("event_id") % 3 == run).write.parquet(f"{at}/in/{run}")
        stream = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        each_batch(stream, kept.batch, f"{at}/state").awaitTermination()
    kept.apply(e.where("event_id % 3 = 2"), 2)
    return kept.read().select("user_id", "event_id", "event_type", "value")


GENERATIONS_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_totalprice::DECIMAL(18, 2) AS p FROM orders),
a AS (SELECT 1 AS generation, count(*) AS orders, sum(p)::DOUBLE AS total FROM o),
b AS (SELECT 2 AS generation, count(*) AS orders, sum(p + 1)::DOUBLE AS total FROM o WHERE k % 2 = 0)
SELECT *, 'broken off' AS reading FROM a UNION ALL SELECT *, 'published' FROM b UNION ALL SELECT *, 'rolled back' FROM a UNION ALL SELECT *, 'snapshot' FROM b
"""
CHANGES_SQL = """
SELECT user_id, event_id, event_type, value FROM (SELECT * FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type <> 'error'
"""

PLANS = {"generations": Plan(_generations, GENERATIONS_SQL), "change_table": Plan(_changes, CHANGES_SQL)}
