"""Queries of the vector store over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.base import Plan, table
from heddle.session import shared_dir
from heddle.sources import vector_sink as V

#: Neighbours of a query, and the share of the true ones that the cells it searches are to hold.
K, RECALL = 10, 0.97


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return V.sound(table(spark, d, "embeddings"), "vec_id", "embedding")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each vector but itself: a load of all of them, then a search for all."""
    rows = _rows(spark, d)
    sink = V.new_index(spark, shared_dir(spark), rows)
    sink.flush(0, rows.select(F.col("id").alias("record"), F.lit(0).alias("chunk"), "vector"))
    asked = rows.select(F.col("id").alias("query"), "vector")
    near = V.neighbours(sink, asked, K + 1, V.probes_for(sink, asked, K + 1, RECALL)).where("record <> query")
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", F.col("record").cast("long").alias("record")))), 1, K).alias("n"))
    return best.select(F.col("query").cast("long").alias("vec_id"), F.posexplode("n").alias("rank", "n")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.record").alias("neighbour"), F.round("n.distance", 6).alias("distance"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Each vector is a record; later every third is deleted, every fourth comes again in two chunks, with states between."""
    r = _rows(spark, d).select(F.col("id").cast("long"), "vector")
    none, half = F.lit(None).cast("array<float>"), F.transform("vector", lambda x: x / 2)

    def message(rows, at, kind, chunk, vector):
        return rows.select(at.alias("at"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("record"), F.lit(chunk).cast("long").alias("chunk"), vector.alias("vector"))

    one = F.lit(1_000_000_000)
    out = message(r, F.col("id"), "RECORD", 0, F.col("vector")).unionByName(message(r.where("id % 3 = 0"), one + F.col("id"), "DELETE", None, none))
    again = r.where("id % 4 = 0")
    out = out.unionByName(message(again, one * 2 + F.col("id") * 2, "RECORD", 0, half)).unionByName(message(again, one * 2 + F.col("id") * 2 + 1, "RECORD", 1, F.col("vector")))
    states = spark.range(1, 3).select(F.lit(None).cast("long").alias("id"), (F.col("id") * one - 1).alias("at"))
    return out.unionByName(states.select("at", F.lit("STATE").alias("kind"), F.lit(None).cast("string").alias("record"), F.lit(None).cast("long").alias("chunk"), none.alias("vector")))


def _sink(spark: SparkSession, d: str) -> DataFrame:
    """What is live after a load with deletions and re-insertions, compacted once."""
    rows = _rows(spark, d)
    sink = V.new_index(spark, shared_dir(spark), rows)
    V.load(sink, _messages(spark, d), 1 << 30)
    sink.compact()
    return sink.live().select(F.col("record").cast("long").alias("vec_id"), "chunk", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


SINK_SQL = """
WITH v AS (SELECT vec_id, embedding[1] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
SELECT vec_id, 0::BIGINT AS chunk, round((CASE WHEN vec_id % 4 = 0 THEN e / 2 ELSE e END)::DOUBLE, 6) AS first FROM v WHERE vec_id % 4 = 0 OR vec_id % 3 <> 0
UNION ALL SELECT vec_id, 1, round(e::DOUBLE, 6) FROM v WHERE vec_id % 4 = 0
"""

PLANS = {"vector_neighbours": Plan(_neighbours), "vector_sink": Plan(_sink, SINK_SQL)}
