"""Queries of nested records and of the schema of JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import schemas as S
from heddle.operators import nested as N
from heddle.plans.base import Plan, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A nested record for each line of an order."""
    rows = table(spark, d, "lineitem")
    part = lambda name, kind: F.struct(F.col(name).cast("long").alias("id"), F.lit(kind).alias("kind"))
    rec = F.struct(
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("li'ne")).alias("ids"), F.array("l_returnflag", "l_linestatus").alias("tags"),
        F.array(part("l_partkey", "p"), part("l_suppkey", "s")).alias("parts"), F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("it's"), F.col("l_linestatus")).alias("attrs"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("quantity"), rec.alias("rec"))


def _json(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.to_json("rec", {"ignoreNullFields": "false"}).alias("rec"))


def _added(spark, d):
    line = F.col("l_linenumber")
    return _json(N.set_fields(_records(spark, d), [
        (["rec", "ids", "source", "name"], F.concat(F.lit("line-"), line)), (["rec", "tags", 3], F.lit("late")), (["rec", "parts", 1, "rank"], line),
        (["rec", "attrs", "qty"], F.col("quantity")), (["rec", "made", 1], F.col("l_returnflag")), (["rec", "parts", "*", "kind"], F.lit("k")),
    ]))


def _removed(spark, d):
    out = N.remove_fields(_records(spark, d), [["rec", "ids", "li'ne"], ["rec", "tags", 0], ["rec", "parts", 0, "kind"], ["rec", "not", "there"], ["rec", "tags", 9]])
    return _json(N.remove_fields(out, [["rec", "attrs", "*"], ["rec", "parts", "*", "id"]], lambda v: v.cast("string").isin("F", "N", "7")))


def _sanitised(spark, d):
    return _json(N.sanitised(_records(spark, d)))


ADDED_SQL = """
SELECT l_orderkey, l_linenumber, to_json({
    'ids': {'order': l_orderkey, 'li''ne': l_linenumber, 'source': {'name': 'line-' || l_linenumber}}, 'tags': [l_returnflag, l_linestatus, NULL, 'late'],
    'parts': [{'id': l_partkey, 'kind': 'k', 'rank': NULL::INTEGER}, {'id': l_suppkey, 'kind': 'k', 'rank': l_linenumber}],
    'attrs': MAP {'flag': l_returnflag, 'it''s': l_linestatus, 'qty': floor(l_quantity)::INTEGER::VARCHAR}, 'made': [NULL, l_returnflag]})::VARCHAR AS rec
FROM lineitem
"""

REMOVED_SQL = """
SELECT l_orderkey, l_linenumber, to_json({
    'ids': {'order': l_orderkey}, 'tags': [NULL, l_linestatus],
    'parts': [{'id': CASE WHEN l_partkey <> 7 THEN l_partkey END, 'kind': NULL::VARCHAR}, {'id': CASE WHEN l_suppkey <> 7 THEN l_suppkey END, 'kind': 's'}],
    'attrs': map_from_entries(list_filter([{'k': 'flag', 'v': l_returnflag}, {'k': 'it''s', 'v': l_linestatus}], lambda e: e.v NOT IN ('F', 'N', '7')))})::VARCHAR AS rec
FROM lineitem
"""

SANITISED_SQL = """
SELECT l_orderkey, l_linenumber, to_json({
    'ids': {'order': l_orderkey, 'li''ne': l_linenumber, 'li_ne': l_linenumber}, 'tags': [l_returnflag, l_linestatus],
    'parts': [{'id': l_partkey, 'kind': 'p'}, {'id': l_suppkey, 'kind': 's'}],
    'attrs': MAP {'flag': l_returnflag, 'it''s': l_linestatus, 'it_s': l_linestatus}})::VARCHAR AS rec
FROM lineitem
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """JSON texts of several shapes: properties of events, and orders, some of them with other types in the same places."""
    o = table(spark, d, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    plain = F.concat(F.lit('{"id":'), key, F.lit(',"info":{"status":"'), status, F.lit('","open":'), (status == "O").cast("string"), F.lit('},"tags":["a",'), key, F.lit("]}"))
    other = F.concat(F.lit('{"id":"'), key, F.lit('","info":null,"tags":[{"deep":[[1],[null]]}],"none":null}'))
    text = F.when(F.col("o_orderkey") % 5 == 0, other).when(F.col("o_orderkey") % 7 == 0, F.lit("not json")).otherwise(plain)
    return o.select(text.alias("j")).unionByName(table(spark, d, "events").select(F.col("props").alias("j")))


def _fold(spark, d):
    paths = S.type_bits(_texts(spark, d), "j")
    step = lambda x: F.when(x == S.ELEMENTS, x).otherwise(F.concat(F.lit("."), x))
    return paths.select(F.concat(F.lit("$"), F.array_join(F.transform("path", step), "")).alias("path"), F.array_join(S.types_of(F.col("bits")), ",").alias("types"))


FOLD_SQL = """
WITH texts AS (
    SELECT CASE WHEN o_orderkey % 5 = 0 THEN '{"id":"' || o_orderkey || '","info":null,"tags":[{"deep":[[1],[null]]}],"none":null}'
        WHEN o_orderkey % 7 = 0 THEN 'not json'
        ELSE '{"id":' || o_orderkey || ',"info":{"status":"' || o_orderstatus || '","open":' || (o_orderstatus = 'O')::VARCHAR || '},"tags":["a",' || o_orderkey || ']}' END AS j
    FROM orders UNION ALL SELECT props FROM events
), tree AS (
    SELECT regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS path,
        CASE WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN t.type = 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS type
    FROM (SELECT j FROM texts WHERE json_valid(j)) x, json_tree(x.j) t
)
SELECT path, string_agg(type, ',' ORDER BY list_position(['null', 'boolean', 'number', 'string', 'array', 'object'], type)) AS types
FROM (SELECT DISTINCT path, type FROM tree) GROUP BY path
"""

PLANS = {
    "nested_add_fields": Plan(_added, ADDED_SQL),
    "nested_remove_fields": Plan(_removed, REMOVED_SQL),
    "nested_sanitised_keys": Plan(_sanitised, SANITISED_SQL),
    "schema_fold": Plan(_fold, FOLD_SQL),
}
