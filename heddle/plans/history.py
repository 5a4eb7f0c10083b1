"""Queries of typed ingestion and history over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import values as V
from heddle.operators import history as H
from heddle.operators import normalize as N
from heddle.operators import quality as Q
from heddle.operators import records as R
from heddle.plans.base import Plan, table

ORDERS = H.StreamConfig(key=("o_custkey",), cursor="o_orderdate", emitted="o_orderdate", tie=("o_orderkey",))
CHANGES = H.StreamConfig(key=("user_id",), cursor="ts", emitted="ts", tie=("event_id",), deleted="deleted_at")

SCD2_SQL = """
SELECT o_orderkey, o_custkey, md5(coalesce(CAST(o_custkey AS VARCHAR), '')) AS unique_key, o_orderdate AS start_at,
       lag(o_orderdate) OVER w AS end_at, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS active_row
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC)
"""


def _scd2(spark, d):
    return H.scd2(table(spark, d, "orders"), ORDERS).select("o_orderkey", "o_custkey", "unique_key", "start_at", "end_at", "active_row")


def _dedup(spark, d):
    out = H.deduplicated(H.scd2(table(spark, d, "orders"), ORDERS), ORDERS)
    return out.select("o_orderkey", "unique_key", "start_at", "active_row")


def _active(spark, d):
    return H.active_rows(_scd2(spark, d)).select("o_custkey", "o_orderkey", "start_at")


def _changes(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts")))


def _cdc(spark, d):
    return H.active_rows(H.scd2(_changes(spark, d), CHANGES)).select("user_id", "event_id", "event_type")


def _cdc_dedup(spark, d):
    h = H.deduplicated(H.scd2(_changes(spark, d), CHANGES), CHANGES, also=("deleted_at",))
    return h.groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("active_row").alias("active"))


def _envelope(spark, d):
    e = table(spark, d, "events")
    row = F.struct("event_id", "user_id")
    delete = F.col("event_type") == "error"
    e = e.select(F.when(delete, row).alias("before"), F.when(~delete, row).alias("after"), F.when(delete, "d").otherwise("u").alias("op"), "ts", "event_id")
    return H.cdc_envelope(e, "before", "after", "op", "ts", "event_id").select("row.event_id", "row.user_id", "updated_at", "deleted_at", "log_position")


def _incremental(spark, d):
    o = table(spark, d, "orders")
    return H.newer_than(o, "o_orderdate", o.where("o_orderkey % 3 = 0 AND o_orderdate < DATE'2000-01-01'"), "o_orderdate").select("o_orderkey", "o_orderdate")


def _incremental_literal(spark, d):
    e = table(spark, d, "events")
    top = e.where("event_type = 'signup' AND ts < TIMESTAMP'2024-01-20'").agg(F.max("ts")).first()[0]
    return H.newer_than_literal(e, "ts", top).select("event_id", "ts")


def _last_batch(spark, d):
    return H.last_batch(table(spark, d, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate")


def _merge(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderdate < DATE'1999-01-01'").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return H.upserted(old, new, ["o_orderkey"])


def _two_runs(spark, d):
    o = table(spark, d, "orders")
    first, second = o.where("o_orderdate < DATE'1999-01-01'"), o.where("o_orderdate >= DATE'1999-01-01'")
    one = H.deduplicated(H.scd2(first, ORDERS), ORDERS)
    return H.active_rows(H.incremental_scd2(one, second, ORDERS)).select("o_custkey", "o_orderkey", "start_at")


def _delete_inactive(spark, d):
    h = H.scd2(_changes(spark, d), CHANGES)
    final = h.where("event_type = 'signup'").select("unique_key", "event_id")
    return H.without_keys(final, H.inactive_keys(h, h), ["unique_key"])


def _type_and_dedupe(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    final, raw = e.where("ts < TIMESTAMP'2024-01-15'"), e.where("ts >= TIMESTAMP'2024-01-15'")
    return H.type_and_dedupe(final, raw, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


def _extract_cast(spark, d):
    e = table(spark, d, "events")
    out = N.extracted(e, "props", ["k", "no such"], keep=["event_id"])
    return N.typed(out, {"properties": {"k": {"type": "integer"}, "no such": {"type": "string", "format": "date"}}}).select("event_id", "k", F.col("no such").alias("missing"))


def _unnest(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    j = items.select("l_orderkey", F.to_json("a").alias("items"))
    kind = T.StructType([T.StructField("l_linenumber", T.LongType()), T.StructField("l_partkey", T.LongType())])
    out = N.unnested(j, "items", kind, ["l_orderkey"])
    out = out.select("l_orderkey", F.col("item.l_linenumber").alias("line"), F.col("item.l_partkey").alias("part"))
    return N.with_row_hash(out, ["l_orderkey", "line", "part"], "hashid")


def _row_hash(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return N.with_row_hash(j.select("n_nationkey", "n_name", "r_name"), ["n_nationkey", "n_name", "r_name"], "hashid")


def _hash_dialects(spark, d):
    n = table(spark, d, "nation")
    return n.select(
        "n_nationkey", V.surrogate_key(["n_name", "n_regionkey"], "~").alias("tilde"), V.salted_hash("n_name", "sha256", "salt").alias("salted"),
        V.base64encode("n_name").alias("b64"), V.base64decode(V.base64encode("n_name")).alias("plain"),
    )


def _casts(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type", "value", "ts")
    return e.select(
        "event_id", V.safe_cast("k", "long").alias("as_long"), V.safe_cast("event_type", "double").alias("bad"),
        V.cast_to_boolean(F.when(F.col("event_type") == "view", "TRUE").otherwise("no"), text_rule=True).alias("flag"),
        V.empty_string_to_null(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))).alias("kind"),
        V.clamp("value", F.lit(2.0), F.lit(10.0)).alias("clamped"), V.format_datetime("ts", "%Y-%m-%d %H:%M").alias("minute"),
    )


def _lsn(spark, d):
    o = table(spark, d, "orders")
    text = F.concat_ws("/", F.hex("o_custkey"), F.hex("o_orderkey"))
    return o.select("o_orderkey", V.lsn_to_long(text).alias("lsn"), V.long_to_lsn(V.lsn_to_long(text)).alias("text"))


def _diff(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return Q.equality_metric(c.where("c_custkey % 7 <> 0"), c.where("c_custkey % 5 <> 0"))


def _star(spark, d):
    n = table(spark, d, "nation")
    newer = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.upper(F.concat("n_name", F.lit("x"))).alias("n_name"))
    return N.star_intersect(n, newer, ["n_nationkey"], exclude=["n_regionkey"])


def _row_counts(spark, d):
    e = table(spark, d, "events")
    return Q.row_counts({"events": (e, 1), "errors": (e.where("event_type = 'error'"), 2)})


def _duplicates(spark, d):
    return Q.duplicates(table(spark, d, "events"), ["user_id", "event_type"])


def _record_pipeline(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    out = R.filtered(e, "{{ record.p.k > config.low and record.event_type != 'error' }}", {"config": {"low": 50}})
    out = R.add_fields(out, {"p.twice": F.col("p.k") * 2, "stream": F.lit("events")})
    out = R.remove_fields(out, ["p.k", "nothing"])
    return out.select("event_id", F.col("p.twice").alias("twice"), "stream")


def _cursor_filter(spark, d):
    o = table(spark, d, "orders")
    return R.within_cursor(o, "o_orderkey", 100, 900, 250).select("o_orderkey")


def _dpath(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"data":{"items":['), F.col("props"), F.lit(","), F.col("props"), F.lit("]}}")).alias("body"))
    out = R.records_at(e, "body", ["data", "items"], T.StructType([T.StructField("k", T.LongType())]), ["event_id"])
    return out.select("event_id", "record.k")


def _conforming(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "x").otherwise(F.get_json_object("props", "$.k")).alias("k"))
    return R.conforming(e, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())]))


PLANS = {
    "scd2_orders": Plan(_scd2, SCD2_SQL),
    "scd2_dedup": Plan(_dedup, f"""
        SELECT o_orderkey, unique_key, start_at, active_row FROM (
          SELECT *, row_number() OVER (PARTITION BY unique_key, start_at ORDER BY active_row DESC, o_orderkey) AS r FROM ({SCD2_SQL}))
        WHERE r = 1"""),
    "scd2_active_final": Plan(_active, f"SELECT o_custkey, o_orderkey, start_at FROM ({SCD2_SQL}) WHERE active_row = 1"),
    "scd2_two_runs_final": Plan(_two_runs, f"SELECT o_custkey, o_orderkey, start_at FROM ({SCD2_SQL}) WHERE active_row = 1"),
    "cdc_active_rows": Plan(_cdc, """
        SELECT user_id, event_id, event_type FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r = 1 AND event_type <> 'error'"""),
    "cdc_versions": Plan(_cdc_dedup, """
        WITH h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error' THEN 1 ELSE 0 END AS a,
                          CASE WHEN event_type = 'error' THEN ts END AS del FROM events),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts, del ORDER BY a DESC, event_id) AS r FROM h)
        SELECT user_id, count(*) AS versions, CAST(sum(a) AS BIGINT) AS active FROM k WHERE r = 1 GROUP BY user_id"""),
    "cdc_envelope": Plan(_envelope, "SELECT event_id, user_id, ts AS updated_at, CASE WHEN event_type = 'error' THEN ts END AS deleted_at, event_id AS log_position FROM events"),
    "incremental_new_rows": Plan(_incremental, """
        SELECT o_orderkey, o_orderdate FROM orders WHERE coalesce(o_orderdate > (
          SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '2000-01-01'), true)"""),
    "incremental_literal": Plan(_incremental_literal, """
        SELECT event_id, ts FROM events WHERE coalesce(ts > (
          SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-20'), true)"""),
    "keep_last_batch": Plan(_last_batch, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)"),
    "merge_upsert_orders": Plan(_merge, """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' AND o_orderkey % 5 <> 0
        UNION ALL SELECT o_orderkey, o_custkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 5 = 0"""),
    "delete_inactive_keys": Plan(_delete_inactive, """
        SELECT md5(coalesce(CAST(e.user_id AS VARCHAR), '')) AS unique_key, e.event_id FROM events e WHERE e.event_type = 'signup' AND EXISTS (
          SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) h
          WHERE h.r = 1 AND h.event_type <> 'error' AND h.user_id = e.user_id)"""),
    "type_and_dedupe": Plan(_type_and_dedupe, """
        SELECT event_id, user_id, ts, value FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""),
    "json_extract_cast": Plan(_extract_cast, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS DATE) AS missing FROM events"),
    "json_unnest_hash": Plan(_unnest, """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
               md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS hashid FROM lineitem"""),
    "row_hash": Plan(_row_hash, """
        SELECT n_nationkey, n_name, r_name, md5(concat_ws('-', CAST(n_nationkey AS VARCHAR), n_name, r_name)) AS hashid
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "hash_dialects": Plan(_hash_dialects, """
        SELECT n_nationkey, md5(concat_ws('~', n_name, CAST(n_regionkey AS VARCHAR))) AS tilde, sha256(n_name || 'salt') AS salted,
               to_base64(encode(n_name)) AS b64, n_name AS plain FROM nation"""),
    "casts": Plan(_casts, """
        SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS as_long, CAST(NULL AS DOUBLE) AS bad,
               event_type = 'view' AS flag, CASE WHEN event_type <> 'click' THEN event_type END AS kind,
               least(greatest(value, 2.0), 10.0) AS clamped, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events"""),
    "log_positions": Plan(_lsn, "SELECT o_orderkey, o_custkey * 4294967296 + o_orderkey AS lsn, upper(hex(o_custkey)) || '/' || upper(hex(o_orderkey)) AS text FROM orders"),
    "diff_metric": Plan(_diff, """
        WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0),
             b AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0),
             n AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS l, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS r)
        SELECT l + r + abs(l - r) AS metric FROM n"""),
    "star_intersect": Plan(_star, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name || 'x') END AS n_name FROM nation"),
    "row_counts": Plan(_row_counts, """
        SELECT 'events' AS label, count(*) AS row_count, CAST(1 AS BIGINT) AS expected_count FROM events
        UNION ALL SELECT 'errors', count(*), 2 FROM events WHERE event_type = 'error'"""),
    "unique_test": Plan(_duplicates, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1"),
    "record_pipeline": Plan(_record_pipeline, """
        SELECT event_id, 2 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS twice, 'events' AS stream FROM events
        WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AND event_type <> 'error'"""),
    "cursor_filter": Plan(_cursor_filter, "SELECT o_orderkey FROM orders WHERE o_orderkey > 250 AND o_orderkey < 900"),
    "record_extraction": Plan(_dpath, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events, (SELECT unnest([1, 2]) AS i)"),
    "skip_nonconforming": Plan(_conforming, "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'view'"),
}
