"""Queries of architecture operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import architecture as X
from heddle.plans.base import Plan, table


def _ownership(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type").alias("text"))
    return X.ownership(p, [("ring", "PROMO", 0.9), ("bolt", "SMALL", 0.8), ("r", "ECONOMY", 0.6)], "p_name", "text").select("p_partkey", "owned", "confidence")


def _ends(spark, d):
    known = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).withColumn("id", F.col("id").cast("string"))
    edges = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("container:nation_"), "s_nationkey").alias("to"))
    return X.resolved_ends(edges, known, "to").select("s_suppkey", "to_id", "to_ghost")


def _stale(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.md5("c_name").alias("digest"))
    other = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.md5(F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise("x")).alias("digest"))
    return X.stale(c, other, "k", "digest").select("k", "stale")


def _members(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path")).distinct()
    return X.collection_members(p, "path", 10)


def _frameworks(spark, d):
    line = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("m"), F.when(F.col("l_suppkey") % 2 == 0, "Java").otherwise("Go").alias("lang"))
    return X.framework_scores(line, {"all": ("Java", ["A", "N", "R", "none"]), "a": ("Go", ["A"])}, "l_suppkey", "m", "lang")


def _names(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("src/region/"), "n_name"))).alias("paths"), F.sort_array(F.collect_list("n_name")).alias("names"))
    return n.select("n_regionkey", X.cluster_name(F.col("paths"), F.col("names")).alias("name"))


def _rendered(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.lit("uses").alias("type"))
    n = table(spark, d, "nation").where("n_nationkey < 15").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") < 5, "External ").otherwise("system").alias("type"))
    own = s.select(F.col("source").alias("id"), F.when(F.col("source") < "s5", "Person").otherwise("system").alias("type"))
    return X.rendered_edges(s, own.unionByName(n)).select("source", "target", "label_at")


def _report(spark, d):
    return X.run_report({"orders": table(spark, d, "orders")}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")


def _graph(spark, d):
    frames = {"nation": table(spark, d, "nation"), "region": table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")}
    return X.run_query_graph(frames, [
        {"type": "table", "name": "nation"}, {"type": "join", "name": "region", "on": "n_regionkey"}, {"type": "filter", "condition": "n_nationkey > 2"},
        {"type": "aggregate", "group": ["r_name"], "values": {"n": "count(*)"}}, {"type": "order", "by": ["r_name"]},
    ])


def _grouped(spark, d):
    c = table(spark, d, "customer")
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit(1.0).alias("weight"))
    ids = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    elements = ids.select("id", F.when(F.col("id").endswith("7"), "Lucky").alias("framework"), F.lit(0.8).alias("score"))
    return X.grouped(elements, edges)


PLANS = {
    "ownership_signals": Plan(_ownership, """
        WITH s AS (SELECT p_partkey, greatest(CASE WHEN contains(p_name, 'ring') AND p_type = 'PROMO' THEN CAST(0.9 AS DOUBLE) END,
          CASE WHEN contains(p_name, 'bolt') AND p_type = 'SMALL' THEN CAST(0.8 AS DOUBLE) END, CASE WHEN contains(p_name, 'r') AND p_type = 'ECONOMY' THEN CAST(0.6 AS DOUBLE) END) AS c FROM part)
        SELECT p_partkey, c IS NOT NULL AS owned, coalesce(c, 0.5) AS confidence FROM s"""),
    "edge_ends": Plan(_ends, """
        SELECT s_suppkey, CASE WHEN s_nationkey < 20 THEN CAST(s_nationkey AS VARCHAR) ELSE 'ghost:nation_' || s_nationkey END AS to_id, s_nationkey >= 20 AS to_ghost FROM supplier"""),
    "stale_report": Plan(_stale, "SELECT c_custkey AS k, c_custkey % 3 <> 1 AS stale FROM customer ORDER BY 2 DESC, 1"),
    "collection_members": Plan(_members, """
        WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
        x AS (SELECT path, string_split(path, '/') AS parts FROM p),
        a AS (SELECT path, array_to_string(parts[1:i], '/') AS folder FROM (SELECT path, parts, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS i FROM x)),
        m AS (SELECT folder FROM a GROUP BY 1 HAVING count(DISTINCT path) >= 10)
        SELECT path, path IN (SELECT path FROM a WHERE folder IN (SELECT folder FROM m)) AS member FROM p"""),
    "framework_scores": Plan(_frameworks, """
        WITH s AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS m FROM lineitem GROUP BY 1)
        SELECT l_suppkey, 'all' AS framework, CASE WHEN l_suppkey % 2 = 0 THEN len(list_intersect(m, ['A', 'N', 'R', 'none'])) / 4 ELSE 0 END AS score FROM s
        UNION ALL SELECT l_suppkey, 'a', CASE WHEN l_suppkey % 2 = 1 THEN len(list_intersect(m, ['A'])) / 1 ELSE 0 END FROM s"""),
    "cluster_names": Plan(_names, "SELECT DISTINCT n_regionkey, 'Region' AS name FROM nation"),
    "edge_rendering": Plan(_rendered, """
        SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target, CASE WHEN 's' || s_suppkey < 's5' THEN 'source' WHEN s_nationkey < 5 THEN 'target' ELSE 'middle' END AS label_at
        FROM supplier WHERE s_nationkey < 15"""),
    "report_query": Plan(_report, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "query_graph": Plan(_graph, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 2 GROUP BY 1"),
    "two_tier_groups": Plan(_grouped),
}
