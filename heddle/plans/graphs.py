"""Queries of dependency graphs and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heddle.operators import graph as G
from heddle.operators.communities import shared_communities
from heddle.plans.base import Plan, table
from heddle.session import shared_dir
from heddle.streaming import streams


def _tasks(spark, d) -> int:
    """Tasks for the lines and for their pairs, some two for each line: a task's share does not grow with the table."""
    rows = table(spark, d, "lineitem").count()
    return max(rows // 500_000, min(rows // 50_000, spark.sparkContext.defaultParallelism)) + 1


def _lines(spark, d, tasks: int):
    """(l_orderkey, l_partkey), each once, those of an order in one task."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()


def _pairs(spark, d, tasks: int):
    """Parts that stand in one order, each unordered pair once per order: at most seven lines an order."""
    lines = _lines(spark, d, tasks)
    a = lines.select("l_orderkey", F.col("l_partkey").alias("source"))
    b = lines.select("l_orderkey", F.col("l_partkey").alias("target"))
    return a.join(b, "l_orderkey").where("source < target").select("source", "target", F.lit(1.0).alias("weight"))


def _ties(spark, d):
    """The parts of an order tied to its least one: the ends and the components of all its pairs, by fewer edges."""
    lines = _lines(spark, d, _tasks(spark, d)).where("l_partkey IS NOT NULL AND l_orderkey IS NOT NULL")
    least = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("source"))
    return lines.join(least, "l_orderkey").where("source < l_partkey").select("source", F.col("l_partkey").alias("target"))


PAIRS_SQL = """
SELECT a.l_partkey AS source, b.l_partkey AS target FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
"""


def _edges(spark, d):
    tasks = _tasks(spark, d)
    return G.merged_edges(_pairs(spark, d, tasks), undirected=True, tasks=tasks)


def _induced(spark, d):
    return G.induced(_edges(spark, d), table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")))


def _sparse(spark, d):
    """All customers, suppliers and nations, tied to where they belong: a component for each region."""
    def ties(name, key, to, own, other):
        return table(spark, d, name).select(F.concat(F.lit(own), key).alias("source"), F.concat(F.lit(other), to).alias("target"), F.lit(1.0).alias("weight"))

    customers, suppliers = ties("customer", "c_custkey", "c_nationkey", "c", "n"), ties("supplier", "s_suppkey", "s_nationkey", "s", "n")
    return customers.unionByName(suppliers).unionByName(ties("nation", "n_nationkey", "n_regionkey", "n", "r"))


def _weak(spark, d):
    return G.weak_components(_sparse(spark, d))


WEAK_SQL = """
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
b AS (SELECT DISTINCT s AS a, t AS b FROM e UNION SELECT DISTINCT t, s FROM e),
r(id, reach) AS (SELECT DISTINCT a, a FROM b UNION SELECT r.id, b.b FROM r JOIN b ON r.reach = b.a)
SELECT id, min(reach) AS component FROM r GROUP BY id
"""


def _summary(spark, d):
    return G.summary(_sparse(spark, d))


def _communities(spark, d):
    return G.communities(_sparse(spark, d))


def _groups(spark, d):
    return G.groups_of(_communities(spark, d), _sparse(spark, d).select(F.col("source").alias("id"))).select("community", "size", "confidence")


def _components(spark, d):
    """Components of the graph of parts that were bought together."""
    return G.weak_components(_ties(spark, d))


def _co_summary(spark, d):
    return G.summary(_edges(spark, d), _ties(spark, d))


def _co_communities(spark, d):
    """Communities of the graph of parts that were bought together, weighted by how often."""
    return shared_communities(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", _tasks(spark, d))


COMPONENTS_SQL = f"""
WITH RECURSIVE p AS ({PAIRS_SQL}),
e AS (SELECT DISTINCT source AS s, target AS t FROM p UNION SELECT DISTINCT target, source FROM p),
cc(id, component) USING KEY (id) AS (
    SELECT DISTINCT s, s FROM e
    UNION SELECT e.t, min(c.component) FROM cc c JOIN e ON c.id = e.s JOIN recurring.cc r ON r.id = e.t WHERE c.component < r.component GROUP BY e.t
)
SELECT id, component FROM cc
"""

SUMMARY_SQL = f"""
WITH p AS ({PAIRS_SQL}), e AS (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM p WHERE source <> target), c AS ({COMPONENTS_SQL}),
n AS (SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM c)
SELECT nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) / (nodes * (nodes - 1)) AS density, components FROM n
"""


def _proximity(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return G.directory_edges(p.withColumn("path", F.concat("path", F.lit("/"), "page_id")), "page_id", "path", "page_id")


PROXIMITY_SQL = r"""
WITH p AS (SELECT page_id AS name, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS dir FROM pages),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name) AS rn FROM p) WHERE rn <= 20),
x AS (SELECT dir, list_filter(string_split(dir, '/'), lambda y: y <> '') AS parts FROM (SELECT DISTINCT dir FROM own)),
u AS (SELECT dir, parts, unnest(range(0, least(2, len(parts)) + 1)) AS up FROM x),
v AS (SELECT dir, up, array_to_string(parts[1:len(parts) - up], '/') AS above FROM u),
n AS (SELECT a.dir AS dir, b.dir AS other, min(a.up + b.up) AS steps FROM v a JOIN v b ON a.above = b.above WHERE a.up + b.up <= 2 GROUP BY ALL)
SELECT DISTINCT l.name AS source, r.name AS target, 'directory' AS type, CASE steps WHEN 0 THEN CAST(0.3 AS DOUBLE) WHEN 1 THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS weight
FROM n JOIN own l ON l.dir = n.dir JOIN own r ON r.dir = n.other WHERE l.name <> r.name
"""


def _resolution(spark, d):
    p = table(spark, d, "part")
    elements = p.select(F.concat_ws(".", F.lower("p_brand"), F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_partkey") < 40, F.col("p_partkey").cast("string")).otherwise(""))).alias("name"))
    tokens = p.select("p_partkey", F.concat(F.regexp_replace("p_name", " ", ""), F.col("p_partkey")).alias("token"))
    return G.resolved(tokens, elements, "token", "name")


RESOLUTION_SQL = """
WITH e AS (SELECT DISTINCT lower(p_brand) || '.' || replace(p_name, ' ', '_') || CASE WHEN p_partkey < 40 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS name FROM part),
q AS (SELECT name, string_split(name, '.')[-1] AS simple, replace(lower(string_split(name, '.')[-1]), '_', '') AS sq FROM e),
s1 AS (SELECT simple, count(*) AS n, min(name) AS m FROM q GROUP BY 1), s2 AS (SELECT sq, count(*) AS n, min(name) AS m FROM q GROUP BY 1),
t AS (SELECT p_partkey, replace(p_name, ' ', '') || p_partkey AS token FROM part),
j AS (SELECT t.*, coalesce(e.name, CASE WHEN s1.n = 1 THEN s1.m END, CASE WHEN s1.n IS NULL AND s2.n = 1 THEN s2.m END) AS resolved
      FROM t LEFT JOIN e ON e.name = t.token LEFT JOIN s1 ON s1.simple = string_split(t.token, '.')[-1] LEFT JOIN s2 ON s2.sq = replace(lower(string_split(t.token, '.')[-1]), '_', ''))
SELECT p_partkey, token, resolved FROM j WHERE resolved IS NOT NULL
"""


def _outer(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("k")).distinct()
    return G.outer_merged(c, o, ["k"])


def _relations(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("from"), F.col("event_type").alias("to"), F.lit("uses").alias("type"), F.lit("HTTPS").alias("protocol"))
    return G.relation_set(e)


def _evidence(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("evidence"))
    return G.evidence_nodes(n.select(F.col("n_regionkey").cast("string").alias("id"), "evidence"))


def _upsert(spark, d):
    n = table(spark, d, "nation")
    old = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("kept"), F.lit("yes")).alias("props"))
    new = n.where("n_nationkey > 10").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.lower("n_name")).alias("props"))
    return G.upserted_nodes(old, new).select("id", F.col("props")["name"].alias("name"), F.col("props")["kept"].alias("kept"))


def _shared(spark, d):
    return G.shared_values(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


def _directory_classes(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return G.directory_classes(p.withColumn("path", F.concat("path", F.lit("/"), "page_id")), "page_id", "path", "page_id")


def _value_classes(spark, d):
    """Parts with the suppliers that delivered them, over all lines."""
    return G.shared_value_classes(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


CLASSES_SQL = r"""
WITH p AS (SELECT page_id AS name, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS dir FROM pages),
own AS (SELECT name, list_filter(string_split(dir, '/'), lambda y: y <> '') AS parts FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name) AS rn FROM p) WHERE rn <= 20),
u AS (SELECT name, array_to_string(parts, '/') AS dir, len(parts) AS n, unnest(range(0, least(2, len(parts)) + 1)) AS up, parts FROM own),
v AS (SELECT name, dir, up, array_to_string(parts[1:n - up], '/') AS above FROM u),
pairs AS (SELECT DISTINCT a.dir, a.name AS source, b.name AS target FROM v a JOIN v b ON a.above = b.above WHERE a.up + b.up <= 2)
SELECT dir, count(DISTINCT source)::BIGINT AS members, count(DISTINCT target)::BIGINT AS near, count(*) FILTER (source <> target)::BIGINT AS links FROM pairs GROUP BY dir
"""

VALUE_CLASSES_SQL = """
WITH o AS (SELECT DISTINCT l_suppkey AS o, l_partkey FROM lineitem)
SELECT a.l_partkey, count(DISTINCT a.o) AS owners, count(*) FILTER (a.o < b.o) AS links FROM o a JOIN o b ON a.l_partkey = b.l_partkey GROUP BY 1
"""


def _workspace(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream_map(spark, d):
    """All events through a stateless stream, read from a folder that a file stream can list."""
    at = _workspace(spark)
    events = table(spark, d, "events").select("event_id", "event_type")
    events.write.parquet(f"{at}/in")
    out = streams.enriched(streams.file_stream(spark, f"{at}/in", "event_id long, event_type string"), "event_type")
    streams.run_available(out, f"{at}/out", f"{at}/state")
    return spark.read.schema("event_id long, event_type string").parquet(f"{at}/out")


def _people(spark, d):
    """Nations and customers, each with the run that wrote it, and who belongs where."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("run"))
    c = table(spark, d, "customer")
    nodes = n.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("long").alias("run")))
    return nodes, c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.col("c_custkey").alias("run"))


def _matched(spark, d):
    nodes, edges = _people(spark, d)
    out = G.matched(nodes, edges, a=F.col("name") == "FURNITURE", b=F.col("run") == 1)
    return out.select(F.col("a.id").alias("customer"), F.col("b.name").alias("nation"))


def _rolled_back(spark, d):
    nodes, edges = G.rolled_back(*_people(spark, d), "run", 2)
    return nodes.select(F.lit("node").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("id")))


PLANS = {
    "graph_pattern": Plan(_matched, """
        SELECT 'c' || c_custkey AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_mktsegment = 'FURNITURE' AND n_regionkey = 1"""),
    "run_rollback": Plan(_rolled_back, """
        SELECT 'node' AS kind, 'n' || n_nationkey AS id FROM nation WHERE n_regionkey <> 2
        UNION ALL SELECT 'node', 'c' || c_custkey FROM customer WHERE c_nationkey <> 2
        UNION ALL SELECT 'edge', 'c' || c_custkey || '>n' || c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE c_custkey <> 2 AND c_nationkey <> 2 AND n_regionkey <> 2"""),
    "co_purchase_edges": Plan(_edges, f"SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM ({PAIRS_SQL}) GROUP BY 1, 2"),
    "induced_subgraph": Plan(_induced, f"""
        SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM ({PAIRS_SQL}) WHERE source IN (SELECT p_partkey FROM part WHERE p_size < 10)
        AND target IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1, 2"""),
    "weak_components": Plan(_weak, WEAK_SQL),
    "graph_summary": Plan(_summary, f"""
        WITH w AS ({WEAK_SQL}), m AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS edges),
        n AS (SELECT count(*) AS nodes, count(DISTINCT component) AS components FROM w)
        SELECT nodes, edges, edges / (nodes * (nodes - 1)) AS density, components FROM n, m"""),
    "communities": Plan(_communities),
    "community_groups": Plan(_groups),
    "directory_proximity": Plan(_proximity, PROXIMITY_SQL),
    "co_purchase_components": Plan(_components, COMPONENTS_SQL),
    "co_purchase_summary": Plan(_co_summary, SUMMARY_SQL),
    "co_purchase_communities": Plan(_co_communities),
    "directory_classes": Plan(_directory_classes, CLASSES_SQL),
    "shared_value_classes": Plan(_value_classes, VALUE_CLASSES_SQL),
    "token_resolution": Plan(_resolution, RESOLUTION_SQL),
    "outer_merge": Plan(_outer, """
        SELECT coalesce(c.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'left_only' WHEN c.k IS NULL THEN 'right_only' ELSE 'both' END AS merged
        FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = 0) o ON c.k = o.k"""),
    "relation_set": Plan(_relations, """SELECT DISTINCT user_id AS "from", event_type AS "to", 'uses' AS type, 'HTTPS' AS protocol FROM events"""),
    "evidence_nodes": Plan(_evidence, """
        SELECT 'evidence:' || n_regionkey || ':' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) AS id, CAST(n_regionkey AS VARCHAR) AS owner, n_name AS evidence FROM nation"""),
    "graph_upsert": Plan(_upsert, """
        SELECT n_nationkey AS id, CASE WHEN n_nationkey > 10 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_nationkey < 20 THEN 'yes' END AS kept FROM nation"""),
    "shared_values": Plan(_shared, """
        SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey
"""),
    "stream_map": Plan(_stream_map, "SELECT event_id, event_type || '|risk-evaluated' AS event_type FROM events"),
}
