"""Queries of analytics, state, classification and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import names as M
from heddle.operators import analytics as A
from heddle.operators import classify as C
from heddle.operators import state as S
from heddle.plans.base import Plan, table
from heddle.sources import sinks, tables

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "INTERVAL 1 DAY"


def _top_types(spark, d):
    return A.top_counts(table(spark, d, "events"), "event_type", 100)


def _top_users(spark, d):
    return A.top_counts(table(spark, d, "events"), "user_id", 50)


def _contributors(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("name"), F.concat("lang", F.lit("@x.org")).alias("email"), F.lit(1).cast("long").alias("commits"), "doc_id")
    docs = docs.withColumn("name", F.when(F.col("name") == "src3", "renovate").otherwise(F.col("name")))
    humans = docs.where(~A.is_bot(F.col("name"), F.col("email")))
    return A.contributors(humans, "name", "email", "commits", "doc_id").select("contributor", "name", "email", "commits")


def _bus(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return A.bus_factor(o, ["o_orderstatus"], "o_custkey", "n")


def _heaviest_parts(spark, d):
    """How many of the heaviest lines of each flag have nine tenths of its price: weights of many values, groups of many rows."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.floor(F.col("l_extendedprice")).alias("price"))
    return A.heaviest(rows, ["l_returnflag"], "price", 0.9)


def _split(spark, d):
    """All documents cut at paragraphs, lines and words; digests of the chunks."""
    from heddle.sources.documents import split_text

    out = split_text(table(spark, d, "documents").select("doc_id", "text"), "text", 1000, 200)
    return out.select("doc_id", "chunk_no", "start", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("md5"))


def _top_share(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return A.top_contributor(o, ["o_orderpriority"], "o_orderstatus", "n", "first")


def _activity(spark, d):
    return A.activity(table(spark, d, "events"), ["user_id"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), (7, 14))


def _portfolio(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.datediff(F.lit("2001-08-01").cast("date"), F.max("o_orderdate")).alias("days"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    flags = A.portfolio_flags(
        F.when(F.col("c_nationkey") < 5, "Tier 1").otherwise("Tier 2"), F.when(F.col("c_acctbal") < 0, "HIGH_RISK"),
        F.when(F.col("c_mktsegment") == "BUILDING", "PII"), F.col("days"), F.col("n"), F.lit(None).cast("double"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "DEPRECATED").otherwise("ACTIVE"),
    )
    return A.portfolio_counts(j, flags)


def _usage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("o"), (F.col("o_orderkey") % 3).alias("c"), F.lit(None).cast("double").alias("s"))
    return A.usage_totals(o, "i", "o", "c", "s")


def _throughput(spark, d):
    return A.throughput(table(spark, d, "conversations").withColumn("s", F.lit(0.5)), ["role"], "text", "s")


def _fraud(spark, d):
    o = table(spark, d, "orders")
    score = A.fraud_score(F.col("o_totalprice") / 100, F.col("o_orderkey") % 7, F.col("o_custkey") % 9, F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", score.alias("score"))


def _review(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select("doc_id", F.col("source").alias("run"), F.when(F.col("toxic") == 1, "APPROVED").otherwise("PENDING").alias("status"), (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100).alias("confidence"), F.col("doc_id").alias("created_at"))


REVIEW_SQL = """
SELECT doc_id, source AS run, CASE WHEN toxic = 1 THEN 'APPROVED' ELSE 'PENDING' END AS status, (doc_id * 37) % 100 / 100 AS confidence, doc_id AS created_at
FROM labels JOIN documents USING (doc_id)
"""


def _page(spark, d):
    return A.pending(_review(spark, d), "run", "status", "confidence", "doc_id", 2, 10).select("doc_id", "run", "confidence")


def _bulk(spark, d):
    return A.approved(_review(spark, d), "status", "confidence", 0.7).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _override(spark, d):
    r = _review(spark, d).select("doc_id", "status").withColumn("reviewer_note", F.lit("")).withColumn("llm_suggestion", F.lit("a"))
    return A.decided(r, "doc_id", 1, "OVERRIDDEN", "note", "b")


def _low(spark, d):
    return _review(spark, d).where(F.col("confidence") < 0.70).select("doc_id", "confidence")


def _intervals(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").alias("start_at"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_at"))
    return S.merged_intervals(e, ["user_id"], "start_at", "end_at", F.expr("INTERVAL 3 HOURS"))


def _running(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return S.running_cursor(e, ["user_id"], ["event_id"], "value").select("event_id", "max_cursor", "out_of_order")


def _checkpoints(spark, d):
    return S.checkpoints(table(spark, d, "events"), ["event_type"], ["event_id"], 100).select("event_id", "event_type", "place", "checkpoint")


def _rate(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("s"))
    return S.rate(e, ["user_id"], "s", 86_400).select("event_id", "in_window")


def _listing(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("url").alias("uri"), F.expr("make_timestamp_ntz(2024, 1, 1 + cast(page_id % 28 as int), 0, 0, 0)").alias("last_modified"), "page_id")


def _files(spark, d):
    p = _listing(spark, d)
    seen = p.where("page_id % 3 = 0").select("uri", F.when(F.col("page_id") % 2 == 0, F.col("last_modified")).otherwise(F.expr("last_modified - INTERVAL 1 DAY")).alias("last_modified"))
    return S.files_to_sync(p, seen.groupBy("uri").agg(F.max("last_modified").alias("last_modified")), False, None).select("page_id", "uri")


def _file_cursor(spark, d):
    return S.file_cursor(_listing(spark, d))


def _richest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.length("text").alias("score"))
    return C.richest(docs, ["source", "lang"], F.col("score"), "doc_id").select("source", "lang", "doc_id")


def _majority(spark, d):
    line = table(spark, d, "lineitem").withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return C.majority(line, ["l_suppkey"], "l_returnflag", "place")


def _classify(spark, d):
    p = table(spark, d, "part")
    tech = F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_size") % 5 == 0, "kafka").when(F.col("p_size") % 5 == 1, "Postgres").when(F.col("p_size") % 5 == 2, "react"))
    return p.select("p_partkey", C.container_type(tech, F.when(F.col("p_size") % 2 == 0, F.lit("web api")), F.col("p_brand")).alias("kind"), C.coerced(F.col("p_type"), ["PROMO", "SMALL"]).alias("coerced"), C.layer(F.concat(F.col("p_name"), F.when(F.col("p_size") > 40, "Service").otherwise(""))).alias("layer"))


def _grep(spark, d):
    return C.grep(table(spark, d, "documents"), ["doc_id"], "text", r"Licensed under", 10)


def _protocols(spark, d):
    rules = [("license", ["Licensed under"]), ("token", [r"token = ", r"AKIA"]), ("phone", [r"\+1 \("]), ("none", ["KafkaProducer"])]
    return C.first_by_rule(table(spark, d, "documents"), "text", "doc_id", rules)


def _frameworks(spark, d):
    found = {"ring": ("metal", "Ring"), "bolt": ("metal", "Bolt"), "widget": ("tool", "Widget")}
    return C.indicators(table(spark, d, "part"), ["p_partkey"], "p_name", found)


def _labels(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("may send the "), F.col("p_name"), F.lit(" orders through a queue."))
    return p.select("p_partkey", M.compact_label(text).alias("label"), M.humanized(F.concat_ws("_", F.lit("uses"), F.lower("p_type"))).alias("kind"), M.identifier("p_name").alias("ident"))


def _logical(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", M.logical_name(F.concat(F.lit("https://api."), F.regexp_replace("s_name", "#", "-"), F.lit("-SDK/v2/x"))).alias("logical"))


def _slices(spark, d):
    r, n = table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name", F.col("n_name").alias("r_name"))
    return tables.slice_product(r, n)


def _keyset(spark, d):
    return tables.keyset_page(table(spark, d, "orders"), "o_orderkey", 500, 12_000, 100).select("o_orderkey", "o_custkey")


def _concat(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    return tables.concatenated([n, table(spark, d, "region").select(F.col("r_name").alias("name"))])


def _chunks(spark, d):
    return sinks.split_documents(table(spark, d, "documents"), ["doc_id"], "text", 1000, 200).select("doc_id", "chunk_no", F.md5("chunk").alias("md5"))


def _flatten(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.struct("user_id").alias("extra"))
    return sinks.flattened(e, ["event_id"])


def _layout(spark, d):
    out, parts = sinks.with_layout(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "YEAR/MONTH")
    return out.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


def _pages(spark, d):
    return tables.page_numbers(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


def _timings(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return A.event_timings(e, "user_id", "first", "last", "duration")


def _detected(spark, d):
    e = table(spark, d, "events")
    clicks = C.Detector("clicks", F.col("event_type") == "click", F.array(F.get_json_object("props", "$.k")))
    large = C.Detector("large", F.col("value") > 50, F.array(F.col("event_type"), F.lit("value")))
    return C.detected(e, ["event_id"], [clicks, large])


PLANS = {
    "event_timings": Plan(_timings, "SELECT user_id AS name, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration FROM events GROUP BY user_id"),
    "detector_findings": Plan(_detected, """
        SELECT event_id, 'clicks' AS detector, json_extract_string(props, '$.k') AS found FROM events WHERE event_type = 'click'
        UNION ALL SELECT event_id, 'large', unnest([event_type, 'value']) FROM events WHERE value > 50"""),
    "events_top_types": Plan(_top_types, "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100"),
    "events_top_users": Plan(_top_users, "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50"),
    "contributors_dedup": Plan(_contributors, """
        WITH d AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'renovate' ELSE source END AS name, lang || '@x.org' AS email FROM documents),
        h AS (SELECT * FROM d WHERE name <> 'renovate'),
        c AS (SELECT lower(email) AS contributor, name, count(*) AS n, min(doc_id) AS first FROM h GROUP BY 1, 2)
        SELECT contributor, arg_min(name, (-n, first)) AS name, contributor AS email, CAST(sum(n) AS BIGINT) AS commits FROM c GROUP BY contributor"""),
    "bus_factor": Plan(_bus, """
        WITH c AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL),
        r AS (SELECT *, row_number() OVER w AS rn, sum(n) OVER w AS run, sum(n) OVER (PARTITION BY o_orderstatus) AS t FROM c
              WINDOW w AS (PARTITION BY o_orderstatus ORDER BY n DESC, o_custkey ROWS UNBOUNDED PRECEDING))
        SELECT o_orderstatus, min(rn) AS bus_factor FROM r WHERE run >= 0.5 * t GROUP BY 1"""),
    "heaviest_lines": Plan(_heaviest_parts, """
        WITH w AS (SELECT l_returnflag, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem),
        r AS (SELECT l_returnflag, row_number() OVER w AS rn, sum(p) OVER w AS run, sum(p) OVER (PARTITION BY l_returnflag) AS t FROM w
              WINDOW w AS (PARTITION BY l_returnflag ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
        SELECT l_returnflag, min(rn) AS selected FROM r WHERE run >= 0.9::DOUBLE * t GROUP BY 1"""),
    "split_recursive": Plan(_split),
    "top_contributor": Plan(_top_share, """
        WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
        SELECT o_orderpriority, arg_min(o_orderstatus, (-n, f)) AS top_contributor, round(max(n) / sum(n), 3) AS top_contributor_share FROM c GROUP BY 1"""),
    "windowed_activity": Plan(_activity, f"""
        SELECT user_id, count(*) FILTER (ts >= {NOW} - INTERVAL 7 DAY) AS count_7d, count(*) FILTER (ts >= {NOW} - INTERVAL 14 DAY) AS count_14d,
               max(ts) AS last_at, greatest(date_diff('day', max(ts), {NOW}), 0) AS days_since FROM events GROUP BY 1"""),
    "portfolio_counts": Plan(_portfolio, """
        WITH o AS (SELECT o_custkey, count(*) AS n, date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-01') AS days FROM orders GROUP BY 1)
        SELECT count(*) AS total, count(*) FILTER (c_nationkey < 5) AS tier1, count(*) FILTER (c_acctbal < 0) AS high_risk,
               count(*) FILTER (c_mktsegment = 'BUILDING') AS pii, count(*) FILTER (days > 90) AS stale, count(*) FILTER (n = 1) AS single_owner,
               count(*) FILTER (c_mktsegment = 'MACHINERY') AS deprecated FROM customer LEFT JOIN o ON c_custkey = o_custkey"""),
    "usage_totals": Plan(_usage, """
        SELECT CAST(sum(o_orderkey) AS BIGINT) AS tokens_in, CAST(sum(o_custkey) AS BIGINT) AS tokens_out, CAST(sum(o_orderkey % 3) AS BIGINT) AS tool_calls,
               count(*) AS runs, CAST(0 AS DOUBLE) AS avg_speed FROM orders"""),
    "throughput": Plan(_throughput, """
        SELECT role, CAST(sum(length(text) // 4) AS BIGINT) AS tokens_out, round(sum(length(text) // 4) / greatest(sum(0.5), 0.05), 2) AS tps FROM conversations GROUP BY 1"""),
    "fraud_rules": Plan(_fraud, """
        SELECT o_orderkey, round(least(CAST(0.15 AS DOUBLE) + CASE WHEN o_totalprice / 100 > 5000 THEN CAST(0.35 AS DOUBLE) ELSE 0 END + CASE WHEN o_orderkey % 7 > 3 THEN CAST(0.2 AS DOUBLE) ELSE 0 END
          + CASE WHEN o_custkey % 9 > 5 THEN CAST(0.2 AS DOUBLE) ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 0.99), 2) AS score FROM orders"""),
    "review_queue_page": Plan(_page, f"""
        WITH r AS ({REVIEW_SQL}), l AS (SELECT run FROM r GROUP BY run ORDER BY max(created_at) DESC, run LIMIT 1)
        SELECT doc_id, run, confidence FROM r WHERE run IN (SELECT run FROM l) AND status = 'PENDING' ORDER BY confidence, doc_id LIMIT 10 OFFSET 2"""),
    "bulk_approve": Plan(_bulk, f"SELECT CASE WHEN status = 'PENDING' AND confidence >= 0.7 THEN 'APPROVED' ELSE status END AS status, count(*) AS n FROM ({REVIEW_SQL}) GROUP BY 1"),
    "review_override": Plan(_override, f"""
        SELECT doc_id, CASE WHEN doc_id = 1 THEN 'OVERRIDDEN' ELSE status END AS status, CASE WHEN doc_id = 1 THEN 'note' ELSE '' END AS reviewer_note,
               CASE WHEN doc_id = 1 THEN 'b' ELSE 'a' END AS llm_suggestion FROM ({REVIEW_SQL})"""),
    "low_confidence": Plan(_low, f"SELECT doc_id, confidence FROM ({REVIEW_SQL}) WHERE confidence < 0.70"),
    "merge_intervals": Plan(_intervals, """
        WITH e AS (SELECT user_id, ts AS s, ts + INTERVAL 2 HOUR AS e FROM events),
        m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e),
        i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
        SELECT user_id, min(s) AS start_at, max(e) AS end_at FROM i GROUP BY user_id, g"""),
    "running_max_cursor": Plan(_running, """
        SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS max_cursor,
               coalesce(value < max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM events"""),
    "checkpoint_batches": Plan(_checkpoints, """
        SELECT event_id, event_type, row_number() OVER w AS place, (row_number() OVER w - 1) // 100 AS checkpoint FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"""),
    "rate_window": Plan(_rate, """
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_window
        FROM (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events)"""),
    "files_to_sync": Plan(_files, """
        WITH p AS (SELECT url AS uri, make_timestamp(2024, 1, 1 + page_id % 28, 0, 0, 0) AS m, page_id FROM pages),
        h AS (SELECT uri, max(CASE WHEN page_id % 2 = 0 THEN m ELSE m - INTERVAL 1 DAY END) AS s FROM p WHERE page_id % 3 = 0 GROUP BY 1)
        SELECT page_id, uri FROM p LEFT JOIN h USING (uri) WHERE s IS NULL OR m > s"""),
    "file_cursor": Plan(_file_cursor, "SELECT make_timestamp(2024, 1, 1 + page_id % 28, 0, 0, 0) AS last_modified, url AS uri FROM pages ORDER BY 1 DESC, 2 DESC LIMIT 1"),
    "richest_duplicate": Plan(_richest, """
        SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1"""),
    "majority_vote": Plan(_majority, """
        WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, arg_min(l_returnflag, (-n, f)) AS l_returnflag FROM c GROUP BY 1"""),
    "keyword_classify": Plan(_classify, """
        WITH p AS (SELECT *, lower(concat_ws(' ', p_name, CASE p_size % 5 WHEN 0 THEN 'kafka' WHEN 1 THEN 'Postgres' WHEN 2 THEN 'react' END)) AS t,
                          CASE WHEN p_size % 2 = 0 THEN 'web api' ELSE '' END AS k FROM part)
        SELECT p_partkey, CASE WHEN contains(t, 'kafka') THEN 'MessageBroker' WHEN contains(t, 'postgres') THEN 'Database'
                               WHEN regexp_matches(t, 'sh') THEN 'ShellScript'
                               WHEN contains(t, 'react') AND k <> '' THEN 'ClientSideWebApp'
                               WHEN k <> '' THEN 'ServerSideWebApp'
                               ELSE 'Unknown' END AS kind,
               CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE 'Unknown' END AS coerced,
               CASE WHEN p_size > 40 THEN 'business' ELSE 'unknown' END AS layer FROM p"""),
    "grep_lines": Plan(_grep, r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
        SELECT doc_id, CAST(n AS BIGINT) AS line_no, substr(line, greatest(strpos(line, 'Licensed under') - 10, 1), strpos(line, 'Licensed under') + 14 + 10 - greatest(strpos(line, 'Licensed under') - 10, 1)) AS snippet
        FROM l WHERE contains(line, 'Licensed under')"""),
    "first_fingerprints": Plan(_protocols, r"""
        SELECT 'license' AS rule, min(doc_id) AS doc_id FROM documents WHERE contains(text, 'Licensed under') HAVING count(*) > 0
        UNION ALL SELECT 'token', min(doc_id) FROM documents WHERE regexp_matches(text, 'token = |AKIA') HAVING count(*) > 0
        UNION ALL SELECT 'phone', min(doc_id) FROM documents WHERE contains(text, '+1 (') HAVING count(*) > 0
        UNION ALL SELECT 'none', min(doc_id) FROM documents WHERE contains(text, 'KafkaProducer') HAVING count(*) > 0"""),
    "framework_indicators": Plan(_frameworks, """
        SELECT p_partkey, place, indicator, language, framework FROM part, (VALUES (0, 'ring', 'metal', 'Ring'), (1, 'bolt', 'metal', 'Bolt'), (2, 'widget', 'tool', 'Widget')) t(place, indicator, language, framework)
        WHERE contains(lower(p_name), indicator)"""),
    "edge_labels": Plan(_labels, """
        SELECT p_partkey, 'send the ' || p_name || ' orders' AS label, 'Uses ' || upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS kind, replace(p_name, ' ', '_') AS ident FROM part"""),
    "logical_names": Plan(_logical, "SELECT s_suppkey, 'supplier_' || split_part(s_name, '#', 2) AS logical FROM supplier"),
    "partition_product": Plan(_slices, "SELECT r_name, n_name FROM region, nation"),
    "keyset_page": Plan(_keyset, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 AND o_orderkey <= 12000 ORDER BY 1 LIMIT 100"),
    "concatenated_streams": Plan(_concat, "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, NULL FROM region"),
    "chunk_text": Plan(_chunks, """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        c AS (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil((length(t) - 200) / 800) AS BIGINT) - 1, 0) + 1)) AS chunk_no FROM d)
        SELECT doc_id, chunk_no, md5(substr(t, chunk_no * 800 + 1, 1000)) AS md5 FROM c"""),
    "flattened_csv": Plan(_flatten, """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, '{"user_id":' || user_id || '}' AS extra FROM events"""),
    "lake_layout": Plan(_layout, "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2"),
    "page_numbers": Plan(_pages, "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders"),
}
