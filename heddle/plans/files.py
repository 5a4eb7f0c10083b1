"""Queries that write whole tables to the shared folder and read them back, and of value, date and name functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import names as M
from heddle.functions import schemas as C
from heddle.functions import values as V
from heddle.operators import graph as G
from heddle.operators import normalize as N
from heddle.operators import quality as Q
from heddle.operators import state as S
from heddle.plans.base import Plan, table
from heddle.session import shared_dir
from heddle.sources import files as R
from heddle.sources import sinks as W


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _csv(spark, d):
    """Events as flattened CSV with a header, gzipped, and back: JSON with quotes and commas, empty cells."""
    at = _folder(spark)
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"), "props", "value")
    W.write_csv(e, at, lead=["event_id"], compression="gzip")
    back = R.read(spark, "csv", at)
    return back.select(F.col("event_id").cast("long").alias("event_id"), "kind", "props", F.col("value").cast("double").alias("value"))


def _csv_modes(spark, d):
    """Customers with another delimiter, own names, words for null and for booleans, and columns that are numbered."""
    at = _folder(spark)
    c = table(spark, d, "customer")
    flag = F.when(F.col("c_acctbal") < 0, "no").otherwise("yes")
    c.select("c_custkey", F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).otherwise("NONE").alias("s"), flag.alias("f")).write.option("sep", ";").option("header", "false").csv(at)
    named = R.read_csv(spark, at, R.CsvFormat(delimiter=";", header=("key", "segment", "good"), null_values=("", "NONE"), true_values=("yes",), false_values=("no",)))
    auto = R.read_csv(spark, at, R.CsvFormat(delimiter=";", header="auto"))
    auto = auto.groupBy("f2").agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("key"), F.lit(None).cast("string").alias("segment"), F.col("f2").alias("good"))
    return named.select(F.col("key").cast("long").alias("key"), "segment", "good").unionByName(auto)


def _csv_one_column(spark, d):
    """Orders as CSV of a key and one JSON column, and back."""
    at = _folder(spark)
    W.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), at, lead=["o_orderkey"], flatten=False)
    back = R.read_csv(spark, at)
    data = F.from_json("data", "o_orderstatus string, o_totalprice double")
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), data["o_orderstatus"].alias("status"), data["o_totalprice"].alias("price"))


def _jsonl(spark, d):
    """Orders as gzipped JSON lines, and back with an inferred schema."""
    at = _folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.struct("o_custkey", F.array("o_orderpriority").alias("tags")).alias("nested"))
    W.write_jsonl(o, at, compression="gzip")
    back = R.read(spark, "jsonl", at)
    return back.select("o_orderkey", "o_orderstatus", F.col("nested.o_custkey").alias("o_custkey"), F.col("nested.tags")[0].alias("tag"))


def _lake(spark, d):
    """Prices as decimals in a lake by year and month with a codec, and back as doubles; one file a folder."""
    at = _folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate")
    W.write_lake(o, at, "o_orderdate", "YEAR/MONTH", "parquet", "ZSTD")
    back = R.read_parquet(spark, at, decimal_as_float=True)
    files = R.listing(spark, at, "*.zstd.parquet").select(F.regexp_extract("uri", r"year=(\d+)/month=(\d+)/", 1).cast("int").alias("year"), F.regexp_extract("uri", r"year=(\d+)/month=(\d+)/", 2).cast("int").alias("month"))
    there = files.groupBy("year", "month").agg((F.count(F.lit(1)) > 0).alias("listed"))
    rows = back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))
    return rows.join(there, ["year", "month"])


def _appended(spark, d):
    """JSON lines in two appends, read with a schema that is given, then the table replaced by another."""
    at = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    W.write_lake(c.where("c_custkey % 2 = 0").withColumn("day", F.lit("2024-01-01")), f"{at}/raw", "day", "DATE", "jsonl", "GZIP")
    W.write_lake(c.where("c_custkey % 2 <> 0").withColumn("day", F.lit("2024-01-02")), f"{at}/raw", "day", "DATE", "jsonl", "GZIP")
    raw = spark.read.schema("c_custkey long, c_mktsegment string, day string, date date").json(f"{at}/raw")
    W.overwrite(raw, f"{at}/final")
    W.overwrite(spark.read.parquet(f"{at}/final").where("date = DATE'2024-01-02'").unionByName(raw.where("c_custkey % 4 = 0")), f"{at}/final")
    return R.read(spark, "parquet", f"{at}/final").select("c_custkey", "c_mktsegment", F.col("date").cast("string").alias("date"))


def _migrated(spark, d):
    """Raw tables of the first layout in the second, with nothing of an empty one."""
    e = table(spark, d, "events")
    v1 = e.select(F.md5(F.col("event_id").cast("string")).alias("_x_ab_id"), F.col("ts").alias("_x_emitted_at"), F.col("props").alias("_x_data"))
    return N.migrated_raw(v1, "_x_").unionByName(N.migrated_raw(N.empty_like(v1), "_x_")).select("_x_raw_id", "_x_extracted_at", F.col("_x_loaded_at").isNull().alias("unloaded"), "_x_data", "_x_generation_id")


def _dates(spark, d):
    """Times written in several formats and read again, durations, billing dates."""
    ts = F.col("ts").cast("timestamp")
    formats = ("%Y-%m-%dT%H:%M:%S.%fZ", "%d/%m/%Y", "%s", "%ms")
    e = table(spark, d, "events").select("event_id", ts.alias("ts"), "event_type")
    texts = [V.format_datetime("ts", f).alias(f"t{i}") for i, f in enumerate(formats)]
    back = [V.parse_datetime(f"t{i}", f).cast("timestamp_ntz").alias(f"p{i}") for i, f in enumerate(formats)]
    more = [
        V.iso_text("ts", 3).alias("iso3"), V.iso_text("ts", 6).alias("iso6"), (F.col("ts") + V.duration("P1DT2H3M4S")).cast("timestamp_ntz").alias("later"), (F.col("ts") + V.duration("P1Y2M")).cast("timestamp_ntz").alias("months"),
        V.next_billing("ts", F.when(F.col("event_type") == "view", "Yearly").otherwise("monthly")).alias("bill"), V.clamp("ts", F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).cast("timestamp_ntz").alias("clamped"),
        F.datediff(V.day_delta(5).cast("date"), F.current_date()).alias("delta"),
    ]
    return e.select("*", *texts).select("event_id", "t1", "t2", "t3", *back, *more)


def _texts(spark, d):
    """Text forms of values: joined fields, booleans, arrays, JSON, without NUL, merged maps, table names, order of cursors."""
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 5 > 0, F.col("p_name"))
    maps = V.combined(F.create_map(F.lit("a"), F.col("p_brand")), F.create_map(F.lit("b"), F.col("p_type")))
    words = F.split("p_name", " ")
    return p.select(
        "p_partkey", V.concat_fields([name, F.lit("/"), "p_brand"]).alias("joined"), V.boolean_to_string(F.col("p_size") > 20).alias("big"), V.array_to_string(words, "|").alias("words"),
        V.to_text(F.struct(F.col("p_size").cast("int").alias("s"))).alias("json"), V.without_nul(F.concat("p_brand", F.lit("\u0000"), "p_type")).alias("clean"), maps["b"].alias("b"),
        M.table_name(F.concat(F.col("p_size").cast("int").cast("string"), F.lit("-"), "p_brand")).alias("table"), F.lit(M.quoted("a`b")).alias("quoted"), F.size(M.capitalised_words("p_type")).alias("capitals"),
    )


def _labels(spark, d):
    """Names that are derived: repositories, dotted names, languages, protocols, volumes, resources."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey") % 5)
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    url = F.when(n == 0, F.concat(F.lit("https://git.example.com/own/r"), k, F.lit(".git"))).when(n == 1, F.concat(F.lit("git@example.com:own/r"), k)).when(n == 2, F.concat(F.lit("upload://u"), k)).when(n == 3, "nowhere")
    path = F.concat(F.lit("src/m/f"), k, F.when(n < 2, ".py").when(n == 2, ".java").otherwise(".txt"))
    port = F.when(n == 0, 443).when(n == 1, 5432).otherwise(F.col("p_partkey") % 5)
    spec = F.when(n == 0, F.concat(F.lit("data"), k, F.lit(":/var"))).when(n == 1, "./here:/var").otherwise("plain")
    text = F.concat(F.lit('resource "db_"'), F.lit(' "a" {}\nresource  "net" "n'), k, F.lit('" {}'))
    return p.select(
        "p_partkey", M.repo_namespace(url).alias("repo"), M.qualified_name(path, F.lit("C"), F.when(n == 2, "com.pkg")).alias("dotted"), R.language(path).alias("language"), M.protocol_of_port(port).alias("protocol"),
        M.named_volume(spec).alias("volume"), F.array_join(M.terraform_resources(text), ",").alias("resources"),
    )


def _edges(spark, d):
    """Edges of elements that import, extend, call and annotate each other, by whole, simple and squashed names."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda k: F.concat(F.lit("app.m.Class_"), k.cast("string"))
    simple = lambda k: F.concat(F.lit("Class_"), k.cast("string"))
    k = F.col("k")
    elements = s.select(
        name(k).alias("qualified_name"), F.array(name(k + 1), F.lit("os")).alias("imports"), F.array(simple(k + 2)).alias("base_classes"), F.array(simple(k), F.concat(F.lit("x.class"), (k + 3).cast("string"))).alias("method_calls"),
        F.array(name(k + 1)).alias("annotations"),
    )
    return G.structural_edges(elements)


def _checks(spark, d):
    """Tables that are there, the first format that all texts of a column have, and the start of a window of files."""
    table(spark, d, "region").createOrReplaceTempView("heddle_region_check")
    wanted = spark.createDataFrame([("HEDDLE_region_check",), ("heddle_not_there",)], "name string")
    there = Q.present_tables(wanted, "name").select(F.lower("name").alias("what"), F.col("present").cast("string").alias("answer"))
    o = table(spark, d, "orders")
    texts = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("slash"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("no").alias("mixed"))
    formats = C.datetime_formats(texts, ["day", "slash", "mixed"])
    formats = formats.select(F.explode(F.create_map(*[x for c in formats.columns for x in (F.lit(c), F.col(c))])).alias("what", "answer"))
    history = o.select(F.col("o_orderkey").cast("string").alias("uri"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_modified"))
    now = F.lit("2000-01-10").cast("timestamp_ntz")
    starts = [S.window_start(history, now, 3, full).select(F.lit(f"window {full}").alias("what"), F.date_format("window_start", "yyyy-MM-dd").alias("answer")) for full in (True, False)]
    return there.unionByName(formats).unionByName(starts[0]).unionByName(starts[1])


DATES_SQL = """
SELECT event_id, strftime(ts, '%d/%m/%Y') AS t1, floor(epoch_us(ts) / 1000000)::BIGINT::VARCHAR AS t2, floor(epoch_us(ts) / 1000)::BIGINT::VARCHAR AS t3, ts AS p0, date_trunc('day', ts) AS p1, date_trunc('second', ts) AS p2,
    date_trunc('millisecond', ts) AS p3, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso3, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso6,
    ts + INTERVAL '1 day 2 hours 3 minutes 4 seconds' AS later, ts + INTERVAL 14 MONTH AS months, CAST(ts AS DATE) + CASE WHEN event_type = 'view' THEN 365 ELSE 30 END AS bill,
    least(greatest(ts, TIMESTAMP '2024-01-10'), TIMESTAMP '2024-01-20') AS clamped, 5 AS delta
FROM events
"""

TEXTS_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_name || '/' || p_brand END AS joined, CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS big, replace(p_name, ' ', '|') AS words,
    '{"s":' || p_size::INTEGER || '}' AS json, p_brand || p_type AS clean, p_type AS b, '_' || regexp_replace(p_size::INTEGER || '-' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS table,
    '`a``b`' AS quoted, len(regexp_extract_all(p_type, '\\b([A-Z][A-Za-z0-9_]*)')) AS capitals
FROM part
"""

LABELS_SQL = """
SELECT p_partkey, CASE n WHEN 0 THEN 'own/r' || k WHEN 1 THEN 'own/r' || k WHEN 2 THEN 'upload/u' || k ELSE 'unknown' END AS repo,
    CASE n WHEN 2 THEN 'com.pkg.C' ELSE 'src.m.f' || k || '.C' END AS dotted, CASE WHEN n < 2 THEN 'Python' WHEN n = 2 THEN 'Java' END AS language,
    CASE n WHEN 0 THEN 'HTTPS' WHEN 1 THEN 'PostgreSQL' ELSE 'TCP' END AS protocol, CASE n WHEN 0 THEN 'data' || k END AS volume, 'db_.a,net.n' || k AS resources
FROM (SELECT p_partkey, p_partkey::VARCHAR AS k, p_partkey % 5 AS n FROM part)
"""

EDGES_SQL = """
WITH e AS (SELECT s_suppkey AS k, 'app.m.Class_' || s_suppkey AS name FROM supplier),
x AS (SELECT a.name AS source, b.name AS target, b.k - a.k AS step FROM e a JOIN e b ON b.k - a.k BETWEEN 1 AND 3)
SELECT source, target, 'import' AS type, 1.0::DOUBLE AS weight FROM x WHERE step = 1 UNION ALL SELECT source, target, 'inheritance', 2.0 FROM x WHERE step = 2
UNION ALL SELECT source, target, 'call', 1.5 FROM x WHERE step = 3 UNION ALL SELECT source, target, 'injection', 2.0 FROM x WHERE step = 1
"""

PLANS = {
    "csv_round_trip": Plan(_csv, "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, props, value FROM events"),
    "csv_modes": Plan(_csv_modes, """
        WITH c AS (SELECT c_custkey AS key, CASE WHEN c_nationkey > 3 THEN c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 'false' ELSE 'true' END AS good FROM customer)
        SELECT * FROM c UNION ALL SELECT count(*), NULL, CASE good WHEN 'true' THEN 'yes' ELSE 'no' END FROM c GROUP BY good"""),
    "csv_one_column": Plan(_csv_one_column, "SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders"),
    "jsonl_round_trip": Plan(_jsonl, "SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority AS tag FROM orders"),
    "lake_round_trip": Plan(_lake, """
        SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, true AS listed, count(*) AS n, round(sum(o_totalprice::DECIMAL(18, 2)), 2)::DOUBLE AS price FROM orders GROUP BY 1, 2"""),
    "table_replaced": Plan(_appended, """
        SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS date FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 4 = 0"""),
    "raw_migration": Plan(_migrated, "SELECT md5(event_id::VARCHAR) AS _x_raw_id, ts AS _x_extracted_at, true AS unloaded, props AS _x_data, 0::BIGINT AS _x_generation_id FROM events"),
    "date_formats": Plan(_dates, DATES_SQL),
    "text_forms": Plan(_texts, TEXTS_SQL),
    "derived_names": Plan(_labels, LABELS_SQL),
    "structural_edges": Plan(_edges, EDGES_SQL),
    "table_checks": Plan(_checks, """
        SELECT * FROM (VALUES ('heddle_region_check', 'true'), ('heddle_not_there', 'false'), ('day', '%Y-%m-%d'), ('slash', '%d/%m/%Y'), ('mixed', NULL)) v(what, answer)
        UNION ALL SELECT 'window True', strftime(least(min(o_orderdate), TIMESTAMP '2000-01-07'), '%Y-%m-%d') FROM orders
        UNION ALL SELECT 'window False', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders"""),
}
