"""Operators on small frames with nulls, ties and repeats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators import analytics as A
from heddle.operators import classify as C
from heddle.operators import graph as G
from heddle.operators import history as H
from heddle.operators import normalize as N
from heddle.operators import quality as Q
from heddle.operators import records as R
from heddle.operators import state as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scd2_has_one_active_row_and_closes_versions(spark):
    df = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, None, 3), (2, 5, 1)], "k int, c int, e int")
    out = H.scd2(df, H.StreamConfig(("k",), "c", "e"))
    assert rows(out.select("k", "c", "end_at", "active_row")) == rows(spark.createDataFrame([(1, 20, None, 1), (1, 10, 20, 0), (1, None, 10, 0), (2, 5, None, 1)], "k int, c int, end_at int, active_row int"))


def test_float_keys_compare_as_text(spark):
    df = spark.createDataFrame([(1.5, 1, 1), (1.5, 2, 2)], "k double, c int, e int")
    out = H.scd2(df, H.StreamConfig(("k",), "c", "e", text_keys=("k",)))
    assert out.where("active_row = 1").count() == 1


def test_deletes_leave_no_active_row(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 2)], "k int, c int, d int")
    out = H.scd2(df, H.StreamConfig(("k",), "c", "c", deleted="d"))
    assert H.active_rows(out).count() == 0


def test_incremental_on_empty_target_takes_all(spark):
    df = spark.createDataFrame([(1,), (None,)], "c int")
    assert H.newer_than(df, "c", df.limit(0), "c").count() == 2
    assert rows(H.newer_than(df, "c", df, "c")) == [(None,)]


def test_upsert_with_new_columns(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 9)], "k int, v string, w int")
    assert rows(H.upserted(old, new, ["k"])) == [(1, "a", None), (2, "c", 9)]


def test_extract_takes_odd_keys(spark):
    df = spark.createDataFrame([('{"a b": 1, "x.y": "z", "q`": {"n": 2}}',), (None,), ("broken",)], "j string")
    out = rows(N.extracted(df, "j", ["a b", "x.y", "q`"]))
    assert ("1", "z", '{"n":2}') in out and out.count((None, None, None)) == 2


def test_typed_nulls_what_cannot_be_cast(spark):
    df = spark.createDataFrame([("7", ""), ("x", "2024-01-01"), (None, None)], "n string, d string")
    out = N.typed(df, {"properties": {"n": {"type": "integer"}, "d": {"type": "string", "format": "date"}}})
    assert rows(out) == rows(spark.createDataFrame([(7, None), (None, dt.date(2024, 1, 1)), (None, None)], "n long, d date"))


def test_unnest_drops_parents_without_array(spark):
    df = spark.createDataFrame([(1, "[1,2]"), (2, None), (3, "[]"), (4, "{}")], "id int, a string")
    assert {r.id for r in N.unnested(df, "a", T.LongType(), ["id"]).where("item IS NOT NULL").collect()} == {1}


def test_records_at_wildcards(spark):
    df = spark.createDataFrame([('{"a":[{"b":{"x":1}},{"b":{"x":2}}]}',), ('{"a":[]}',), (None,)], "j string")
    got = R.records_at(df, "j", ["a", "*", "b"], T.StructType([T.StructField("x", T.LongType())]))
    assert rows(got.select("record.x")) == [(1,), (2,)]


@pytest.mark.parametrize(("text", "want"), [
    ("{{ record.a + 1 == 3 }}", True), ("{{ not (record.a > 5) and record.s | upper == 'X' }}", True), ("{{ config.t }}-{{ record.a }}", "v-2"), ("{{ record.s | hash('sha1') }}", "11f6ad8ec52a2984abaafd7c3b516503785c2072"),
])
def test_templates(spark, text, want):
    df = spark.createDataFrame([(2, "x")], "a int, s string")
    assert df.select(R.template(text, values={"config": {"t": "v"}})).first()[0] == want


def test_template_errors():
    with pytest.raises(ValueError):
        R._Parser("a ? b", None, {}).parse()


def test_remove_and_add_fields(spark):
    df = spark.createDataFrame([((1, 2), 3)], "s struct<a int, b int>, t int")
    out = R.remove_fields(R.add_fields(df, {"s.c": F.lit(9)}), ["s.a", "gone", "t"])
    assert out.schema.simpleString() == "struct<s:struct<b:int,c:int>>"


def test_intervals_touching_merge(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 8), ("b", 2, 2)], "g string, s int, e int")
    assert rows(S.merged_intervals(df, ["g"], "s", "e")) == [("a", 1, 5), ("a", 7, 8), ("b", 2, 2)]


def test_file_history_full(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9), ("d", 5)], "uri string, last_modified int")
    history = spark.createDataFrame([("b", 5), ("c", 8)], "uri string, last_modified int")
    assert {r.uri for r in S.files_to_sync(listing, history, True, 5).collect()} == {"c", "d"}
    assert {r.uri for r in S.files_to_sync(listing, history, False, None).collect()} == {"a", "c", "d"}


def test_contributors_keep_first_email_and_busiest_name(spark):
    df = spark.createDataFrame([("Ann", "A@x", 1, 1), ("Anna", "a@x", 5, 2), ("Bob", None, 2, 3)], "name string, email string, commits long, place int")
    assert rows(A.contributors(df, "name", "email", "commits", "place").select("name", "email", "commits")) == [("Anna", "A@x", 6), ("Bob", None, 2)]


def test_bots(spark):
    df = spark.createDataFrame([("x[bot]", None), ("Ann", "noreply@x"), ("Ann", "ann@x"), (None, None)], "n string, e string")
    assert [r[0] for r in df.select(A.is_bot(F.col("n"), F.col("e"))).collect()] == [True, True, False, False]


def test_bus_factor(spark):
    df = spark.createDataFrame([("r", "a", 5), ("r", "b", 4), ("r", "c", 1), ("q", "a", 1), ("q", "b", 1), ("q", "c", 1)], "g string, p string, n int")
    assert dict(rows(A.bus_factor(df, ["g"], "p", "n"))) == {"r": 1, "q": 2}


def test_fraud_score(spark):
    df = spark.createDataFrame([(6000.0, 4, 6, True), (1.0, 0, 0, False), (None, None, None, None)], "a double, d int, t int, x boolean")
    assert [r[0] for r in df.select(A.fraud_score(*[F.col(c) for c in "adtx"])).collect()] == [0.99, 0.15, 0.15]


def test_grep_counts_lines(spark):
    df = spark.createDataFrame([(1, "one\ntwo needle here\n"), (2, None)], "id int, t string")
    assert rows(C.grep(df, ["id"], "t", "needle", 4)) == [(1, 2, "two needle her")]


def test_majority_takes_first_seen_on_ties(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2)], "g string, v string, p int")
    assert rows(C.majority(df, ["g"], "v", "p")) == [("g", "b")]


def test_filter_reason_takes_the_first(spark):
    df = spark.createDataFrame([("x_pb2.py", 9, 0, True), ("a.py", 9, 1, True), ("a.py", 1, 5, True), ("a.py", None, None, None)], "p string, f int, m int, s boolean")
    got = [r[0] for r in df.select(C.filter_reason(F.col("p"), F.col("f"), F.col("m"), F.col("s"), r"_pb2\.py$")).collect()]
    assert got == ["generated code", "data-only class", "all-static utility class", ""]


def test_ambiguous_simple_name_blocks_the_squashed_one(spark):
    elements = spark.createDataFrame([("a.Foo",), ("b.Foo",), ("c.my_bar",)], "n string")
    tokens = spark.createDataFrame([("Foo",), ("MyBar",), ("a.Foo",), ("none",)], "t string")
    assert rows(G.resolved(tokens, elements, "t", "n")) == [("MyBar", "c.my_bar"), ("a.Foo", "a.Foo")]


def test_structural_edges(spark):
    df = spark.createDataFrame([("a.X", ["b.Y", "b.Y"], ["Y"], [], []), ("b.Y", [], [], ["Y"], None)], "qualified_name string, imports array<string>, base_classes array<string>, method_calls array<string>, annotations array<string>")
    assert rows(G.structural_edges(df)) == [("a.X", "b.Y", "import", 1.0), ("a.X", "b.Y", "inheritance", 2.0)]


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("weight"))
    assert {r.component for r in G.weak_components(e).collect()} == {0}


def test_two_clusters_split():
    e = [("a", "b", 2.0), ("b", "c", 2.0), ("a", "c", 2.0), ("d", "e", 2.0), ("e", "f", 2.0), ("d", "f", 2.0), ("c", "d", 0.1)]
    part = G.louvain(e)
    assert part["a"] == part["b"] == part["c"] != part["d"] == part["e"] == part["f"]


def test_singletons_join_and_large_ones_split():
    part = G.refined({"a": 0, "b": 0, "z": 1}, [("a", "b", 1.0), ("a", "z", 0.5)])
    assert len(set(part.values())) == 1
    chain = [(f"{s}{i}", f"{s}{i + 1}", 1.0) for s in "xy" for i in range(9)] + [("x9", "y0", 0.1)]
    part = G.refined(dict.fromkeys({v for e in chain for v in e[:2]}, 0), chain, 15)
    assert len(set(part.values())) >= 2


def test_node_upsert_keeps_other_properties(spark):
    old = spark.createDataFrame([("n", {"a": "1", "b": "2"})], "id string, props map<string,string>")
    new = spark.createDataFrame([("n", {"a": "9"}), ("m", {"c": "3"})], "id string, props map<string,string>")
    assert {r.id: r.props for r in G.upserted_nodes(old, new).collect()} == {"n": {"a": "9", "b": "2"}, "m": {"c": "3"}}


def test_equality_metric(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert Q.equality_metric(a, a).first()[0] == 0
    assert Q.equality_metric(a, a.where("k = 1")).first()[0] == 2


def test_raw_layouts(spark):
    v1 = spark.createDataFrame([("i", dt.datetime(2024, 1, 1), "{}")], "x_ab_id string, x_emitted_at timestamp, x_data string")
    v2 = N.migrated_raw(v1, "x_")
    assert v2.columns == ["x_raw_id", "x_extracted_at", "x_loaded_at", "x_data", "x_meta", "x_generation_id"]
    assert H.soft_reset(v2, "x_loaded_at").where("x_loaded_at IS NULL").count() == 1
