"""Readers, sinks, paged sources and streams, there and back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heddle.sources import files, sinks, tables
from heddle.streaming import streams


def test_csv_modes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('note\nx;y\n1;NA\n"a;b";yes\n')
    fmt = files.CsvFormat(delimiter=";", skip_before_header=1, null_values=("NA",), true_values=("yes",))
    assert [tuple(r) for r in files.read_csv(spark, str(p), fmt).collect()] == [("1", None), ("a;b", "true")]
    auto = files.read_csv(spark, str(p), files.CsvFormat(delimiter=";", header="auto", skip_before_header=2))
    assert auto.columns == ["f0", "f1"]


def test_jsonl_and_parquet(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    assert files.read(spark, "jsonl", str(tmp_path / "a.jsonl")).columns == ["a", "b"]
    spark.range(2).select(F.lit(1.5).cast("decimal(5,2)").alias("d")).write.parquet(str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).dtypes == [("d", "string")]
    assert files.read_parquet(spark, str(tmp_path / "p"), True).dtypes == [("d", "double")]
    with pytest.raises(ValueError):
        files.read(spark, "tar", "x")


def test_listing_and_source_texts(spark, tmp_path):
    for name in ("a/b.py", "a/tests/c.py", "node_modules/d.js", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert files.listing(spark, str(tmp_path), "*.py", depth=2).count() == 1
    out = files.source_texts(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language) for r in out] == [("b.py", "Python")]


def test_shortlog(spark):
    df = spark.createDataFrame([("   12\tAnn B <ann@x>",), ("junk",)], "value string")
    assert [tuple(r) for r in files.shortlog(df).collect()] == [(12, "Ann B", "ann@x")]


def test_paged_source_stops(spark):
    def fetch(part, offset, size):
        return [(part, i) for i in range(offset, min(offset + size, 25))]

    spark.dataSource.register(tables.paged_source("pages_test", "part string, i int", fetch, ("a", "b"), 10, lambda r: r[0] == "b" and r[1] > 3))
    got = spark.read.format("pages_test").load().groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"a": 25, "b": 4}


def test_slice_product_first_wins(spark):
    a, b = tables.list_slices(spark, "x", ["1", "2"]), tables.list_slices(spark, "x", ["3"]).withColumn("y", F.lit("z"))
    assert sorted(tuple(r) for r in tables.slice_product(a, b).collect()) == [("1", "z"), ("2", "z")]


def test_generators(spark):
    assert tables.speed_records(spark, 5).count() == 5
    per = {r.user_id: r["count"] for r in tables.purchases(spark, 20, 3).groupBy("user_id").count().collect()}
    assert per == {u: u % 10 - 4 for u in range(1, 21) if u % 10 > 4}
    assert tables.users(spark, 3).count() == tables.products(spark, 3).count() == 3


def test_csv_sink_sorts_and_fills(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"k": "v"})], "id int, z string, a map<string,string>")
    assert [tuple(r) for r in sinks.flattened(df, ["id"]).collect()] == [("1", '{"k":"v"}', "")]
    sinks.write_csv(df, str(tmp_path / "c"), ["id"], compression="gzip")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["id", "a", "z"]
    assert sinks.unflattened(df, ["id"]).columns == ["id", "data"]


@pytest.mark.parametrize("layout", list(sinks.LAYOUTS))
def test_lake_layouts(spark, tmp_path, layout):
    df = spark.createDataFrame([(1, dt.datetime(2024, 2, 3)), (2, None)], "id int, t timestamp")
    at = str(tmp_path / "lake")
    sinks.write_lake(df, at, "t", layout, codec="ZSTD")
    assert spark.read.parquet(at).count() == 2


def test_overwrite_swaps(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in (3, 2):
        sinks.overwrite(spark.range(n), at)
    assert spark.read.parquet(at).count() == 2


def test_file_name():
    now = dt.datetime(2024, 2, 3, tzinfo=dt.UTC)
    assert sinks.file_name("{date}-{date:yyyy}-{sync_id}-{part_number}{format_extension}", now, 7, 1, ".csv") == "2024_02_03-2024-7-1.csv"


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, t string")
    got = sinks.split_documents(df, ["id"], "t", 4, 1).orderBy("id", "chunk_no").collect()
    assert [r.chunk for r in got if r.id == 1] == ["abcd", "defg", "ghij"]
    assert [r.chunk for r in got if r.id != 1] == ["", ""]


def test_streamed_changes_equal_a_batch(spark, tmp_path):
    rows = [(1, 1, "a", None), (2, 1, "b", None), (1, 2, "c", None), (2, 3, None, 3)]
    spark.createDataFrame(rows, "k int, ts int, v string, deleted int").repartition(2).write.parquet(str(tmp_path / "in"))
    kind = "k int, ts int, v string, deleted int"
    state = {"t": spark.createDataFrame([], kind)}

    def merge(batch, _):
        state["t"] = spark.createDataFrame(streams.apply_changes(state["t"], batch, ["k"], ["ts"], "deleted").collect(), kind)

    streams.each_batch(streams.file_stream(spark, str(tmp_path / "in"), kind, files_per_trigger=10), merge, str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in state["t"].collect()] == [(1, 2, "c", None)]


def test_windows_and_repeats_in_streams(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 1)), (1, dt.datetime(2024, 1, 1, 0, 2)), (2, dt.datetime(2024, 1, 1, 0, 7))]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "k int, ts timestamp", files_per_trigger=10)
    streams.run_available(streams.once_each(stream, ["k"], "ts", "1 hour"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    q = streams.windowed_counts(stream, "ts", "5 minutes", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
