"""Ways through pages, resumable pages, named steps, existence checks, checkpoints in ranges."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import analytics, quality, records, state
from heddle.sources import tables
from heddle.streaming import streams


def test_pages_by_number_and_by_token(spark):
    def numbered(part, page, size):
        return [(i,) for i in range(page * size, min(page * size + size, 25))]

    def by_name(part, token, size):
        at = int(token or 0)
        return [(i, str(at + size) if at + size < 25 else None) for i in range(at, min(at + size, 25))]

    spark.dataSource.register(tables.paged_source("by_page_test", "i int", numbered, size=10, advance=tables.by_page(10)))
    spark.dataSource.register(tables.paged_source("by_token_test", "i int, next string", by_name, size=10, advance=tables.by_token(lambda p: p[-1][1]), begin=None))
    for name in ("by_page_test", "by_token_test"):
        assert sorted(r.i for r in spark.read.format(name).load().collect()) == list(range(25))


def test_paged_stream_goes_on(spark, tmp_path):
    count = tmp_path / "pages"

    def pages():
        return int(count.read_text())

    spark.dataSource.register(tables.paged_stream("paged_stream_test", "i int", lambda p: [(10 * p + k,) for k in range(10)], pages))
    for n in (2, 5):
        count.write_text(str(n))
        streams.run_available(spark.readStream.format("paged_stream_test").load(), str(tmp_path / "out"), str(tmp_path / "state"))
        assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10 * n))


def test_named_steps(spark):
    @records.step("test doubled")
    def doubled(df, column):
        return df.withColumn(column, F.col(column) * 2)

    df = spark.createDataFrame([(1,)], "a long")
    assert records.applied(df, [{"type": "test doubled", "column": "a"}] * 2).first().a == 4
    with pytest.raises(ValueError):
        records.applied(df, [{"type": "no such"}])
    with pytest.raises(ValueError):
        records.step("test doubled")(lambda df: df)


def test_present_tables(spark):
    spark.range(1).createOrReplaceTempView("Here_It_Is")
    wanted = spark.createDataFrame([("here_it_is",), ("HERE_IT_IS",), ("gone",), (None,)], "name string")
    assert {r["name"]: r.present for r in quality.present_tables(wanted, "name").collect()} == {"here_it_is": True, "HERE_IT_IS": True, "gone": False, None: False}


def test_checkpoints_of_hot_and_null_groups(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("g"))
    got = state.checkpoints(df, ["g"], ["id"], 7).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.id):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert (r.place, r.checkpoint) == (seen[r.g], (seen[r.g] - 1) // 7)
    assert len(got) == 1000
    assert state.checkpoints(df.where("false"), ["g"], ["id"], 7).count() == 0


def test_event_timings_order(spark):
    df = spark.sql("SELECT * FROM VALUES ('b', TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02'), ('a', TIMESTAMP'2024-01-01', NULL) AS t(n, s, e)")
    assert [r.name for r in analytics.event_timings(df, "n", "s", "e").collect()] == ["a", "b"]
    assert [tuple(r) for r in analytics.event_timings(df, "n", "s", "e", "duration").collect()] == [("b", 86_400_000_000), ("a", None)]
