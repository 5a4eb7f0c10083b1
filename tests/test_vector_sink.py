"""The vector store against brute force: recall, deletions, repeated batches, flushes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.plans.registry import PLANS
from heddle.sources import vector_sink as V
from tests.conftest import SF

KIND = "id long, vector array<float>"


def vectors(n, d=10, seed=1, hearts=12):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(hearts, d)) * 3
    return [(i, [float(np.float32(x)) for x in centre[i % hearts] + draw.normal(size=d)]) for i in range(n)]


def brute(rows, q, k):
    x = np.array([v for _, v in rows], dtype=np.float64)
    way = ((x - np.array(q)) ** 2).sum(1)
    return [rows[i][0] for i in np.lexsort(([r[0] for r in rows], way))[:k]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = vectors(3000)
    df = spark.createDataFrame(rows, KIND)
    return rows, df, V.new_index(spark, f"file://{tmp_path_factory.mktemp('index')}", df)


def chunks(df):
    return df.select(F.col("id").alias("record"), F.lit(0).alias("chunk"), "vector")


@pytest.mark.parametrize("small", [False, True])
def test_recall(spark, made, tmp_path, monkeypatch, small):
    rows, df, sink = made
    if small:
        monkeypatch.setattr(V, "SHARD_ROWS", 40)
        monkeypatch.setattr(V, "QUERY_ROWS", 7)
    sink.flush(0, chunks(df))
    asked = df.where("id < 100").select(F.col("id").alias("query"), "vector")
    got = {}
    for r in V.neighbours(sink, asked, 10, 5).collect():
        got.setdefault(int(r["query"]), []).append((r["rank"], int(r["record"])))
    found = [len({n for _, n in got[i]} & set(brute(rows, rows[i][1], 10))) for i in range(100)]
    assert sum(found) >= 0.9 * 1000 and all(sorted(got[i])[0] == (1, i) for i in range(100))
    assert V.probes_for(sink, asked, 10, 0.95) <= 3 and V.probes_for(sink, asked.limit(0), 10) == len(sink.model.centres)
    # All cells: only the codes' short list can lose a neighbour.
    every = V.neighbours(sink, asked.where("query < 20"), 10, 10_000).groupBy("query").agg(F.collect_list("record").alias("r")).collect()
    assert sum(len({int(x) for x in r["r"]} & set(brute(rows, rows[int(r["query"])][1], 10))) for r in every) >= 0.98 * 200


def test_recall_of_the_query(spark):
    """On evenly spread vectors, which cells help least."""
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in PLANS["vector_neighbours"].run(spark, SF).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    assert set(got) == {i for i, _ in rows}
    hit = [len(got[i] & set(brute([r for r in rows if r[0] != i], v, 10))) for i, v in rows]
    assert sum(hit) >= 0.9 * 10 * len(rows)


def test_batches_deletions_and_repeats(spark, made, tmp_path):
    rows, df, _ = made
    sink = V.new_index(spark, f"file://{tmp_path}", df)
    names = lambda: sorted((int(r.record), r.chunk, r.batch) for r in sink.live().select("record", "chunk", "batch").collect())
    assert names() == []
    some = df.where("id < 6")
    assert sink.flush(0, chunks(some)) and not sink.flush(0, chunks(df))
    assert names() == [(i, 0, 0) for i in range(6)]
    again = chunks(some.where("id IN (1, 2)"))
    assert sink.flush(3, again.unionByName(again.withColumn("chunk", F.lit(1))), some.where("id = 5").select(F.col("id").alias("record")))
    want = [(0, 0, 0), (1, 0, 3), (1, 1, 3), (2, 0, 3), (2, 1, 3), (3, 0, 0), (4, 0, 0)]
    assert names() == want
    # What a crash leaves before the ledger is written is not there, and a repeat replaces it.
    chunks(df).write.mode("overwrite").parquet(f"{sink.path}/chunks/batch=4/cell=0")
    assert names() == want
    sink.compact()
    assert names() == [(a, b, 3) for a, b, _ in want] and sink.batches() == [3] and not sink.flush(2, chunks(df))
    assert sink.flush(4, chunks(some.where("id = 5")), some.where("id = 0").select(F.col("id").alias("record")))
    assert [n[0] for n in names()] == [1, 1, 2, 2, 3, 4, 5]
    sink.compact()
    assert [n[0] for n in names()] == [1, 1, 2, 2, 3, 4, 5] and sink.batches() == [4]


def test_flush_on_states_and_size(spark, made, tmp_path):
    rows, df, _ = made
    sink = V.new_index(spark, f"file://{tmp_path}", df)
    kinds = ["RECORD"] * 5 + ["STATE"] + ["RECORD"] * 2 + ["STATE", "STATE", "DELETE"] + ["RECORD"] * 7
    records = [str(i % 6) for i in range(len(kinds))]
    rows = [(i, k, None if k == "STATE" else r, 0, rows[i][1] if k == "RECORD" else None) for i, (k, r) in enumerate(zip(kinds, records, strict=True))]
    messages = spark.createDataFrame(rows, "at long, kind string, record string, chunk long, vector array<float>").repartition(3)
    # Batches: five records as three and two, two records, then eight messages as three, three and two.
    run, place, want = 0, 0, {}
    for at, kind, *_ in rows:
        if kind == "STATE":
            run, place = run + 1, 0
        else:
            want[at] = run * (1 << 20) + place // 3
            place += 1
    assert {r["at"]: r["batch"] for r in V._batched(messages, 3).collect()} == want
    assert V.load(sink, messages, 3) == sorted(set(want.values())) and V.load(sink, messages, 3) == []
    live = {r["record"]: r["batch"] for r in sink.live().collect()}
    last = {}
    for at, kind, record, *_ in rows:
        if kind == "RECORD":
            last[record] = want[at]
        elif kind == "DELETE":
            last.pop(record, None)
    assert live == last


def test_odd_rows(spark, made, tmp_path):
    odd = spark.createDataFrame([(1, None), (None, [1.0] * 10), (2, [1.0] * 9 + [None]), (3, [float("nan")] * 10), (4, [1.0] * 3), (5, [1.0] * 10), (6, [])], KIND)
    assert sorted(r.id for r in V.sound(odd, "id", "vector").collect()) == [4, 5, 6]
    with pytest.raises(ValueError, match="no vectors"):
        V.fit(spark, odd.limit(0), f"file://{tmp_path}/none")
    sink = V.new_index(spark, f"file://{tmp_path}", made[1])
    sink.flush(0, chunks(V.sound(odd, "id", "vector")))
    assert [r.record for r in sink.live().collect()] == ["5"]
    near = V.neighbours(sink, V.sound(odd, "id", "vector").select(F.col("id").alias("query"), "vector"), 3, 100)
    assert [(r["query"], r["rank"], r["record"], r["distance"]) for r in near.collect()] == [("5", 1, "5", 0.0)]


def test_least():
    way = np.array([[3.0, 1.0, 2.0, 1.0, 1.0], [np.inf, 5.0, np.inf, 4.0, np.inf], [2.0, 2.0, 2.0, 2.0, 1.0]])
    top, there = V._least(way, 3)
    assert top.tolist() == [[1, 3, 4], [0, 1, 3], [0, 1, 4]] and there.tolist() == [[True] * 3, [False, True, True], [True] * 3]


def test_vectors_are_not_sent_for_each_cell(spark, made, tmp_path):
    """Rows that meet follow the grid, not the number of cells that are searched; a list has no more rows than it is asked for."""
    rows, df, _ = made
    sink = V.new_index(spark, f"file://{tmp_path}", df)
    sink.flush(0, chunks(df))
    asked = df.select(F.col("id").alias("query"), "vector")
    for probes in (1, len(sink.model.centres)):
        near = V.neighbours(sink, asked, 10, probes)
        near.collect()
        written = []

        def walk(plan):
            if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                plan = plan.executedPlan()
            if plan.getClass().getSimpleName().endswith("QueryStageExec"):
                plan = plan.plan()
            if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
                written.append(plan.metrics().apply("shuffleRecordsWritten").value())
            for i in range(plan.children().size()):
                walk(plan.children().apply(i))

        walk(near._jdf.queryExecution().executedPlan())
        shards, blocks = V.grid(3000, 3000, 10, 2 * spark.sparkContext.defaultParallelism)
        assert (shards, blocks) == (1, 1) and len(written) == 3 and max(written) <= 10 * 3000


def test_grid():
    assert V.grid(0, 0, 64, 24) == (1, 1) and V.grid(10_000, 10_000, 64, 24) == (1, 2)
    # From 0.1 to 0.6 million rows, a vector is sent the same number of times, and no side is larger than it may be.
    for n in (50_000, 100_000, 390_000):
        assert V.grid(n, n, 64, 24) == (3, 8)
    for n, d in ((4_000_000, 64), (200_000, 1536)):
        shards, blocks = V.grid(n, n, d, 24)
        assert max(n / shards, n / blocks) * 4 * d <= V.SIDE_BYTES


def test_copies_come_by_record(spark, tmp_path):
    """Of more copies than a short list holds, those of the smallest records are the neighbours, whatever the order of rows."""
    df = spark.createDataFrame(vectors(300) + [(1000 + i, [1.0] * 10) for i in range(400)], KIND).repartition(7)
    sink = V.new_index(spark, f"file://{tmp_path}", df)
    sink.flush(0, chunks(df))
    near = V.neighbours(sink, df.where("id IN (1000, 1399)").select(F.col("id").alias("query"), "vector"), 5, 3).collect()
    assert sorted((r["query"], r["rank"], r["record"]) for r in near) == [(q, i + 1, str(1000 + i)) for q in ("1000", "1399") for i in range(5)]
