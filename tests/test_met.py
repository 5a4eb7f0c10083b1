"""Joins of few keys with many rows, and sums of edges, in tasks whose share is bounded."""

from pyspark.sql import functions as F

from heddle.operators import graph as G
from heddle.plans import graphs
from heddle.session import cut
from tests.conftest import SF


def parts(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count()


def test_edges_of_a_hot_directory_and_of_repeated_names(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 8)
    monkeypatch.setattr(G, "TASK_PAIRS", 500)
    # 60 directories below one, the names of every fifth twice; two spellings of a directory.
    rows = [(f"n{i % 60 if i % 5 else 0}", f"/top/d{i % 60}/x{i}", i) for i in range(120)] + [("a", "/top//d1/y", 0), ("b", "/top/z", 1), (None, "/top/q", 2), ("c", None, 3)]
    df = spark.createDataFrame(rows, "name string, path string, place int")
    out = G.directory_edges(df, "name", "path", "place")
    where = {(n, tuple(x for x in p.split("/")[:-1] if x)) for n, p, _ in rows if n and p}
    want = set()
    for a, p in where:
        for b, q in where:
            same = next((i for i, (x, y) in enumerate(zip(p, q)) if x != y), min(len(p), len(q)))
            steps = len(p) + len(q) - 2 * same
            if a != b and steps <= 2:
                want.add((a, b, "directory", G.DIRECTORY_WEIGHTS[steps]))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 8)
    monkeypatch.setattr(G, "TASK_PAIRS", 500)
    rows = [(i, 1) for i in range(100)] + [(3, 1), (1, 2), (2, 2), (5, 3), (None, 1), (7, None)]
    out = G.shared_values(spark.createDataFrame(rows, "o long, v int"), "o", "v")
    assert parts(out).agg(F.max("count")).first()[0] < 2000
    assert sorted(map(tuple, out.collect())) == sorted([(a, b, 1) for b in range(100) for a in range(b)] + [(1, 2, 2)])


def test_blocks_are_dealt_out_by_several_tasks(spark, monkeypatch):
    """Rows of one file, each sent to many blocks, are dealt by tasks that follow the number of pairs."""
    for name, n in (("BLOCK_ROWS", 4), ("TASK_PAIRS", 500), ("DEALT_TASKS", 16)):
        monkeypatch.setattr(G, name, n)
    rows = cut(spark.range(300).selectExpr("id AS o", "1 AS v").coalesce(1))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        all_of = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [all_of.apply(i) for i in range(all_of.size())]

    seen = {s.stageId() for s in stages()}
    assert G.shared_values(rows, "o", "v").count() == 300 * 299 // 2
    # 300 rows for 75 blocks of the other side.
    dealt = [s for s in stages() if s.stageId() not in seen and s.shuffleWriteRecords() == 300 * 75]
    assert dealt and all(s.numTasks() == 180 // 16 + 1 for s in dealt)


def test_sums_of_edges_fill_no_task_before_their_shuffle(spark):
    """A sum before the shuffle would hold all pairs of a task's orders; tasks follow the number of lines."""
    out = graphs._edges(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sum(" in plan and "sum(" not in plan[plan.index("Exchange") :]


def test_components_from_few_edges(spark):
    """Paths, a star and edges that only a pass over all edges finds: 4-5 is neither the least nor the largest of a vertex."""
    edges = [(9, 4), (9, 1), (9, 7), (9, 8), (4, 2), (3, 4), (4, 4), (6, 6), (None, 1)] + [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(70, 80)]
    rows = [(a, b, 1.0) for a, b in edges]
    df = spark.createDataFrame(rows, "source long, target long, weight double")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in G.weak_components(df).collect() if r.id is not None}
    assert got == {v: find(v) for v in root}
