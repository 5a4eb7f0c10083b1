"""Communities by distributed rounds against the local solver and planted groups; components against union-find."""

import random

from pyspark.sql import functions as F

from heddle.operators import communities as C
from heddle.operators import graph as G
from heddle.plans.registry import PLANS
from heddle.session import cut
from tests.conftest import SF

KIND = "source string, target string, weight double"


def planted(groups, size, inside, across, seed=1):
    draw = random.Random(seed)
    names = [[f"g{g}v{i:02}" for i in range(size)] for g in range(groups)]
    out = [(a, b, 1.0) for own in names for i, a in enumerate(own) for b in own[:i] if draw.random() < inside]
    every = [v for own in names for v in own]
    return out + [(a, b, 1.0) for a in every for b in every if a < b and a[:2] != b[:2] and draw.random() < across]


def clique(name, n):
    return [(f"{name}{i}", f"{name}{j}", 1.0) for i in range(n) for j in range(i)]


def groups_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.community, set()).add(r.id)
    assert all(name in members for name, members in out.items())
    return sorted(map(sorted, out.values()))


def test_two_cliques_and_odd_rows(spark):
    edges = [*clique("a", 5), *clique("b", 5), ("a0", "b0", 1.0), ("solo", "solo", 2.0), ("x", "y", 1.0), ("y", "x", 1.0), (None, "a1", 1.0), ("z", None, 1.0), ("w", "v", 0.0)]
    got = groups_of(C.moved_communities(spark.createDataFrame(edges, KIND)))
    assert got == [sorted(f"a{i}" for i in range(5)), sorted(f"b{i}" for i in range(5)), ["solo"], ["x", "y"]]
    assert C.moved_communities(spark.createDataFrame([], KIND)).count() == 0


def test_modularity_as_the_local_solver(spark):
    rows = planted(5, 14, 0.5, 0.02)
    edges = spark.createDataFrame(rows, KIND).repartition(3)
    found = C.moved_communities(edges)
    local = spark.createDataFrame(list(G.louvain(sorted(rows)).items()), "id string, community int")
    mine, theirs = C.modularity(edges, found), C.modularity(edges, local)
    assert mine >= 0.93 * theirs > 0.3


def test_co_purchases(spark):
    edges = [(r.source, r.target) for r in PLANS["co_purchase_edges"].run(spark, SF).collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in root}
    assert {r.id: r.component for r in PLANS["co_purchase_components"].run(spark, SF).collect()} == want
    parts = {r.id: r.community for r in PLANS["co_purchase_communities"].run(spark, SF).collect()}
    assert set(parts) == set(want) and all(want[i] == want[c] for i, c in parts.items()) and 1 < len(set(parts.values())) < len(parts)


def test_cuts_have_their_true_size(spark):
    """Estimates of joins are products: over rounds of joins that are cut they must not grow."""
    df = spark.range(20)
    for _ in range(6):
        df = cut(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert df.count() == 20 and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def starry(seed=3):
    """Two hubs over planted groups; edges that come twice, weights that cancel, rows without ends or weights."""
    rows = planted(6, 12, 0.5, 0.03, seed)
    names = sorted({v for a, b, _ in rows for v in (a, b)})
    rows += [("hub", v, 0.5) for v in names] + [(v, "g0v00", 0.25) for v in names[1:]]
    rows += [("gone", "g1v01", 2.0), ("g1v01", "gone", -2.0), ("hub", "hub", 1.0), ("solo", "solo", 1.0), ("g1v01", "g1v02", 3.0), ("g1v02", "g1v01", -1.0)]
    return rows + [(None, "hub", 1.0), ("hub", None, 1.0), ("hub", "null", None)]


def test_blocks_and_hubs_change_nothing(spark, monkeypatch):
    """A vertex with many edges is dealt to several blocks, those of a few edges are one."""
    edges = spark.createDataFrame(starry(), KIND).repartition(3)
    want = {r.id: r.community for r in C.moved_communities(edges, rounds=3, levels=2).collect()}
    assert "gone" not in want and "null" not in want and want["solo"] == "solo" and {"hub", "g0v00"} <= set(want)
    for name, n in (("BLOCK_EDGES", 64), ("LEAST_EDGES", 16), ("ROW_EDGES", 7), ("HUB_EDGES", 20)):
        monkeypatch.setattr(C, name, n)
    seen, level = [], C._level
    monkeypatch.setattr(C, "_level", lambda *a: seen.append(level(*a)) or seen[-1])
    assert {r.id: r.community for r in C.moved_communities(edges, rounds=3, levels=2).collect()} == want
    assert seen[0][2] >= 16 and len(seen[0][3][0]) >= 2 and len(seen) > 1


def test_shared_groups_are_their_pairs(spark, monkeypatch):
    """Members that share a group, paired where they are dealt, against the pairs as edges; ids of several kinds."""
    draw = random.Random(5)
    rows = [(g, (g % 5) * 10 + draw.randrange(12)) for g in range(300) for _ in range(draw.choice((1, 2, 3, 9)))]
    rows += [rows[0], rows[0], (None, 3), (7, None), *[(1000, m) for m in range(40)]]
    df = spark.createDataFrame(rows, "g long, m long").repartition(5)
    own = df.where("g IS NOT NULL AND m IS NOT NULL").distinct()
    pairs = own.selectExpr("g", "m AS source").join(own.selectExpr("g", "m AS target"), "g").where("source < target").selectExpr("source", "target", "1.0D AS weight")
    want = {r.id: r.community for r in C.moved_communities(pairs, rounds=2, levels=2).collect()}
    assert len(want) > 40 and 1 < len(set(want.values())) < len(want)
    monkeypatch.setattr(C, "PAIR_ROWS", 5)
    monkeypatch.setattr(C, "BLOCK_EDGES", 1000)
    got = C.shared_communities(df, "g", "m", 3, rounds=2, levels=2)
    assert {r.id: r.community for r in got.collect()} == want and got.schema == df.selectExpr("m AS id", "m AS community").schema
    named = C.shared_communities(df.selectExpr("g", "concat('p', m) AS m"), "g", "m", 3, rounds=2, levels=2)
    assert {r.id for r in named.collect()} == {f"p{i}" for i in want}


def test_rounds_shuffle_no_row_for_an_edge(spark):
    """Edges go as arrays: rows that are shuffled follow the vertices and the rounds, not the edges."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    draw = random.Random(6)
    rows = [(a, b, 1.0) for a in range(400) for b in range(a) if draw.random() < (0.8 if a % 4 == b % 4 else 0.2)]
    edges = cut(spark.createDataFrame(rows, "source long, target long, weight double"))

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert len({r.community for r in C.moved_communities(edges, rounds=3, levels=2).collect()}) > 1
    assert shuffled() - before < len(rows) * 2
