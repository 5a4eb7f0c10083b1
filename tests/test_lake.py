"""Generations and change tables: crashes between any two steps, repeats, late changes."""

import random

import pytest
from pyspark.sql import types as T

from heddle.sources.folders import Folder
from heddle.sources.generations import GenerationTable
from heddle.streaming.changes import ChangeTable

KIND = "k long, v string"


class Crash(Exception):
    pass


def crashing(monkeypatch, after):
    """The file system fails before its step number ``after``."""
    steps = {"n": 0}
    for name in ("put", "delete"):
        own = getattr(Folder, name)

        def do(self, *a, own=own):
            if steps["n"] == after:
                raise Crash
            steps["n"] += 1
            return own(self, *a)

        monkeypatch.setattr(Folder, name, do)
    return steps


def frame(spark, *keys, v="x"):
    return spark.createDataFrame([(k, v) for k in keys], KIND)


def keys(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_generations(spark, tmp_path):
    t = GenerationTable(spark, f"file://{tmp_path}", KIND)
    assert keys(t.read()) == [] and t.current() is None and t.newest_whole() is None and t.unfinished() is None
    assert t.refresh([frame(spark, 1, 2), frame(spark, 3)], 5) == 0 and t.refresh([frame(spark, 9)], 5) == 0
    assert keys(t.read()) == [(1, "x"), (2, "x"), (3, "x")]
    t.write(frame(spark, 7), 6, 0)
    t.write(frame(spark, 8), 6, 0)  # the same batch again
    assert t.append(frame(spark, 10), 6) == 1 and t.unfinished() == 6 and t.batches(6) == [0, 1]
    assert [k for k, _ in keys(t.read())] == [1, 2, 3]
    with pytest.raises(ValueError, match="not whole"):
        t.publish(6)
    t.finish(6)
    assert t.publish(6) == 1 and t.publish(6) == 1 and [k for k, _ in keys(t.read())] == [8, 10]
    assert t.rollback() == 2 and t.current() == 5 and [k for k, _ in keys(t.read(1))] == [8, 10]
    t.refresh([frame(spark, 11)], 7)
    assert t.snapshots() == [(0, 5), (1, 6), (2, 5), (3, 7)] and t.clean(keep=2) == [6] and t.generations() == [5, 7]
    for bad in (lambda: t.write(frame(spark, 1), 7, 3), lambda: t.drop(7), lambda: t.rollback(99)):
        with pytest.raises(ValueError, match="finished|read|snapshot"):
            bad()


def test_transfer_goes_on_where_it_stands(spark, tmp_path, monkeypatch):
    t = GenerationTable(spark, f"file://{tmp_path}", KIND)
    for i in range(3):
        t.write(frame(spark, i), 1, i)
    t.write(frame(spark, 100), 2, 0)
    with monkeypatch.context() as m:
        crashing(m, 1)
        with pytest.raises(Crash):
            t.transfer(1, 2)
    t.transfer(1, 2)
    t.transfer(1, 2)
    assert t.batches(1) == []
    t.finish(2)
    t.publish(2)
    assert [k for k, _ in keys(t.read())] == [0, 1, 2, 100]


def test_refresh_crashes_anywhere(spark, tmp_path, monkeypatch):
    for after in range(6):
        t = GenerationTable(spark, f"file://{tmp_path}/{after}", KIND)
        t.refresh([frame(spark, 1)], 1)
        t.write(frame(spark, 50), 2, 0)  # an attempt that nobody goes on with
        with monkeypatch.context() as m:
            steps = crashing(m, after)
            try:
                t.refresh([frame(spark, 2), frame(spark, 3)], 3)
            except Crash:
                assert [k for k, _ in keys(t.read())] == [1]
            else:
                assert steps["n"] <= after
        t.refresh([frame(spark, 2), frame(spark, 3)], 3)
        assert [k for k, _ in keys(t.read())] == [2, 3] and t.generations() == [1, 3]


CHANGE = T.StructType().add("k", "long").add("at", "long").add("v", "string").add("gone", "boolean")


def table_of(spark, path, buckets=4):
    return ChangeTable(spark, f"file://{path}", CHANGE, ["k"], ["at"], "gone", buckets)


def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    draw = random.Random(3)
    changes = [(draw.choice((None, *range(12))), at, f"v{at}", draw.choice((True, False, False, None))) for at in range(120)]
    draw.shuffle(changes)  # changes of a key come out of order, in any batch
    t, known = table_of(spark, tmp_path), {}
    for n in range(6):
        batch = changes[20 * n : 20 * n + 20]
        df = spark.createDataFrame(batch, CHANGE).repartition(3)
        with monkeypatch.context() as m:
            crashing(m, 0)
            with pytest.raises(Crash):
                t.apply(df, n)
        # What was written without a manifest is not there.
        assert {r.k: r.v for r in t.read().collect()} == {k: v for k, (_, v, g) in known.items() if not g}
        assert t.apply(df, n) and not t.apply(spark.createDataFrame(changes, CHANGE), n) and not t.apply(df, n - 1)
        for k, at, v, g in batch:
            known[k] = max(known.get(k, (-1, "", False)), (at, v, bool(g)))
        assert {r.k: r.v for r in t.read().collect()} == {k: v for k, (_, v, g) in known.items() if not g}
    assert t.vacuum() is not None and {r.k for r in t.read().collect()} == {k for k, (_, _, g) in known.items() if not g}
    assert t.apply(spark.createDataFrame([(5, 1000, "late", False)], CHANGE), 6) and t.manifest()[0] == 6


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = table_of(spark, tmp_path, buckets=16)
    t.apply(spark.createDataFrame([(k, 1, "a", False) for k in range(200)], CHANGE), 0)
    t.apply(spark.createDataFrame([(7, 2, "b", False)], CHANGE), 1)
    where = t.manifest()[1]
    assert len(where) == 16 and sorted(where.values()) == [0] * 15 + [1] and len(t.folder.names("data/batch=1")) == 1
    assert t.read().where("v = 'b'").count() == 1 and t.read().count() == 200
    assert not t.read().where("k IS NULL").count() and t.apply(spark.createDataFrame([], CHANGE), 2) and t.read().count() == 200
