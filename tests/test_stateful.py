"""Keyed stream state against plain loops, over restarts and repeated micro-batches."""

import random
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.streaming import stateful as S

KIND = "k string, ts timestamp, id long"
ZERO = datetime(2024, 1, 1, tzinfo=UTC)


def rows_of(n, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(("a", "b", "c", "", None)), ZERO + timedelta(seconds=draw.randrange(40_000)), i) for i in range(n)]
    return rows + [("a", None, n), ("b", ZERO + timedelta(seconds=5), None)]


def run(spark, rows, build, tmp_path, runs=3, crash=False):
    """Feed the rows in some runs, each started anew, and a row that ends the stream."""
    at = f"file://{tmp_path}"
    end = [("end", ZERO + timedelta(days=900), -1)]
    shuffled = random.Random(1).sample(rows, len(rows))
    stream = None
    for i in range(runs):
        part = shuffled[i::runs] + (end if i == runs - 1 else [])
        spark.createDataFrame(part, KIND).write.parquet(f"{at}/in/{i}")
        stream = build(spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(f"{at}/in"))
        S.run_stateful(stream, f"{at}/out", f"{at}/state")
        if crash:
            # The last micro-batch was written but never committed: it runs again.
            last = max((p for p in Path(tmp_path, "state/commits").glob("[0-9]*")), key=lambda p: int(p.name))
            last.unlink()
            Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
            S.run_stateful(stream, f"{at}/out", f"{at}/state")
    return [tuple(r) for r in S.batches(stream, f"{at}/out").collect() if r[0] != "end"]


def by_key(rows):
    out = {}
    for k, ts, i in rows:
        if ts is not None:
            out.setdefault(k, []).append((int(ts.timestamp() * 1_000_000), -1 if i is None else i))
    return {k: sorted(v) for k, v in out.items()}


def checkpoints(rows, most, seconds, idle):
    out = []
    for k, own in by_key(rows).items():
        number = count = 0
        since = last = own[0][0]
        for at, _ in own:
            silent = count and at - last > idle * 1_000_000
            if silent or count and most and (count >= most or seconds and at - since > seconds * 1_000_000):
                number += 1
                out.append((k, number, count, last, bool(silent)))
                count, since = 0, at
            count, last = count + 1, at
        out.append((k, number + 1, count, last, True))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("most", "seconds", "idle", "crash"), [(4, 2000, 3000, False), (0, 0, 1500, True)])
def test_checkpoints(spark, tmp_path, most, seconds, idle, crash):
    rows = rows_of(150, 2)
    got = run(spark, rows, lambda s: S.checkpoint_stream(s, "k", "ts", "id", "2 days", most, seconds, idle), tmp_path, crash=crash)
    assert order(got) == order(checkpoints(rows, most, seconds, idle))


def test_rate(spark, tmp_path):
    rows, want = rows_of(150, 3), []
    for k, own in by_key(rows).items():
        ran = []
        for at, i in own:
            ran = [t for t in ran if t > at - 3000 * 1_000_000]
            want.append((k, i, at, len(ran), len(ran) < 3))
            ran += [at] * (len(ran) < 3)
    assert {r[4] for r in want} == {True, False}
    assert order(run(spark, rows, lambda s: S.limited_stream(s, "k", "ts", "id", "2 days", 3, 3000), tmp_path, crash=True)) == order(want)


def test_intervals(spark, tmp_path):
    rows = rows_of(120, 4)
    start = F.unix_seconds("ts")
    got = run(spark, rows, lambda s: S.interval_stream(s.select("k", start.alias("a"), (start + 300).alias("b")), "k", "a", "b", 10), tmp_path, crash=True)
    last = {k: (v, [tuple(x) for x in spans]) for k, v, spans in sorted(got, key=lambda r: r[1])}
    for k, own in by_key(rows).items():
        merged = []
        for at, _ in own:
            a = at // 1_000_000
            if merged and a <= merged[-1][1] + 10:
                merged[-1] = (merged[-1][0], max(merged[-1][1], a + 300))
            else:
                merged.append((a, a + 300))
        assert last[k] == (3, merged)


def test_a_key_in_slices(spark):
    df = spark.range(300).select(F.lit("one").alias("k"), F.col("id"))
    slices = df.select(S.slice_of("k", "id", 8).alias("s")).groupBy("s").count().collect()
    assert len(slices) == 8 and sum(r["count"] for r in slices) == 300


def test_intervals_take_two_calls_of_the_state_server(monkeypatch):
    """One read and one write for a key and micro-batch, however many intervals it has."""
    calls, kept = [], {}

    class Value:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            def run(*args):
                calls.append(call)
                if call == "update":
                    kept[self.name] = args[0]
                return {"get": kept.get(self.name), "exists": self.name in kept, "iterator": iter(())}.get(call)

            return run

    class Handle:
        def getValueState(self, name, schema):
            return Value(name)

        getMapState = getValueState

    processor = S.Intervals(1)
    processor.init(Handle())
    rows = pd.DataFrame({"start": range(0, 1000, 10), "end": range(3, 1003, 10)})
    out = [next(processor.handleInputRows(("k",), iter([part]), None)) for part in (rows[::2], rows[1::2], pd.DataFrame({"start": [4], "end": [9]}))]
    assert len(calls) <= 6 and [o["version"][0] for o in out] == [1, 2, 3] and len(out[1]["spans"][0]) == 100
    assert out[2]["spans"][0][:2] == [{"start": 0, "end": 13}, {"start": 20, "end": 23}]
