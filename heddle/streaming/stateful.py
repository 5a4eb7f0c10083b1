"""Keyed stream state: checkpoints by count or time, intervals that complete out of order, sliding rate limits.

Rows of a key wait in list state until the watermark has passed them; a timer then takes them in the order of event time,
so what comes out does not depend on how rows were cut into micro-batches or on restarts. What is kept for a key is its
waiting rows and a bounded memory: a count and a cursor, merged intervals, or the times inside one window.

A key's state lives in one task. Keys are meant to be many (users, slices of a stream); where one key holds most rows, its
slices are keys of their own (``slice_of``), as a source's partitions are, and their checkpoints stand side by side.

Times are microseconds in state, event-time timestamps in the streams. Rows without a time are dropped, and rows
later than the watermark are dropped by Spark. Null keys are a key, a null id is -1. Rows of the same time go by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows (at, id) of a key in the order of event time. Subclasses name the columns they put out and say what a row does."""

    #: Schema of what comes out, without the key; and of the memory of a key.
    OUT = ""
    MEMORY = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long")
        self.due = handle.getValueState("due", "at long")
        self.memory = handle.getValueState("memory", self.MEMORY)

    def step(self, memory: tuple | None, at: int, row: int, out: list) -> tuple | None:
        """The memory after a row."""
        raise NotImplementedError

    def rest(self, memory: tuple) -> int | None:
        """The time up to which a key has to be silent for its run to be over; None if it never is."""
        return None

    def over(self, memory: tuple, out: list) -> tuple | None:
        """The memory after the run is over."""
        return memory

    def _wake(self, at: int | None) -> None:
        """A timer at ``at``, unless there is an earlier one: one timer a key."""
        if at is None:
            return
        when = -(-at // 1000)
        now = self.due.get()[0] if self.due.exists() else None
        if now is not None and now <= when:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(when)
        self.due.update((when,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(zip(part["at"].astype("int64").tolist(), part["id"].astype("int64").tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(first if first is not None else new[0][0], min(new)[0])
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.due.clear()
        # The watermark is in whole milliseconds: rows within its last one wait for the next.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        left = rows[len(ready) :]
        memory, out = self.memory.get() if self.memory.exists() else None, []
        for at, row in ready:
            if memory is not None and (end := self.rest(memory)) is not None and at > end:
                memory = self.over(memory, out)
            memory = self.step(memory, at, row, out)
        end = self.rest(memory) if memory is not None else None
        # Nothing can come any more that belongs to this run.
        if end is not None and end < passed and not (left and left[0][0] <= end):
            memory = self.over(memory, out)
            end = self.rest(memory) if memory is not None else None
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update(tuple(memory))
        if left:
            self.waiting.put(left)
        elif rows:
            self.waiting.clear()
        times = ([left[0][0]] if left else []) + ([end + 1000] if end is not None else [])
        self._wake(min(times) if times else None)
        if out:
            names = [c.split()[0] for c in self.OUT.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "_key", key[0])
            yield frame

    def close(self) -> None:
        pass


class Checkpoints(InOrder):
    """A checkpoint before the row that comes after ``rows`` rows, or more than ``seconds`` after the checkpoint before; a final
    one once the key has been silent for ``idle`` seconds. 0 rows: only final ones; 0 seconds: no checkpoints by time."""

    OUT = "number long, records long, cursor long, final boolean"
    MEMORY = "number long, records long, since long, cursor long"

    def __init__(self, rows: int, seconds: float, idle: float) -> None:
        self.rows, self.gap, self.idle = rows, int(seconds * 1e6), int(idle * 1e6)

    def step(self, memory, at, row, out):
        number, records, since, cursor = memory or (0, 0, at, at)
        if records == 0 and memory and since < 0:
            since = at
        if self.rows and records and (records >= self.rows or self.gap and at - since > self.gap):
            number += 1
            out.append((number, records, cursor, False))
            records, since = 0, at
        return number, records + 1, since, at

    def rest(self, memory):
        return memory[3] + self.idle if memory[1] else None

    def over(self, memory, out):
        number, records, _, cursor = memory
        out.append((number + 1, records, cursor, True))
        # The next run begins with its first row.
        return number + 1, 0, -1, cursor


class RateLimit(InOrder):
    """Whether each row may run: fewer than ``most`` rows that ran within the last ``seconds`` before it."""

    OUT = "id long, at long, running long, allowed boolean"
    MEMORY = "ran array<long>"

    def __init__(self, most: int, seconds: float) -> None:
        self.most, self.window = most, int(seconds * 1e6)

    def step(self, memory, at, row, out):
        ran = [t for t in (memory[0] if memory else ()) if t > at - self.window]
        allowed = len(ran) < self.most
        out.append((row, at, len(ran), allowed))
        return ([*ran, at] if allowed else ran,)

    def rest(self, memory):
        """When the last time has left the window nothing has to be remembered."""
        return memory[0][-1] + self.window if memory[0] else None

    def over(self, memory, out):
        return None


class Intervals(StatefulProcessor):
    """Intervals of a key, merged as they complete in any order, in one value: their starts and ends. Each micro-batch that brings
    some puts out the whole state of its key, as a source's state message does, so it is read and written whole: two calls of
    the state server a key, not one for each interval. Intervals merge that begin ``step`` or less after the end of another."""

    def __init__(self, step: int) -> None:
        self.unit = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.merged = handle.getValueState("merged", "starts array<long>, ends array<long>, version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        starts, ends, version = self.merged.get() or ((), (), 0)
        known = list(zip(starts, ends, strict=True))
        new = [x for part in rows for x in zip(part["start"].astype("int64").tolist(), part["end"].astype("int64").tolist(), strict=True)]
        merged: list[list[int]] = []
        for start, end in sorted(known + new):
            if merged and start <= merged[-1][1] + self.unit:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        version += 1
        self.merged.update(([a for a, _ in merged], [b for _, b in merged], version))
        yield pd.DataFrame({"_key": [key[0]], "version": [version], "spans": [[{"start": a, "end": b} for a, b in merged]]})

    def close(self) -> None:
        pass


def slice_of(key: str, row: str, slices: int) -> Column:
    """A key's slice for a row, for keys that hold too many rows for one task."""
    return F.concat_ws("/", F.col(key).cast("string"), F.pmod(F.xxhash64(row), F.lit(slices)).cast("string"))


def _keyed(key: str) -> Column:
    """A key as text that is never null: Python workers get batches of keys and cannot tell a null one from its neighbours."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_key")


def _unkeyed(out: DataFrame, key: str, kind: str) -> DataFrame:
    own = F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30)).cast(kind).alias(key)
    return out.select(own, *[c for c in out.columns if c != "_key"])


def _ordered(stream: DataFrame, key: str, ts: str, row: str, late: str, processor: InOrder) -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    rows = timed.select(_keyed(key), F.col(ts), F.unix_micros(ts).alias("at"), F.coalesce(F.col(row).cast("long"), F.lit(-1)).alias("id"))
    out = rows.groupBy("_key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"_key string, {processor.OUT}", outputMode="Append", timeMode="EventTime")
    return _unkeyed(out, key, stream.schema[key].dataType.simpleString())


def checkpoint_stream(stream: DataFrame, key: str, ts: str, row: str, late: str, rows: int, seconds: float = 0, idle: float = 3600) -> DataFrame:
    """(key, number, records, cursor, final): the checkpoints of each key, see ``Checkpoints``; cursors are microseconds."""
    return _ordered(stream, key, ts, row, late, Checkpoints(rows, seconds, idle))


def limited_stream(stream: DataFrame, key: str, ts: str, row: str, late: str, most: int, seconds: float) -> DataFrame:
    """(key, id, at, running, allowed) of each row, see ``RateLimit``."""
    return _ordered(stream, key, ts, row, late, RateLimit(most, seconds))


def interval_stream(stream: DataFrame, key: str, start: str, end: str, step: int = 1) -> DataFrame:
    """(key, version, spans array<struct<start, end>>): the merged intervals of a key after each micro-batch that brings some."""
    rows = stream.select(_keyed(key), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    kind = "_key string, version long, spans array<struct<start:long,end:long>>"
    out = rows.groupBy("_key").transformWithStateInPandas(statefulProcessor=Intervals(step), outputStructType=kind, outputMode="Update", timeMode="None")
    return _unkeyed(out, key, stream.schema[key].dataType.simpleString())


def run_stateful(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off all that is there now, one Parquet folder for each micro-batch, and end. A restart with the same checkpoint goes
    on with the state; a micro-batch that is repeated after a crash replaces its folder. State is kept in RocksDB, so it may
    be larger than memory."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        # The query keeps the setting it starts with.
        mode = "update" if "spans" in stream.columns else "append"
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(availableNow=True).start()
        )
    finally:
        conf.set(STORE, before) if before is not None else conf.unset(STORE)
    query.awaitTermination()


def batches(stream: DataFrame, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """What ``run_stateful`` has written, with the schema of ``stream``."""
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path).select(*(columns or stream.columns))
