"""A vector store as tables: an inverted-file index with product-quantised codes, loaded in batches, searched by probes.

``fit`` draws a bounded sample, finds the centres of cells and the codebooks by k-means rounds and stores both. ``VectorSink``
takes batches of records: the records' old chunks are deleted before the new ones are written, and a batch is there as a whole
or not at all (its ledger file comes last), so a batch that is repeated after a crash changes nothing. Chunks lie in one
folder for each batch, partitioned by cell; a deletion is a row of record and batch that hides earlier chunks. ``compact``
rewrites what is live.

``neighbours`` searches for each query the cells of its nearest centres. Shards of the index meet blocks of queries, both of
bounded size: a vector is sent once for each block or shard of the other side, however many cells are searched. There,
distances come from the codes, each query keeps a short list, which is ranked by the vectors themselves, and only what is
left of it leaves the task. The index is approximate; the README states its recall.

Centres and codebooks are at most CELLS and 256 rows for each part of a vector, whatever the number of rows: they may be
collected and sent to the workers. Everything else stays in tables.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.session import cut

#: Centres at most, rows that call for one, and rows of the sample that centres and codebooks are fitted on.
CELLS, CELL_ROWS, SAMPLE_ROWS = 4096, 200, 20_000
#: Components of a part of a vector, and codes of a part.
PART, CODES = 4, 256
#: Rows of a shard of the index and of a block of queries that meet in one task, and bytes of their vectors, at most; pairs of
#: them that are worth a task of their own.
SHARD_ROWS, QUERY_ROWS, SIDE_BYTES, TILE_PAIRS = 131_072, 131_072, 32 << 20, 1 << 26
#: Distances that a search holds at once.
HELD = 1 << 22
#: Entries of a short list for each neighbour that is asked for, and queries that the number of probes is measured on.
LONGER, SAMPLE_QUERIES = 8, 200


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample, from every (n / k)-th row on."""
    out = x[:: max(1, len(x) // k)][:k].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, out)
        sums, n = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


@dataclass(frozen=True)
class Model:
    """Centres (cells x d) and codebooks (parts x codes x PART) of the differences to them."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def d(self) -> int:
        return self.centres.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows x parts x PART; zeros fill up the last part."""
        wide = np.zeros((len(x), len(self.books) * PART))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), len(self.books), PART)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        cell = nearest(x, self.centres)
        split = self.parts(x - self.centres[cell])
        return cell, np.stack([nearest(split[:, i], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes of cells stand for."""
        rest = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return self.centres[cell] + rest[:, : self.d]

    def cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Queries x cells: whether a cell is among the ``probes`` nearest ones of a query."""
        score = queries @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        n = min(probes, score.shape[1])
        out = np.zeros(score.shape, dtype=bool)
        np.put_along_axis(out, np.argpartition(-score, n - 1, axis=1)[:, :n], True, axis=1)
        return out


def sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): rows whose vector is there and finite in all components."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def fit(spark: SparkSession, rows: DataFrame, path: str) -> Model:
    """Fit an index on about SAMPLE_ROWS of the ``rows`` (id, vector) by hash, twice that at most, and store it under ``path``.
    Vectors of the most frequent length of the sample count."""
    total = rows.count()
    step = max(1, total // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).limit(2 * SAMPLE_ROWS).toArrow()
    lengths = np.array([len(v) for v in some.column("vector")])
    if not len(lengths):
        raise ValueError("no vectors to fit an index on")
    d = int(np.bincount(lengths).argmax())
    own = some.filter(pa.array(lengths == d))
    x = matrix(own.column("vector"), d)[np.argsort([str(i) for i in own.column("id").to_pylist()])]
    cells = max(1, min(CELLS, math.isqrt(total), total // CELL_ROWS, len(x)))
    centres = kmeans(x, cells)
    parts = math.ceil(d / PART)
    rest = np.zeros((len(x), parts * PART))
    rest[:, :d] = x - centres[nearest(x, centres)]
    books = np.stack([_book(rest[:, i * PART : (i + 1) * PART]) for i in range(parts)])
    stored = [(i, c.tolist(), None) for i, c in enumerate(centres)] + [(i, None, b.ravel().tolist()) for i, b in enumerate(books)]
    spark.createDataFrame(stored, "number int, centre array<double>, book array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return Model(centres, books)


def _book(x: np.ndarray) -> np.ndarray:
    """CODES codes; those that a small sample does not fill repeat the first."""
    out = kmeans(x, min(CODES, len(x)))
    return np.concatenate([out, np.repeat(out[:1], CODES - len(out), axis=0)])


def loaded(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("number").collect()
    centres = np.array([r.centre for r in rows if r.centre is not None])
    return Model(centres, np.array([r.book for r in rows if r.book is not None]).reshape(-1, CODES, PART))


CHUNKS = "record string, chunk long, vector array<float>, codes binary, cell int"


class VectorSink:
    """Batches of records into the index under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.model = spark, path.rstrip("/"), loaded(spark, path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _ledger(self) -> list[str]:
        ledger = self._at("ledger")
        return [f.getPath().getName() for f in self.fs.listStatus(ledger)] if self.fs.exists(ledger) else []

    def base(self) -> int | None:
        """The last batch that went into the newest compacted table."""
        return max((int(n[5:]) for n in self._ledger() if n.startswith("base-")), default=None)

    def batches(self) -> list[int]:
        """Numbers of the batches that are there as a whole."""
        base = self.base()
        later = sorted(int(n) for n in self._ledger() if n.isdigit() and (base is None or int(n) > base))
        return later if base is None else [base, *later]

    def encoded(self, chunks: DataFrame) -> DataFrame:
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, codes = model.encode(matrix(batch.column(2), model.d)) if batch.num_rows else (np.zeros(0), np.zeros((0, len(model.books)), np.uint8))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], names=["record", "chunk", "vector", "codes", "cell"])

        rows = chunks.select(F.col("record").cast("string"), F.col("chunk").cast("long"), F.col("vector").cast("array<float>"))
        return rows.where(F.size("vector") == model.d).mapInArrow(run, CHUNKS)

    def flush(self, batch: int, chunks: DataFrame, deleted: DataFrame | None = None) -> bool:
        """Write a batch of chunks (record, chunk, vector); earlier chunks of their records, and of the records ``deleted``, are
        gone from then on. False if the batch is there already."""
        base = self.base()
        if batch in self.batches() or base is not None and batch <= base:
            return False
        gone = chunks.select(F.col("record").cast("string"))
        gone = gone.unionByName(deleted.select(F.col("record").cast("string"))) if deleted is not None else gone
        gone.distinct().write.mode("overwrite").parquet(f"{self.path}/deleted/batch={batch}")
        self.encoded(chunks).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/chunks/batch={batch}")
        self.fs.create(self._at(f"ledger/{batch}"), True).close()
        return True

    def _table(self, name: str, kind: str) -> DataFrame:
        base = self.base()
        there = [f"{self.path}/{name}/batch={b}" for b in self.batches() if b != base]
        out = self.spark.read.option("basePath", f"{self.path}/{name}").schema(kind).parquet(*there) if there else self.spark.createDataFrame([], kind)
        if base is not None and name == "chunks":
            old = self.spark.read.option("basePath", f"{self.path}/compacted-{base}").schema(CHUNKS).parquet(f"{self.path}/compacted-{base}")
            out = out.unionByName(old.withColumn("batch", F.lit(base).cast("long")))
        return out

    def live(self) -> DataFrame:
        """(record, chunk, vector, codes, cell, batch): chunks that no later batch has deleted."""
        gone = self._table("deleted", "record string, batch long").groupBy("record").agg(F.max("batch").alias("last"))
        chunks = self._table("chunks", CHUNKS + ", batch long")
        return chunks.join(gone, "record", "left").where("last IS NULL OR last <= batch").drop("last")

    def compact(self) -> None:
        """Write the live chunks as one table that stands for all batches so far. It counts once the ledger names it; only then
        what it replaces is deleted, so a crash at any step loses nothing."""
        old, before = self.batches(), self.base()
        if not old or old == [before]:
            return
        self.live().drop("batch").repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/compacted-{old[-1]}")
        self.fs.create(self._at(f"ledger/base-{old[-1]}"), True).close()
        for b in old:
            for name in (f"ledger/{b}", f"chunks/batch={b}", f"deleted/batch={b}"):
                self.fs.delete(self._at(name), True)
        if before is not None:
            self.fs.delete(self._at(f"ledger/base-{before}"), False)
            self.fs.delete(self._at(f"compacted-{before}"), True)


def grid(rows: int, asked: int, d: int, tasks: int) -> tuple[int, int]:
    """Shards of the index and blocks of queries: so many that each fits in memory and that there is work for ``tasks`` tasks.

    The index is sent once for each block, the queries once for each shard, and each shard returns a list: shards are fewer.
    Their number follows the cores until a side of a tile is full, which at 393,216 rows of 64 components it is for 24 tasks.
    """
    most = max(1, SIDE_BYTES // (4 * max(1, d)))
    shards, blocks = (max(1, -(-n // min(top, most))) for n, top in ((rows, SHARD_ROWS), (asked, QUERY_ROWS)))
    want = min(tasks, -(-rows * asked // TILE_PAIRS))
    shards = max(shards, round(math.sqrt(want / 2)))
    return shards, max(blocks, -(-want // shards))


def neighbours(sink: VectorSink, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query, rank int, record, chunk, distance): for each of the ``queries`` (query, vector) the k nearest live chunks that its
    ``probes`` nearest cells have, by squared distance, ties by record and chunk. Each shard has short lists of its own, so
    more shards lose no neighbour."""
    model, longer, spark = sink.model, LONGER * k, queries.sparkSession
    live = cut(sink.live().select("record", "chunk", "vector", "codes", "cell"))
    counted = queries.select(F.col("query").cast("string"), F.col("vector").cast("array<float>")).where(F.size("vector") == model.d)
    shards, blocks = grid(live.count(), counted.count(), model.d, 2 * spark.sparkContext.defaultParallelism)
    left = live.select("*", F.pmod(F.xxhash64("record", "chunk"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = counted.select("query", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))

    def searched(index: pa.Table, some: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if index.num_rows and some.num_rows:
            index = index.sort_by([("record", "ascending"), ("chunk", "ascending")])
            codes = np.frombuffer(b"".join(index.column("codes").to_pylist()), dtype=np.uint8).reshape(index.num_rows, -1)
            # Rows of equal codes have one distance, to the last bit: the order of records decides among them.
            named = np.concatenate([index.column("cell").to_numpy().astype("<u4")[:, None].view(np.uint8), codes], axis=1)
            _, one, same = np.unique(np.ascontiguousarray(named).view(f"V{named.shape[1]}").ravel(), return_index=True, return_inverse=True)
            if len(one) == len(same):
                one = same = np.arange(len(same))
            cell = index.column("cell").to_numpy()[one]
            near = model.decoded(cell, codes[one])
            half, n = 0.5 * (near**2).sum(1), min(longer, index.num_rows)
            own, x = _floats(index.column("vector"), model.d), _floats(some.column("vector"), model.d)
            sound = np.isfinite(half).all() and np.isfinite(x).all()
            step = max(1, HELD // max(index.num_rows, n * model.d))
            for a in range(0, len(x), step):
                q = x[a : a + step].astype(np.float64)
                # Half the squared distance, less what is the same for all rows.
                way = half - q @ near.T
                way[~model.cells(q, probes)[:, cell]] = np.inf
                if not sound:
                    way[np.isnan(way)] = np.inf
                top, there = _least(way if len(one) == len(same) else way[:, same], n)
                distance = ((q[:, None] - own[top]) ** 2).sum(2)
                distance[~there] = np.inf
                best = np.argsort(distance, axis=1, kind="stable")[:, :k]
                who, place = np.nonzero(np.take_along_axis(there, best, 1))
                best = best[who, place]
                out.append((who + a, top[who, best], distance[who, best]))
        who, which, distance = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": some.column("query").take(pa.array(who)), "record": index.column("record").take(pa.array(which)), "chunk": index.column("chunk").take(pa.array(which)), "distance": pa.array(distance, pa.float64())})

    # More partitions than tiles, so that few tiles share a task.
    left, right = (side.repartition(4 * shards * blocks, "shard", "block") for side in (left, right))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(searched, "query string, record string, chunk long, distance double")
    last = Window.partitionBy("query").orderBy("distance", "record", "chunk")
    ranked = found.withColumn("rank", F.row_number().over(last))
    return ranked.where(F.col("rank") <= k).select("query", "rank", "record", "chunk", "distance")


def _floats(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _least(way: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n least of each row, in order of place; of equals the first ones. And whether they are finite."""
    most = np.partition(way, n - 1, axis=1)[:, n - 1 : n]
    inside = way <= most
    for i in np.flatnonzero(inside.sum(1) > n):
        tied = np.flatnonzero(way[i] == most[i])
        inside[i, tied[n - np.count_nonzero(way[i] < most[i]) :]] = False
    top = np.nonzero(inside)[1].reshape(len(way), n)
    return top, np.isfinite(np.take_along_axis(way, top, 1))


def probes_for(sink: VectorSink, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """How many cells a query has to search so that they hold this share of the true k nearest chunks, by brute force for at most
    SAMPLE_QUERIES of the ``queries`` (query, vector), drawn by hash: a query set of bounded size against all rows."""
    model = sink.model
    some = queries.where(F.size("vector") == model.d).orderBy(F.xxhash64("query")).limit(SAMPLE_QUERIES).select(F.col("vector").cast("array<float>")).toArrow()
    if not some.num_rows:
        return len(model.centres)
    x = matrix(some.column("vector"), model.d)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column(0), model.d)
                way = (y**2).sum(1) - 2 * x @ y.T
                n = min(k, len(y))
                top = np.argpartition(way, n - 1, axis=1)[:, :n]
                who = np.repeat(np.arange(len(x)), n)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), batch.column(1).take(pa.array(top.ravel())), pa.array(np.take_along_axis(way, top, 1).ravel())], names=["who", "cell", "way"])

    found = sink.live().select("vector", "cell").mapInArrow(best, "who int, cell int, way double")
    order = Window.partitionBy("who").orderBy("way", "cell")
    rows = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("who", "cell").toPandas()
    score = x @ model.centres.T - 0.5 * (model.centres**2).sum(1)
    places = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)[rows["who"], rows["cell"]] + 1
    return int(np.quantile(places, recall, method="higher")) if len(places) else len(model.centres)


# --- messages in, flushed by states -----------------------------------------------------------------------------------


def load(sink: VectorSink, messages: DataFrame, most: int) -> list[int]:
    """Load ``messages`` (at long, kind, record, chunk, vector) in their order: RECORD brings a chunk, DELETE removes a record, STATE
    asks for a flush of all before it; more than ``most`` messages are flushed as well. Numbers of the batches written.

    A batch ends at every state and at every ``most``-th message after it, so batches follow from the messages alone: a load
    that is repeated writes what is missing.
    """
    rows = cut(_batched(messages, most))
    numbers = [r.batch for r in rows.select("batch").distinct().orderBy("batch").collect()]
    done = []
    for n in numbers:
        own = rows.where(F.col("batch") == n)
        # Of a record that comes twice in a batch, what follows its last deletion or re-emission counts: chunks of its last version.
        last = own.where("kind = 'DELETE'").groupBy("record").agg(F.max("at").alias("_gone"))
        chunks = own.where("kind = 'RECORD'").join(last, "record", "left").where("_gone IS NULL OR at > _gone").drop("_gone")
        if sink.flush(n, chunks, own.where("kind = 'DELETE'").select("record")):
            done.append(n)
    return done


def _batched(messages: DataFrame, most: int) -> DataFrame:
    """Messages with the number of their batch. Places are counted by ranges of ``at``: no task sees more than its range."""
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut(messages.repartitionByRange("at").sortWithinPartitions("at").withColumn("_p", F.spark_partition_id()).withColumn("_i", low))
    state = F.col("kind") == "STATE"
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_p").agg(F.count_if(state).alias("_s"), F.max(F.when(state, F.col("_i"))).alias("_last"), F.count(F.lit(1)).alias("_n"))
    # One row for each range: how many states come before it, and how many messages since the last of them.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_states", F.coalesce(F.sum("_s").over(before), F.lit(0))).withColumn("_total", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.withColumn("_mark", F.max(F.when(F.col("_last").isNotNull(), F.col("_total") + F.col("_last") + 1)).over(before)).select("_p", "_states", "_total", F.coalesce("_mark", F.lit(0)).alias("_mark"))
    placed = ranged.join(F.broadcast(starts), "_p")
    states = F.col("_states") + F.coalesce(F.count_if(state).over(inside), F.lit(0))
    since = F.coalesce(F.col("_total") + F.max(F.when(state, F.col("_i") + 1)).over(inside), F.col("_mark"))
    placed = placed.withColumn("_run", states).withColumn("_place", F.col("_total") + F.col("_i") - since)
    batch = F.col("_run") * F.lit(1 << 20) + F.floor(F.col("_place") / most)
    return placed.where(~state).select(*messages.columns, batch.cast("long").alias("batch"))


def new_index(spark: SparkSession, root: str, rows: DataFrame) -> VectorSink:
    """A new, empty index in a folder of its own below ``root``, fitted on ``rows`` (id, vector)."""
    path = f"{root}/vectors-{uuid.uuid4().hex}"
    fit(spark, rows, path)
    return VectorSink(spark, path)


def described(sink: VectorSink) -> str:
    """Sizes of the index as JSON."""
    return json.dumps({"cells": len(sink.model.centres), "parts": len(sink.model.books), "batches": len(sink.batches())})
