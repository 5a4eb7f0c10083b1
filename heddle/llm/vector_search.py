"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to cells around at most CELLS centres, fitted on a bounded sample; cells are cut into shards of at most
SHARD_ROWS rows by a hash, so a cell that a third of all rows falls into is many shards. In each shard a ball tree is
built. A query's open nodes are taken by falling upper bound of the inner product, centre by query plus radius times the
query's length; a leaf gives scores, and nodes whose bound is under the current k-th score are dropped. The k-th score is
shared: a query first searches the cell of its highest bound, and what it found there bounds the search of all other
cells, most of which are then not sent the query at all.

Every row is indexed, every answer is exact: scores are sums of integers, bounds carry a margin for rounding, and a node
whose bound equals the k-th score stays open while it may hold a smaller id.

Scale: a shard and a block of queries meet in one task, both of bounded size; nothing else is held. What is
broadcast is the table of cells, at most CELLS rows. With rounds of blocks the search is a stated query set against all
rows, pruned by cell; where the vectors have no clusters, bounds prune little and its work is that of all blocks.

Defined results: vectors that are null or hold a null or a component that isn't finite take no part, nor do rows without
an id; components are turned into floor(256 * x) and kept within plus or minus 2**26, so that sums of up to 2,048
components fit a long; vectors meet only those of their own length, and those of length 0 score 0. Rows alike in id and
vector count once; rows of one id with different vectors are each a candidate, and each a query; a query never finds its
own id. Ties go to the smaller id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import discard, table, written

#: Centres of cells at most, the rows that call for one, and the rows they are fitted on.
CELLS, CELL_ROWS, SAMPLE_ROWS = 1024, 4096, 20_000
#: Rows of a shard and of a block of queries that meet in a task.
SHARD_ROWS, QUERY_ROWS = 32_768, 16_384
#: Rows of a leaf at most.
LEAF = 64
#: Queries that go through a tree together.
TOGETHER = 512
LIMIT = float(1 << 26)

ROWS = "vec_id long, vector array<int>"


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<int>) of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    out = out.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return out.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * 256).cast("double"))).cast("int")).alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means of a sample, from every (n / k)-th row; at most k centres."""
    out = sample[:: max(1, len(sample) // k)][:k].copy()
    for _ in range(rounds):
        near = (sample @ out.T - 0.5 * (out * out).sum(1)).argmax(1)
        for i in range(len(out)):
            if (near == i).any():
                out[i] = sample[near == i].mean(0)
    return out


class BallTree:
    """Rows in the order of leaves, and balls: node i has the rows from low[i] to high[i] and the children left[i], left[i] + 1."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.low, self.high, self.left = [0], [len(ids)], [0]
        at = 0
        while at < len(self.low):
            a, b = self.low[at], self.high[at]
            if b - a > LEAF:
                part = order[a:b]
                own = rows[part]
                # Across the two rows that lie far apart; the middle row parts them, so copies part too.
                far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
                axis = far - own[((own - far) ** 2).sum(1).argmax()]
                cut = (b - a) // 2
                order[a:b] = part[np.argpartition(own @ axis, cut)]
                self.left[at] = len(self.low)
                self.low += [a, a + cut]
                self.high += [a + cut, b]
                self.left += [0, 0]
            at += 1
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.left = (np.array(x) for x in (self.low, self.high, self.left))
        self.centre = np.array([self.rows[a:b].mean(0) for a, b in zip(self.low, self.high, strict=True)])
        self.radius = np.array([math.sqrt(((self.rows[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(self.low, self.high, self.centre, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high, strict=True)])

    def bounds(self, queries: np.ndarray, lengths: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with the rows of its node."""
        return bound((queries * self.centre[nodes]).sum(1), lengths, self.radius[nodes])

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) of the k best rows of each query, best first, -inf where there are fewer; rows that score less than
        ``floor`` may be left out. Also how many rows were scored."""
        n, lengths = len(queries), np.sqrt((queries**2).sum(1))
        # Sums beyond 2**53 need the longer mantissa of long doubles.
        wide = self.rows.size and queries.size and self.rows.shape[1] * np.abs(self.rows).max() * np.abs(queries).max() >= 2.0**53
        kind = np.longdouble if wide else np.float64
        best, found, scored = np.full((n, k), -np.inf, dtype=kind), np.full((n, k), np.iinfo(np.int64).max), 0
        # Open nodes of all queries, as pairs with their bounds.
        who, node = np.arange(n), np.zeros(n, dtype=np.int64)
        limit = self.bounds(queries, lengths, node)
        while len(who):
            # Each query's open node of the highest bound.
            order = np.lexsort((-limit, who))
            first = np.ones(len(order), dtype=bool)
            first[1:] = who[order][1:] != who[order][:-1]
            top = order[first]
            q, at = who[top], node[top]
            rest = np.ones(len(who), dtype=bool)
            rest[top] = False
            who, node, limit = who[rest], node[rest], limit[rest]
            leaf = self.left[at] == 0
            if leaf.any():
                ql, al = q[leaf], at[leaf]
                span = np.arange(int((self.high[al] - self.low[al]).max()))
                place = self.low[al][:, None] + span
                inside = place < self.high[al][:, None]
                place = np.where(inside, place, 0)
                ids = self.ids[place]
                score = np.matmul(self.rows[place].astype(kind, copy=False), queries[ql][:, :, None].astype(kind, copy=False))[:, :, 0] if self.rows.shape[1] else np.zeros(place.shape)
                scored += int(inside.sum())
                score = np.where(inside & (ids != own[ql][:, None]), score, -np.inf)
                ids = np.where(score == -np.inf, np.iinfo(np.int64).max, ids)
                score, ids = np.concatenate([best[ql], score], 1), np.concatenate([found[ql], ids], 1)
                take = np.lexsort((ids, -score))[:, :k]
                best[ql], found[ql] = np.take_along_axis(score, take, 1), np.take_along_axis(ids, take, 1)
            if not leaf.all():
                qi, left = np.repeat(q[~leaf], 2), np.repeat(self.left[at[~leaf]], 2)
                left[1::2] += 1
                who, node = np.concatenate([who, qi]), np.concatenate([node, left])
                limit = np.concatenate([limit, self.bounds(queries[qi], lengths[qi], left)])
            kth = np.maximum(best[:, -1], floor)[who]
            open_ = (limit > kth) | ((limit == kth) & ((best[who, -1] < kth) | (self.least[node] < found[who, -1])))
            who, node, limit = who[open_], node[open_], limit[open_]
        return best, found, scored


def bound(centre: np.ndarray, length: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Largest integer that an inner product within a ball can be, with a margin for rounding."""
    top = centre + length * radius
    return np.floor(top + 1e-9 * (np.abs(centre) + length * radius) + 1e-6)


def _fitted(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centres of the cells for each length of vectors, fitted on about SAMPLE_ROWS rows by hash, twice that at most."""
    step = max(1, total // SAMPLE_ROWS)
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(2 * SAMPLE_ROWS).toArrow()
    out, lengths = {}, np.array([len(v) for v in some.column("vector")], dtype=np.int64)
    for d in np.unique(lengths):
        own = some.filter(pa.array(lengths == d))
        order = np.argsort(own.column("vec_id").to_numpy())
        k = max(1, min(CELLS // len(np.unique(lengths)), math.ceil(total * len(own) / max(len(some), 1) / CELL_ROWS)))
        out[int(d)] = centres(matrix(own.column("vector"))[order], k) if d else np.zeros((1, 0))
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """(vec_id, vector, cell, distance to the cell's centre), cells as text ``length:number``."""
    total = rows.count()
    fitted = _fitted(rows, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(1)], dtype=np.int64)
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                x, c = matrix(part.column(1)), fitted.get(int(d), np.zeros((1, int(d))))
                near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                away = np.sqrt(((x - c[near]) ** 2).sum(1))
                cells = pa.array([f"{d}:{i}" for i in near])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells, pa.array(away)], names=["vec_id", "vector", "cell", "away"])

    out = written(rows.mapInArrow(run, ROWS + ", cell string, away double"), "vectors")
    out._centres = fitted
    return out


def _searched(k: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if index.num_rows and asked.num_rows:
            ids, rows = index.column("vec_id").to_numpy(), matrix(index.column("vector"))
            # Repeated rows lie side by side after sorting by id and vector.
            order = np.lexsort((*rows.T[::-1], ids))
            ids, rows = ids[order], rows[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(1)
            tree = BallTree(ids[new], rows[new])
            own, queries = asked.column("query_id").to_numpy(), matrix(asked.column("query"))
            floor, number = asked.column("kth").to_numpy(), asked.column("number").to_numpy()
            for a in range(0, len(own), TOGETHER):
                b = a + TOGETHER
                score, found, _ = tree.search(own[a:b], queries[a:b], k, floor[a:b])
                i, j = np.nonzero(score > -np.inf)
                out.append((number[a:b][i], own[a:b][i], found[i, j], score[i, j].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, dtype=np.int64)] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("number", "query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _visited(index: DataFrame, parts: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Answers (number, query_id, vec_id, score) of the visits (cell, number, query_id, query, kth): each cell's shards meet each
    block of the queries that visit it."""
    blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
    sizes = parts.join(blocks, "cell").select("cell", "shards", "blocks")
    sharded = index.join(sizes, "cell").select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), F.col("shards")).alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = visits.join(sizes, "cell").select("cell", "number", "query_id", "query", "kth", F.pmod(F.xxhash64("number"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keys = [F.col("cell"), F.col("shard").cast("int"), F.col("block").cast("int")]
    left = sharded.withColumns({"shard": keys[1], "block": keys[2]}).groupBy("cell", "shard", "block")
    right = asked.withColumns({"shard": keys[1], "block": keys[2]}).groupBy("cell", "shard", "block")
    return left.cogroup(right).applyInArrow(_searched(k), "number long, query_id long, vec_id long, score long")


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The k best answers of each query with their rank; a query has at most k from each shard it visited."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score long): for each of the ``queries`` the k rows of the highest inner product among the
    ``rows`` of other ids. Both are frames of ``integers``."""
    index = dealt(rows)
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    parts = written(cells.select("cell", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), "radius"), "cells")
    radius = {r.cell: r.radius for r in parts.collect()}  # at most CELLS rows, or one for each length of vectors
    balls = {d: (c, np.array([radius.get(f"{d}:{i}", -1.0) for i in range(len(c))])) for d, c in index._centres.items()}
    asked = queries.dropDuplicates(["vec_id", "vector"]).select(F.xxhash64("vec_id", "vector").alias("number"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    asked = written(asked, "queries")

    def sent(first: bool):
        """Each query with the cells it has to visit: that of its highest bound, or all others that may beat its k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths = np.array([len(v) for v in batch.column(2)], dtype=np.int64)
                for d in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == d))
                    x = matrix(part.column(2))
                    centre, away = balls.get(int(d), (np.zeros((1, int(d))), np.array([radius.get(f"{d}:0", -1.0)])))
                    limit = bound(x @ centre.T, np.sqrt((x**2).sum(1))[:, None], away)
                    limit[:, away < 0] = -np.inf
                    home = limit.argmax(1)
                    visit = limit >= part.column(3).to_numpy()[:, None]
                    if first:
                        visit[:] = False
                        visit[np.arange(len(x)), home] = limit[np.arange(len(x)), home] > -np.inf
                    else:
                        visit[np.arange(len(x)), home] = False
                        visit &= limit > -np.inf
                    # Query by query, so that no batch holds all visits at once.
                    i, j = np.nonzero(visit)
                    for a in range(0, len(i), 4096):
                        who, where = i[a : a + 4096], j[a : a + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([f"{d}:{c}" for c in where], pa.string()), *(part.column(n).take(pa.array(who)) for n in range(4))], names=["cell", "number", "query_id", "query", "kth"])

        return run

    kinds = "cell string, number long, query_id long, query array<int>, kth double"
    none = asked.withColumn("kth", F.lit(float("-inf")))
    home = written(_best(_visited(index, parts, none.mapInArrow(sent(True), kinds), k), k).drop("rank"), "home")
    # A query that found k rows at home needs no row that scores less than the last of them.
    kth = home.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    # As a double it may be rounded up: a little less is as safe.
    known = asked.join(kth, "number", "left").select("number", "query_id", "query", F.when(F.col("n") >= k, F.col("least") - F.abs("least") * 1e-12).otherwise(float("-inf")).alias("kth"))
    visits = written(known.mapInArrow(sent(False), kinds), "visits")
    out = written(_best(home.unionByName(_visited(index, parts, visits, k)), k).select("query_id", "rank", "vec_id", "score"), "answers")
    for own in (index, parts, asked, home, visits):
        discard(own)
    return out


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every vector whose id is divisible by 50, among all other vectors."""
    rows = integers(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


#: All pairs of a query and a row, scored by integers.
OP13_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
