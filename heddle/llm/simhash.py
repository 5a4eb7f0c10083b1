"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in few bits agree in whole blocks of bits. An upper node of the index is a shared masked
pattern: a choice of blocks and their bits. A fingerprint stands under one node for each block; two fingerprints at
``radius`` or fewer differing bits meet under at least one, as there is one block more than bits that may differ. Nodes
with many fingerprints are factored again by blocks of their free bits. Below a node, fingerprints lie in Gray order,
in which neighbours share long patterns: pages of them, and pages of pages, are summed up by the bits that all have in
common. A search adds up the differences on the way down and leaves a whole group when they exceed the radius.

A node emits a spanning forest of the links it finds, never its pairs, so a dense group costs as many rows as members.
Components of the forest come from alternating star joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import discard, give_back, in_batches, table, written

RADIUS = 3
#: Fingerprints of a node above which it is factored again, and times a node is factored at most.
NODE_ROWS, LEVELS = 512, 5
#: Fingerprints of a page, groups summed up by one above them, and comparisons that a search may hold at once.
PAGE, FAN, BLOCK = 16, 8, 1 << 20
SEED = 42


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over all ``width``-word shingles of a text, repeats included; 0 for a text without words.

    bytes.lower() changes A-Z alone and bytes.split() cuts at the six ASCII white-space characters alone.
    """
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= width:
        starts, ends = starts[: len(found) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        digests = np.frombuffer(b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans]), dtype=np.uint8)
        ones += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    ids = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`"))
    return ids.mapInArrow(run, "id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a 64-bit word in the reflected Gray sequence: the exclusive or of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


# --- the index ------------------------------------------------------------------------------------------------------


def node_masks(mask: int, radius: int) -> list[int]:
    """Masks of the nodes below one whose bits ``mask`` are fixed: the free bits in radius + 1 blocks."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] places, then the same for the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


class GrayIndex:
    """Hierarchy over the codes of many nodes at once; the codes of a node lie together and in Gray order.

    The lowest level are pages of PAGE codes, each level above sums up FAN groups, up to FAN groups at the top of a node.
    A group keeps the pattern of the bits that all below it share, as far as the group above lacks them.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray) -> None:
        self.codes, self.first = codes, first
        self.size = np.diff(np.append(first, len(codes)))
        self.owner = np.repeat(np.arange(len(first)), self.size)
        below, begin, count = PAGE, first, self.size
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            count, at = -(-count // below), begin
            owner = np.repeat(np.arange(len(first)), count)
            begin = np.cumsum(count) - count
            start = at[owner] + (np.arange(len(owner)) - begin[owner]) * below
            if not levels:
                low, high = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
                mask = ~(low ^ high)
                levels.append((start, mask, low & mask))
            else:
                _, mask, pattern = levels[-1]
                inside = np.diff(np.append(start, len(mask)))
                same = ~np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[start], inside), start)
                agree = np.bitwise_and.reduceat(mask, start) & same
                levels.append((start, agree, pattern[start] & agree))
            if count.max(initial=0) <= FAN:
                break
            below = FAN
        self.top = (begin, count)
        self.levels = []  # top level first: where the children begin, own bits, pattern
        above = np.zeros(len(levels[-1][1]), dtype=np.uint64)
        for start, mask, pattern in reversed(levels):
            self.levels.append((start, mask & ~above, pattern))
            if len(self.levels) < len(levels):
                above = np.repeat(mask, np.diff(np.append(start, len(levels[-len(self.levels) - 1][1]))))

    def links(self, radius: int, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs of codes of one node that differ in ``radius`` bits or fewer, each pair once; with ``asks``,
        only pairs of which one code asks.

        A code goes down its node's hierarchy; differences add up, and a group is left with all below it when they exceed
        the radius. Codes go in blocks, so what is held at once is bounded however large a node is.
        """
        asks = np.ones(len(self.codes), dtype=bool) if asks is None else asks
        asking = np.flatnonzero(asks)
        work = np.cumsum(self.size[self.owner[asking]])
        begin = 0
        while begin < len(asking):
            done = work[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(work, done + BLOCK, side="right")))
            query = asking[begin:end]
            own = self.owner[query]
            count = self.top[1][own]
            who, group = np.repeat(query, count), _spread(self.top[0][own], count)
            gone = np.zeros(len(who), dtype=np.uint8)
            for depth, (start, mask, pattern) in enumerate(self.levels):
                gone = gone + np.bitwise_count((self.codes[who] ^ pattern[group]) & mask[group])
                stay = gone <= radius
                who, group, gone = who[stay], group[stay], gone[stay]
                last = depth + 1 == len(self.levels)
                total = len(self.codes) if last else len(self.levels[depth + 1][0])
                count = np.append(start, total)[group + 1] - start[group]
                who, gone, group = np.repeat(who, count), np.repeat(gone, count), _spread(start[group], count)
            near = ((group < who) | ~asks[group]) & (np.bitwise_count(self.codes[who] ^ self.codes[group]) <= radius)
            yield who[near], group[near]
            begin = end


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place it is connected with."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label


def whole_nodes(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole nodes, from batches sorted by the columns ``key``, with the places at which nodes begin."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
        for c in key:
            x = t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        return np.flatnonzero(np.append(True, change))

    def name(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in key)

    def out() -> tuple[pa.Table, np.ndarray]:
        whole = pa.Table.from_batches(held)
        return whole, starts(whole)

    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(starts(batch)[-1])
        if cut:
            held.append(batch.slice(0, cut))
            yield out()
            held = [batch.slice(cut)]
            continue
        # The whole batch is one node: it ends what is held only if it is another.
        if held and name(held[-1], held[-1].num_rows - 1) != name(batch, 0):
            yield out()
            held = []
        held.append(batch)
    if held:
        yield out()
    give_back()


def _search(radius: int):
    """Arrow function over (path, key, fp) sorted by node and Gray rank: a spanning forest (a, b) of each node's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, first in whole_nodes(batches, "path", "key"):
            codes = whole.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            label = forest(len(codes), GrayIndex(codes, first).links(radius))
            hung = np.flatnonzero(label != np.arange(len(codes)))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(codes[x].view(np.int64)) for x in (hung, label[hung])], names=["a", "b"])

    return run


def near_links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (a, b) of the links among the distinct values of the long column ``fp``.

    Every level counts its nodes first: a node of one fingerprint ends, one of at most NODE_ROWS is searched, a larger
    one is factored by blocks of its free bits. With a radius of 3, 15 of 64 bits are free after LEVELS levels, so a node
    that is left then holds at most 32,768 distinct fingerprints, 256 KB.
    """
    blocks = radius + 1
    masks = [0]
    rows = codes.select(F.lit(0).alias("path"), "fp")
    found = None
    for level in range(1, LEVELS + 1):
        masks = [m for above in masks for m in node_masks(above, radius)]
        fixed = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
        path = F.col("path") * blocks + F.col("block")
        rows = rows.select("path", "fp", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("block")).select(path.alias("path"), "fp")
        rows = rows.select("path", F.col("fp").bitwiseAND(F.get(fixed, F.col("path"))).alias("key"), "fp")
        sizes = rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = written(rows.join(sizes, ["path", "key"]), "nodes")
        here = rows if level == LEVELS else rows.where(F.col("size") <= NODE_ROWS)
        here = here.repartition("path", "key").sortWithinPartitions("path", "key", gray_rank(F.col("fp"))).select("path", "key", "fp")
        links = here.mapInArrow(_search(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        rows = rows.where(F.col("size") > NODE_ROWS).select("path", "fp")
        if level < LEVELS and rows.isEmpty():
            break
    return found


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every end v of the links (a, b): root is the smallest end it is connected with.

    Alternating large-star and small-star steps; each is a minimum per vertex, combined before its shuffle, joined back
    to the edges. Their number grows with the logarithm of the graph. A table is deleted once the next one is written.
    Roots have no row of their own unless they are an end of some link, where v = root.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        discard(edges)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(large)
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp long, component) of every row of ``df``; the component is the smallest id reachable by links.

    Rows with one fingerprint fold into one code before any search, so copies never meet as pairs. A null text has the
    fingerprint of an empty one; null ids are no candidates for the smallest; repeated rows stay; a very long text is
    read whole, its shingles hashed in blocks; other columns are not read, whatever their names; an empty table gives an
    empty result.
    """
    base = written(fingerprints(df, id_col, text_col, width), "fingerprints")
    codes = written(base.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    roots = components(near_links(codes.select("fp"), radius)).withColumnRenamed("v", "fp")
    rooted = codes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = written(rooted.join(smallest, "root").select("fp", "component"), "components")
    return base.join(named, "fp").select("id", "fp", "component")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
