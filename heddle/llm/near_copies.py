"""Near-copies by five-word shingles: SimHash finds candidates, their texts decide.

Two texts are near-copies if the Jaccard similarity of their distinct ``width``-word shingles is ``similarity`` or more.
The SimHash of such texts differs in some ten bits of 64, too many for blocks that agree exactly. But the bits that
flip are those that shingles are evenly split over: the most lopsided ones stay. So the upper nodes of the index are masks
that a text chooses for itself: of each of TABLES fixed pools of bits the CONFIDENT most lopsided ones and their values.
Texts that share such a masked pattern meet in its node, lie there in Gray order, and are searched by ``GrayIndex`` with
its summed-up groups and accumulated differences, up to RADIUS bits. Counts of shingles by COUNTS ranges of their hashes
bound the similarity of a pair from above; only pairs that they allow leave a node, and those are compared by their texts.

Texts of equal shingle sets fold into one code first. Candidates are verified in rounds: neighbours in Gray order of a few
pools, then in every node the nearest codes that are not connected yet, asked for by the smaller group. A node in which a
code had more candidates than a round takes stays open; only open nodes are searched again, with STEP times as many for
each code, until none is open: no candidate is left out, whatever else the corpus holds. Codes that a link joined are not
compared any more, so of a dense group of thousands of texts none is compared with all others. A group of more than
NODE_ROWS codes is dealt out over several tasks. All rows of nodes are shuffled once; what is open is a table of its own
that shrinks from round to round, and texts are read once for each of the first two rounds and once for all others.

The candidate search is a probabilistic one: its recall against brute force is measured in the tests and the README.

Defined results: a null text is empty; texts without words are alike; a text of fewer than ``width`` words is one
shingle; sets of fewer than four shingles are alike only if they are equal; null ids are no candidates for the smallest;
repeated rows stay; a very long text is read whole; other columns are not read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import _packed, _unpacked, bitmap_filter, discard, filter_bits, flagged, in_batches, passing, scratch, slices, written
from heddle.llm.simhash import GrayIndex, components, gray_rank, whole_nodes

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Sums of signs that a text has; pools of them, bits of a pool, and bits of a pool that make a mask.
SUMS, TABLES, POOL, CONFIDENT = 256, 32, 32, 3
#: Fingerprint bits in which candidates differ at most, and pools of the first round.
RADIUS, FIRST_TABLES = 16, 4
#: Nearest codes of other groups that a code is compared with in each of its nodes, in the round after the first; each later
#: round takes STEP times as many.
FIRST_NEAREST, STEP = 4, 16
#: Ranges of hashes whose shingles are counted, modulo 16.
COUNTS = 128
#: Codes of one group that meet in one task, and pairs that a search holds before it keeps the nearest.
NODE_ROWS, PAIRS_HELD = 4096, 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text; words as in ``simhash.fingerprint``."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    known = {w: xxh64_intdigest(w, 5) for w in set(found)}
    h = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), dtype=np.uint64)
    for i in range(min(len(h), width)):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def similarity_of(x: np.ndarray, y: np.ndarray) -> Fraction:
    """Jaccard similarity of two sets of shingles; that of two empty ones is 1."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return Fraction(common, len(x) + len(y) - common) if len(x) or len(y) else Fraction(1)


def sign_sums(own: np.ndarray) -> np.ndarray:
    """For each of SUMS bits: shingles that have it less those that don't."""
    ones = np.zeros(SUMS, dtype=np.int64)
    for at in range(0, len(own), 1 << 13):
        h = own[at : at + (1 << 13)]
        words = np.stack([h, *[_mixed(h + np.uint64(i * 0x2545F4914F6CDD1D % (1 << 64))) for i in range(1, SUMS // 64)]], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * ones - len(own)


def range_counts(own: np.ndarray) -> bytes:
    """Shingles in each of COUNTS equal ranges of their hashes, modulo 16, two counts to a byte."""
    n = np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=COUNTS) & 15
    return (n[::2] * 16 + n[1::2]).astype(np.uint8).tobytes()


def _round_trip() -> np.ndarray:
    """For two bytes, one after the other as an index: the sum over their halves of the shorter way between counts modulo 16."""
    way = np.minimum(np.arange(16), 16 - np.arange(16))
    byte = np.arange(256)
    high, low = (way[(h[:, None] - h[None, :]) & 15] for h in (byte >> 4, byte & 15))
    return (high + low).astype(np.uint8).ravel()


def _counts(column: pa.ChunkedArray) -> np.ndarray:
    """Rows x bytes of a column of ``range_counts``."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COUNTS // 2)


def _allowed(n: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sizes and counts allow pairs the similarity s.

    A shingle that only one text of a pair has changes one count by one, so counts are apart by no more than there are
    such shingles; similar texts have at most (1 - s) / (1 + s) of their sizes' sum of them. No pair with the similarity
    is refused.
    """
    ok, way = ~_apart(n[x], n[y], similarity), _round_trip()
    at = np.flatnonzero(ok)
    for begin in range(0, len(at), 1 << 16):
        part = at[begin : begin + (1 << 16)]
        a, b = x[part], y[part]
        apart = way[counts[a].astype(np.uint16) * 256 + counts[b]].sum(axis=1, dtype=np.int64)
        most = (similarity.denominator - similarity.numerator) * (n[a].astype(np.int64) + n[b])
        ok[part] = apart * (similarity.denominator + similarity.numerator) <= most
    return ok


def pools() -> np.ndarray:
    """TABLES x POOL places of sums, by a fixed rule."""
    from xxhash import xxh64_intdigest

    return np.array([sorted(range(SUMS), key=lambda i: xxh64_intdigest(f"{t}:{i}"))[:POOL] for t in range(TABLES)])


def node_keys(sums: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Texts x TABLES: the pool, its most lopsided places in order and their signs, as one number. Ties go to the place that
    comes first in the pool."""
    picked = sums[:, table]
    top = np.sort(np.argsort(-np.abs(picked), axis=2, kind="stable")[:, :, :CONFIDENT], axis=2)
    signs = np.take_along_axis(picked, top, axis=2) > 0
    key = np.broadcast_to(np.arange(len(table)), top.shape[:2]).astype(np.int64)
    for i in range(CONFIDENT):
        key = key * (2 * POOL) + 2 * top[:, :, i] + signs[:, :, i]
    return key


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(id, hash, code, n, fp, counts, nodes) of (id, hash, text): code names the set of n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        table = pools()
        for batch in slices(batches, 500):
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            if not sets:
                continue
            sums, n = np.stack([sign_sums(s) for s in sets]), np.array([len(s) for s in sets], dtype=np.int32)
            fp = np.packbits(sums[:, :64] > 0, axis=1).view(">u8").ravel().astype(np.uint64)
            keys, some = node_keys(sums, table), n > 3
            offsets = np.concatenate(([0], np.cumsum(np.where(some, len(table), 0)))).astype(np.int32)
            nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            code = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64)
            counts = pa.array([range_counts(s) for s in sets], pa.binary())
            columns = [batch.column(0), batch.column(1), pa.array(code.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), counts, nodes]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "code", "n", "fp", "counts", "nodes"])

    return rows.mapInArrow(run, "id long, hash long, code long, n int, fp long, counts binary, nodes array<long>")


def _apart(n: np.ndarray, m: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sizes alone rule the similarity out."""
    return np.minimum(n, m).astype(np.int64) * similarity.denominator < np.maximum(n, m).astype(np.int64) * similarity.numerator


def _pairs(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(code[x], code[y]), np.maximum(code[x], code[y])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _neighbours(similarity: Fraction):
    """Arrow function over (key, n, code, fp, counts) sorted by node and Gray rank: rows beside each other that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch])
            key, n, code, fp = (rows.column(c).to_numpy() for c in ("key", "n", "code", "fp"))
            fp = fp.astype(np.int64).view(np.uint64)
            at = np.flatnonzero((key[1:] == key[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= RADIUS))
            at = at[_allowed(n, _counts(rows.column("counts")), at, at + 1, similarity)]
            if len(at):
                yield _pairs(code, at, at + 1)
            last = batch.slice(batch.num_rows - 1)

    return run


def _across(similarity: Fraction, most: int):
    """Arrow function over (key, part, n, code, root, size, fp, counts) sorted by node and Gray rank: for each code, the
    ``most`` nearest ones of other roots that may be similar, no smaller root first asked by a larger one. Besides, as rows
    without a pair, the nodes in which a code has more."""

    def nearest(left: np.ndarray, seek: np.ndarray, find: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that stay; marks in ``left`` the codes that lose some."""
        order = np.lexsort((find, bits, seek))
        seek, find, bits = seek[order], find[order], bits[order]
        first = np.flatnonzero(np.append(True, seek[1:] != seek[:-1])) if len(seek) else np.empty(0, dtype=np.int64)
        place = np.arange(len(seek)) - np.repeat(first, np.diff(np.append(first, len(seek))))
        left[seek[place >= most]] = True
        return seek[place < most], find[place < most], bits[place < most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, first in whole_nodes(batches, "key", "part"):
            n, code, root, size, fp = (whole.column(c).to_numpy() for c in ("n", "code", "root", "size", "fp"))
            fp = fp.astype(np.int64).view(np.uint64)
            # Nodes of one root have nothing to find.
            same = np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first)
            rows = np.diff(np.append(first, len(root)))
            keep = np.repeat(~same, rows)
            if not keep.any():
                continue
            first = np.cumsum(rows[~same]) - rows[~same]
            n, code, root, size, fp = n[keep], code[keep], root[keep], size[keep], fp[keep]
            counts, key = _counts(whole.column("counts").filter(pa.array(keep))), whole.column("key").to_numpy()[keep]
            left = np.zeros(len(code), dtype=bool)
            held = (np.empty(0, dtype=np.int64),) * 3
            for x, y in GrayIndex(fp, first).links(RADIUS, ~_most_of(root, first)):
                fit = root[x] != root[y]
                x, y = x[fit], y[fit]
                fit = _allowed(n, counts, x, y, similarity)
                x, y = x[fit], y[fit]
                # The code of the smaller root asks; of equals, the one of the smaller name.
                asks = (size[x] < size[y]) | (size[x] == size[y]) & (root[x] < root[y])
                x, y = np.where(asks, x, y), np.where(asks, y, x)
                held = tuple(np.concatenate(p) for p in zip(held, (x, y, np.bitwise_count(fp[x] ^ fp[y]).astype(np.int64)), strict=True))
                if len(held[0]) > PAIRS_HELD:
                    held = nearest(left, *held)
            x, y, _ = nearest(left, *held)
            if len(x):
                yield _found(*_pairs(code, x, y).columns, None)
            if left.any():
                yield _found(None, None, pa.array(np.unique(key[left])))

    return run


def _found(a: pa.Array | None, b: pa.Array | None, open_: pa.Array | None) -> pa.RecordBatch:
    """Pairs, or nodes that are open."""
    rows = len(a if a is not None else open_)
    return pa.RecordBatch.from_arrays([x if x is not None else pa.nulls(rows, pa.int64()) for x in (a, b, open_)], names=["a", "b", "open"])


def _most_of(root: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a code is of the root that has most codes of its node; such codes have nothing to find among each other."""
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(root))))
    order = np.lexsort((root, owner))
    r, o = root[order], owner[order]
    start = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])))
    by_size = np.lexsort((np.diff(np.append(start, len(r))), o[start]))
    last = by_size[np.append(o[start][1:] != o[start][:-1], True)]
    return root == r[start[last]][owner]


def texts_of(codes: DataFrame, rows: DataFrame, base: DataFrame) -> DataFrame:
    """(code, text) of the distinct ``codes``: texts are shuffled only for them, one for each code, so of thousands of copies
    one is looked up."""
    name = ["late", "key", "hash"]
    own = base.join(codes, "code").groupBy("code").agg(F.min(F.struct(F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("key"), "hash")).alias("n"))
    names = written(own.select("code", "n.*"), "names")
    bits = filter_bits(names.count())
    keyed = rows.select(F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("key"), "hash", "text")
    texts = passing(keyed, bitmap_filter(names, name, bits), name, bits).dropDuplicates(name)
    texts = written(texts.join(names, name).select("code", "text"), "texts")
    discard(names)
    return texts


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of codes whose texts are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            ok = [similarity_of(shingles(x.as_py(), width), shingles(y.as_py(), width)) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(texts.select(F.col("code").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("code").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(run, "a long, b long"), "links")


def _sorted(df: DataFrame, *key: str) -> DataFrame:
    return df.repartition(*key).sortWithinPartitions(*key, gray_rank(F.col("fp")), "code")


def candidates(one: DataFrame, roots: DataFrame, similarity: Fraction, most: int) -> DataFrame:
    """Pairs (a, b) of codes of different roots that share a node, differ in RADIUS bits or fewer, and whose sizes and counts
    allow the similarity: in each node the ``most`` nearest ones for each code; and the nodes that stay open.

    A root with more than NODE_ROWS codes is in parts: its codes never meet each other, so a node of theirs is dealt out by
    code, and the node's other codes come to each part.
    """
    find, kind = _across(similarity, most), "a long, b long, open long"
    # Few codes have links: only those that a bounded filter lets through are shuffled to find their roots.
    sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    bits = filter_bits(roots.count())
    marked = flagged(one, bitmap_filter(roots, ["code"], bits), ["code"], "_rooted", bits)
    found = marked.where("_rooted").join(roots.join(sizes, "root"), "code", "left")
    cols = ["code", "n", "fp", "counts", "nodes"]
    named = marked.where("NOT _rooted").select(*cols, F.col("code").alias("root"), F.lit(1).cast("long").alias("size"))
    named = named.unionByName(found.select(*cols, F.coalesce("root", "code").alias("root"), F.coalesce("size", F.lit(1).cast("long")).alias("size")))
    row = ["n", "code", "root", "size", "fp", "counts"]
    every = named.select(*row, F.explode("nodes").alias("key"))
    if sizes.where(F.col("size") > NODE_ROWS).isEmpty():
        return _sorted(every.select("key", F.lit(0).alias("part"), *row), "key", "part").mapInArrow(find, kind)
    parts = F.ceil(F.col("size") / NODE_ROWS).cast("int")
    small = every.where(F.col("size") <= NODE_ROWS).select("key", F.lit(0).cast("long").alias("part"), *row)
    dealt = every.where(F.col("size") > NODE_ROWS).select("key", F.col("root").alias("own"), parts.alias("parts"), *row)
    hot = written(dealt.select("key", "own", "parts").distinct(), "hot")
    bits = filter_bits(hot.count())
    others = passing(every, bitmap_filter(hot, ["key"], bits), ["key"], bits).join(hot, "key").where("root <> own")
    others = others.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slot"))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    # A part is named by the hash of its root and number.
    part = F.xxhash64("own", "slot").alias("part")
    both = small.unionByName(dealt.select("key", part, *row)).unionByName(others.select("key", part, *row))
    return _sorted(both, "key", "part").mapInArrow(find, kind)


def still_open(one: DataFrame, found: DataFrame) -> DataFrame | None:
    """The rows of ``one`` with only those of their nodes that are open; None if none is."""
    keys = written(found.where("open IS NOT NULL").select(F.col("open").alias("key")).distinct(), "open")
    n = keys.count()
    if not n:
        return None
    bits = filter_bits(n)
    every = one.select("code", "n", "fp", "counts", F.explode("nodes").alias("key"))
    some = passing(every, bitmap_filter(keys, ["key"], bits), ["key"], bits).join(keys, "key")
    some = written(some.groupBy("code").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts"), F.collect_list("key").alias("nodes")), "codes")
    discard(keys)
    return some


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(id, hash, group, component) of every row of ``df``: hash is that of its text, group names all that links between
    near-copies reach, component is the smallest id among them."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("hash"), t.alias("text"))
    base = written(sketches(rows, width), "sketches")
    one = written(base.select("code", "n", "fp", "counts", "nodes").dropDuplicates(["code"]), "codes")
    some = one.select("n", "code", "fp", "counts", F.explode(F.slice("nodes", 1, FIRST_TABLES)).alias("key"))
    rank = gray_rank(F.col("fp"))
    first = some.repartitionByRange("key", rank).sortWithinPartitions("key", rank, "code").select("key", "n", "code", "fp", "counts")
    tested = written(first.mapInArrow(_neighbours(similarity), "a long, b long").distinct(), "pairs")
    texts = texts_of(ends_of(tested), rows, base)
    links = verified(tested, texts, width, similarity)
    discard(texts)
    texts, most = None, FIRST_NEAREST
    while True:
        roots = written(components(links).withColumnRenamed("v", "code"), "roots")
        if one is None:
            break
        found = written(candidates(one, roots, similarity, most), "found")
        new = written(found.where("a IS NOT NULL").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if texts is None:
            # All codes take part in this round: those of its pairs are looked up.
            own = texts_of(ends_of(new), rows, base)
            more = verified(new, own, width, similarity)
            discard(own)
        else:
            more = verified(new, texts, width, similarity)
        left = still_open(one, found)
        discard(one)
        discard(found)
        discard(roots)
        if left is not None and texts is None:
            # Later rounds have no other codes than these.
            texts = texts_of(left.select("code"), rows, base)
        tested, links, one, most = tested.unionByName(new), links.unionByName(more), left, most * STEP
    if texts is not None:
        discard(texts)
    codes = base.groupBy("code").agg(F.min("id").alias("least"))
    rooted = written(codes.join(roots, "code", "left").select("code", "least", F.coalesce("root", "code").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = written(rooted.join(smallest, "root").select("code", F.col("root").alias("group"), "component"), "components")
    return base.select("id", "hash", "code").join(named, "code").select("id", "hash", "group", "component")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near-copies: the one with the smallest id, then the smallest hash of its text.
    Rows without an id come last. Rows that repeat both id and text are one row's copies."""
    name = ["late", "key", "hash"]
    # Of all tables, only that of the touched rows is read later.
    with scratch() as keep:
        groups = near_copies(df, id_col, text_col, width, similarity)
        groups = groups.select("group", F.col("id").isNull().alias("late"), F.coalesce("id", F.lit(0)).alias("key"), "hash")
        each = written(groups.groupBy("group", *name).agg(F.count(F.lit(1)).alias("rows")), "members")
        best = each.groupBy("group").agg(F.min(F.struct(*name)).alias("best"))
        touched = each.join(best, "group").select(*name, "rows", (F.struct(*name) == F.col("best")).alias("stays"))
        touched = keep(written(touched.where("NOT stays OR rows > 1"), "touched"))
    ids = F.col(f"`{id_col}`").cast("long")
    t = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    docs = df.select(_packed(df), ids.isNull().alias("late"), F.coalesce(ids, F.lit(0)).alias("key"), t.alias("hash"))
    # A filter of bounded size tells most rows that stay at once; the rest are looked up.
    bits = filter_bits(touched.count())
    marked = flagged(docs, bitmap_filter(touched, name, bits), name, "_touched", bits)
    found = marked.where("_touched").join(touched, name, "left")
    once = found.where("stays").dropDuplicates(name)
    rest = marked.where("NOT _touched").select("_in").unionByName(found.where("stays IS NULL").select("_in")).unionByName(once.select("_in"))
    return rest.select(*_unpacked(df))
