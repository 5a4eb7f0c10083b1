"""Near-copies against all pairs of texts."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from heddle.llm import near_copies as N


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(texts, least=0.8):
    """Smallest place that each text is connected with, by comparing all pairs of sets of five words."""
    sets, label = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def copies(n=60, each=4, seed=5):
    """Texts, each with some copies in which words are replaced until the similarity nears 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice((30, 80, 200, 600)))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(each):
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, len(v) // rng.choice((50, 60, 100)))):
                v[at] = word()
            rows.append((len(rows), " ".join(v)))
    return rows


@pytest.mark.parametrize("node_rows", [4096, 2])
def test_near_copies_are_found_and_no_others(spark, monkeypatch, node_rows):
    monkeypatch.setattr(N, "NODE_ROWS", node_rows)
    rows = copies()
    want = groups([t for _, t in rows])
    got = {r.id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    away = [i for i, k in enumerate(want) if k != i]
    assert np.mean([got[i] == want[i] for i in away]) >= 0.95
    assert all(want[got[i]] == want[i] for i in got)


def test_pairs_on_both_sides_of_the_threshold(spark):
    base = [f"w{i}" for i in range(104)]
    far = base[:89] + [f"x{i}" for i in range(15)]  # 85 of 100 shingles shared: 85 / 115
    near = base[:94] + [f"y{i}" for i in range(10)]  # 90 / 110
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(near))]
    assert [float(N.similarity_of(N.shingles(rows[0][1]), N.shingles(t))) for _, t in rows[1:]] == [85 / 115, 90 / 110]
    got = {r.id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == 2 and got[1] == 1


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, "c " * 9), (None, None), (None, ""), (7, "one two three four five six")]
    out = N.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(3, a), (5, b), (None, "c " * 9), (7, rows[-1][1]), next(r for r in map(tuple, out) if not r[1])], key=str)


def test_sets_are_compared_exactly():
    assert N.similarity_of(N.shingles("a b c d e f"), N.shingles("a b c d e f")) == 1
    assert N.similarity_of(N.shingles(""), N.shingles(None)) == 1 and N.similarity_of(N.shingles("a"), N.shingles("")) == 0
    assert N.similarity_of(N.shingles("a b c d e f"), N.shingles("A B C D E G")) == Fraction(1, 3)


def test_near_copies_odd_rows(odd, empty):
    got = N.near_copies(odd)
    assert got.count() == odd.count() and N.near_copies(empty).count() == 0
    rows = {(r.id, r.component) for r in got.collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 3), (None, 3), (8, 8)} <= rows
    left = N.without_near_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 6, 7, 8, 10]  # 9 shares 20 of 25 shingles with 1
    assert N.without_near_copies(empty).count() == 0


def test_counts_refuse_no_similar_pair():
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 4, 9, 60, 400, 3000):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for share in (0, 0.02, 0.05, 0.1, 0.15, 0.3, 0.6):
            fresh = np.unique(rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64))
            sets.append(np.union1d(own[rng.random(len(own)) >= share], fresh))
    n = np.array([len(s) for s in sets], dtype=np.int32)
    counts = N._counts(pa.chunked_array([pa.array([N.range_counts(s) for s in sets], pa.binary())]))
    x, y = np.triu_indices(len(sets), 1)
    alike = np.array([N.similarity_of(sets[i], sets[j]) >= N.SIMILARITY for i, j in zip(x, y, strict=True)])
    ok = N._allowed(n, counts, x, y, N.SIMILARITY)
    assert ok[alike].all() and alike.sum() > 20
    assert ok[~alike].mean() < 0.5


def test_index_finds_all_pairs_in_which_a_code_asks():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 40, 700, 3]
    first = np.cumsum([0, *sizes[:-1]])
    codes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64) & np.uint64(0xFFFF)
    root = rng.integers(0, 3, len(codes))
    most = N._most_of(root, first)
    for f, s in zip(first, sizes, strict=True):
        own = root[f : f + s]
        kept = np.unique(own[most[f : f + s]])
        assert len(kept) == 1 and (own == kept[0]).sum() == np.bincount(own).max() == most[f : f + s].sum()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    i, j = np.triu_indices(len(codes), 1)
    want = (owner[i] == owner[j]) & (np.bitwise_count(codes[i] ^ codes[j]) <= 5)
    for asks in (None, ~most):
        some = want if asks is None else want & (asks[i] | asks[j])
        got = [(min(a, b), max(a, b)) for x, y in N.GrayIndex(codes, first).links(5, asks) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(got) == sorted(zip(i[some].tolist(), j[some].tolist(), strict=True))


def test_pair_in_a_family_of_one_template(spark):
    """Hundreds of texts that are almost near-copies of each other hide no pair that is one, whatever else links."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))

    def changed(text, n):
        out = list(text)
        for at in rng.sample(range(0, len(out) // 10), n):
            out[10 * at + rng.randrange(10)] = word()
        return out

    template = [word() for _ in range(400)]
    texts = [changed(template, 9) for _ in range(600)]
    texts += [changed(texts[i], 7) for i in (17, 300, 599)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = groups([t for _, t in rows])
    assert want[600:] == [17, 300, 599] and sum(k != i for i, k in enumerate(want)) < 30
    got = {r.id: r.component for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(rows))] == want
