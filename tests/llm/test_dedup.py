"""Near, line, exact and substring deduplication against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import exact_dedup as E
from heddle.llm import line_dedup as L
from heddle.llm import simhash as S
from heddle.llm import substring_dedup as U
from heddle.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents").fetchall()


def linked(codes, radius=3):
    """Smallest place that each code is connected with, by comparing all pairs."""
    codes = np.asarray(codes, dtype=np.uint64)
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[:i]) <= radius):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# --- op1 ------------------------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark, duck):
    docs = sorted(documents(duck))
    want = [plain_fingerprint(t) for _, t in docs]
    root = linked(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == {d: (f"{f:016x}", docs[k][0]) for (d, _), f, k in zip(docs, want, root, strict=True)}


def test_gray_rank_orders_gray_codes(spark):
    df = spark.range(256).select(F.col("id"), F.col("id").bitwiseXOR(F.shiftright("id", 1)).alias("g"))
    assert df.where(S.gray_rank(F.col("g")) != F.col("id")).count() == 0


@pytest.mark.parametrize("n", [5, 60, 700, 3000])
def test_page_index_finds_every_link(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, size=max(1, n // 20), dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) for _ in range(19)]]))
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    assert list(S.forest(len(codes), S.GrayIndex(codes, np.array([0])).links(3))) == linked(codes)


def test_dense_group_is_factored_and_stays_linear(spark):
    rng = random.Random(1)
    codes = {0}
    while len(codes) < 1500:
        codes.add(rng.choice(tuple(codes)) ^ (1 << rng.randrange(40)))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = S.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    assert links.count() <= 4 * 3 * 4 * len(codes)
    assert {r.root for r in S.components(links).collect()} == {0}


def test_simhash_odd_rows(odd, empty):
    got = S.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.component for r in got if r.fp == 0}
    assert zero == {3}
    assert {r.component for r in got if r.id in (1, 2)} == {1}
    assert S.near_duplicates(empty).collect() == []


# --- op3 ------------------------------------------------------------------------------------------------------------


def test_line_dedup_odd_rows(odd, empty):
    out = {(r.doc_id, r.text) for r in L.line_dedup(odd).collect()}
    texts = dict(out - {(None, None)})
    assert texts[2] == "" and texts[1].startswith("First") and texts[4] == "" and texts[3] is None
    assert any(d is None and t for d, t in out)
    assert L.line_dedup(odd).columns == odd.columns
    assert L.line_dedup(empty).count() == 0


# --- op4 ------------------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_sql(spark, duck, same):
    same(QUERIES["op4_exact_dedup"](spark, SF), duck.sql(ORACLE_SQL["op4_exact_dedup"]))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_compares_bytes(odd, keep):
    weak = E.exact_dedup(odd, keep=keep, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1))
    full = E.exact_dedup(odd, keep=keep)
    cols = ["doc_id", "keep_id", "group_size", "kept"]
    key = lambda r: str(tuple(r))
    assert sorted(weak.select(cols).collect(), key=key) == sorted(full.select(cols).collect(), key=key)
    one = [r for r in full.collect() if r.doc_id == 2]
    assert [r.group_size for r in one] == [4, 4] and sum(r.kept for r in one) == (keep == "largest")


def test_index_runs_compact(spark):
    index = E.DigestIndex("smallest")
    for rows in ([("a", 5), ("b", 2)], [("a", 3), ("c", None)]):
        index.flush(spark.createDataFrame(rows, "digest string, id long"))
    assert sorted(map(tuple, index.compact().collect())) == [("a", 3, 2), ("b", 2, 1), ("c", None, 1)]
    assert [r.digest for r in index.hits().collect()] == ["a"]
    with pytest.raises(ValueError):
        E.DigestIndex("any")


@pytest.mark.parametrize("fan_in", [2, 64])
def test_memtables_are_sorted_runs_that_merge_in_tiers(spark, monkeypatch, fan_in):
    monkeypatch.setattr(E, "FAN_IN", fan_in)
    rows = spark.range(600).select((F.col("id") % 217).cast("string").alias("digest"), "id").repartition(9, "id")
    index = E.DigestIndex("largest")
    index.flush(rows)
    assert index.count == 9 and "Exchange" not in rows.sortWithinPartitions("digest")._jdf.queryExecution().optimizedPlan().toString()
    for path in index.runs.inputFiles():
        run = [r.digest for r in spark.read.parquet(path).collect()]
        assert run == sorted(run)
    got = {r.digest: (r.id, r.n) for r in index.compact().collect()}
    assert got == {str(k): (max(range(k, 600, 217)), len(range(k, 600, 217))) for k in range(217)}
    assert {r.digest for r in index.hits().collect()} == {str(k) for k in range(217)}


def test_exact_dedup_of_nothing(empty):
    assert E.exact_dedup(empty).count() == 0


# --- op9 ------------------------------------------------------------------------------------------------------------


def brute_spans(docs):
    """Runs of repeated units, extended word by word beside what they repeat."""
    texts, first, seen = {d: t or "" for d, t in docs}, {}, []
    for d in sorted(texts):
        for no, (a, b, n, u) in enumerate(U.units(texts[d])):
            again = u in first
            if not again:
                first[u] = (d, no, a)
            seen.append((d, no, a, b, n, u, again))

    def beside(d, no, back):
        """Words of the sentence of a unit, up to its end or from its start."""
        at = 0
        for m in U.SENTENCE.finditer(texts[d]):
            own = U.units(m.group())
            if own and at <= no < at + len(own):
                a, b, n, _ = (x for x in own[no - at])
                words = [(w.group().lower(), w.start(), w.end()) for w in U.WORD.finditer(texts[d], m.start() + (0 if back else a), m.start() + b if back else m.end())]
                return words[-max(U.LONG, n) :] if back else words[: max(U.LONG, n)]
            at += len(own)
        return []

    def shared(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n][0] == y[n][0]:
            n += 1
        return n

    out, run, last = set(), [], (None, 0)
    for x in [*seen, None]:
        if run and (x is None or not x[6] or x[0] != run[-1][0] or x[1] != run[-1][1] + 1):
            d, start, end, words = run[0][0], run[0][2], run[-1][3], sum(r[4] for r in run)
            if words >= U.ANCHOR:
                kept, kept_last = first[run[0][5]], first[run[-1][5]]
                before, after = beside(d, run[0][1] - 1, True), beside(d, run[-1][1] + 1, False)
                if k := shared(before[::-1], beside(kept[0], kept[1] - 1, True)[::-1]):
                    start, words = before[-k][1], words + k
                if k := shared(after, beside(kept_last[0], kept_last[1] + 1, False)):
                    end, words = after[k - 1][2], words + k
                start = max(start, last[1]) if last[0] == d else start
                last = (d, max(end, last[1]) if last[0] == d else end)
                if start < end and words >= U.MIN_WORDS:
                    out.add((d, start, end, words, kept[0], kept[2]))
            run = []
        if x is not None and x[6]:
            run.append(x)
    return out


def test_spans_equal_brute_force(spark, duck):
    got = {tuple(r) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()}
    assert got == brute_spans(documents(duck)) and got


@pytest.mark.parametrize("mark", [". ", " "])
def test_planted_passages_go_but_for_the_first(spark, mark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: mark.join(" ".join(word() for _ in range(9)) for _ in range(n)) + "."
    passage = text(8)
    rows = [(i, f"{text(4)} {word()} {passage} {text(3)}") for i in range(6)] + [(9, text(12))]
    got = U.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id for r in got} == {1, 2, 3, 4, 5}
    texts = dict(rows)
    assert all(texts[r.id][r.start : r.end].strip() in passage for r in got)
    assert all(sum(r.words for r in got if r.id == i) >= 25 for i in range(1, 6))


@pytest.mark.parametrize(("sentence", "passage"), [(0, 51), (0, 80), (25, 55), (40, 55), (12, 55), (24, 51), (30, 60), (60, 150)])
def test_passages_of_over_50_words_go_whole(spark, sentence, passage):
    """Pairs of texts that share one passage, cut anywhere: by words alone, without the cutter under test. Other texts stay."""
    rng = random.Random(sentence * 100 + passage)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def marked(words, shift):
        return [w + "." if sentence and (i + shift) % sentence == 0 else w for i, w in enumerate(words)]

    rows, shared = [], {}
    for i in range(60):
        own = marked([word() for _ in range(passage)], rng.randrange(100))
        for k in (2 * i, 2 * i + 1):
            left, right = (marked([word() for _ in range(rng.randrange(30, 120))], rng.randrange(100)) for _ in range(2))
            rows.append((k, " ".join([*left, *own, *right])))
            shared[k] = (len(" ".join(left)) + 1, len(" ".join([*left, *own])))
    got = {}
    for r in U.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    assert not [k for k in got if k % 2 == 0]
    gone = []
    for k in range(1, 120, 2):
        a, b = shared[k]
        text = rows[k][1]
        taken = sum(len(text[max(a, s) : min(b, e)].split()) for s, e in got.get(k, []))
        # Nothing beyond the passage goes, but for a sign or a space at its edge.
        assert sum(len(text[s:e].split()) for s, e in got.get(k, [])) <= passage + 1
        gone.append(min(1, taken / passage))
    assert sum(gone) / len(gone) >= 0.95 and sum(g < 0.9 for g in gone) <= 3


def test_substring_dedup_odd_rows(odd, empty):
    out = U.substring_dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert U.substring_dedup(empty).count() == 0
