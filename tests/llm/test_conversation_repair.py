"""Conversation repair against a search over all edits, and its odd cases."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from heddle.llm import conversation_repair as C

WHITE = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string"


def faults(rows):
    """First fault of each row (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, edits, roles and texts) by uniform-cost search over all sequences of edits."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits, out
        if (i, last) in done:
            continue
        done.add((i, last))
        for name in ("user", "assistant"):
            if name[0] in legal[last]:
                heapq.heappush(heap, (cost + 3, edits + "I", i, name[0], (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last, out))
            if found[i] in ("", "truncated"):
                more = 3 * (found[i] == "truncated")
                if role[:1] and role[0] in legal[last]:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[0], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in legal[last]:
                        heapq.heappush(heap, (cost + more + 3, edits + "R", i + 1, name[0], (*out, (name, text))))
    raise AssertionError("no way")


def expected(rows):
    """conv_id to what the contract says of it, from original rows."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        text = "" if at == 1 else "".join(x for x in text if x not in ".!?") if at == 2 else text
        role = "user" if at == 4 else role
        own += [(turn, role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        rows = [r[1:] for r in own]
        turns = {r[0] for r in own if r[0] is not None}
        found = faults(rows)
        cost, edits, left = cheapest(rows, found)
        initials = [r[0][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    turns = C.damaged(df)
    audit = C.audits(turns)
    both = audit.join(C.digests(turns, audit.select("conv_id", "audit")).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")))
    rows = both.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}


def odd_rows(convs, longest, seed):
    draw = random.Random(seed)
    out = []
    for conv in [*range(convs), None]:
        turn = 0
        for _ in range(draw.randrange(longest)):
            turn += draw.choice((0, 1, 1, 1, 2))
            role = draw.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = draw.choice(("Yes.", "No", " \t\n", "", None, "What?\x0b", "A long answer!", f"Number {turn}.", "é 日"))
            out.append((conv, draw.choice((turn, turn, turn, None)), role, text))
        if out and draw.random() < 0.3:
            out.append(out[-1])
    return out


def test_signatures_equal_search():
    draw = random.Random(5)
    for _ in range(1500):
        n = draw.randrange(9)
        rows = [(draw.choice(("system", "user", "assistant", "tool")), draw.choice(("Yes.", "No", f"{i}.", f"{i}")) if draw.random() < 0.9 else " ") for i in range(n)]
        found = faults(rows)
        kinds = {"s": 0, "u": 1, "a": 2, "t": 3}
        sign = "".join(C.letter(kinds[r[0]], ("", "truncated", "blank", "duplicate").index(f)) for (r, _), f in zip(rows, found, strict=True))
        ways = [(w[0] + C.LAST[s][0], w[1] + C.LAST[s][1]) for s, w in enumerate(C.solve(sign)[C.START]) if w]
        assert min(ways) == cheapest(rows, found)[:2]


@pytest.mark.parametrize("segment", [200, 3])
def test_repair_equals_search(spark, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = odd_rows(60, 12, segment)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for name in ("n", "kind", "digest", "_c", "first", "state", "position"):
        if name != "n":
            df = df.selectExpr("*", f"'x' AS `{name}`")
    want = expected(rows)
    assert result(df) == want
    left = C.repaired(C.damaged(df)).collect()
    for conv, own in want.items():
        text = "\n".join(f"{r.role}:{r.text}" for r in sorted((r for r in left if r.conv_id == conv), key=lambda r: r.position))
        assert hashlib.sha256(text.encode()).hexdigest() == own[-1]


def test_one_long_conversation(spark):
    """Longer than several signatures, with copies in the thousands and a very long text."""
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 7 else "tool", f"Text {t // 3}.") for t in range(900)]
    rows += [(1, 50, "user", "Again.")] * 3000 + [(1, 901, "user", "word " * 200_000)]
    assert result(spark.createDataFrame(rows, KIND).repartition(6)) == expected(rows)


def test_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert result(empty) == {} and C.repaired(C.damaged(empty)).count() == 0
    # A conversation of which every row is dropped.
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert result(spark.createDataFrame([(conv, 1, "user", "Hi.")], KIND)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_equals_search(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.conv_id: tuple(r[n] for n in NAMES) for r in C.op12_conversation_repair(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert out == expected(rows)
