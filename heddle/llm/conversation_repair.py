"""Repair of the structure of conversations, by deduplicated signatures.

A row of a conversation becomes one letter, for the initial of its role and its first fault, and a conversation a string
of them, cut every SEGMENT letters: its signatures. Each distinct signature is solved once, by memoised recursion, for
each state in which it may be entered and left; the cheapest edits of a conversation are then the cheapest way through
the answers of its signatures. The edits are joined back by conversation and replayed over its rows.

Edits: Keep costs 0, Rerole (to user or assistant, whichever is due) 3, Delete 4, Insert (a user or assistant row without
text) 3; a truncated row that isn't deleted costs 3 more; blank and duplicate rows must be deleted. What is left is empty, or an
optional system row and then pairs of user and assistant. Of the cheapest audits the least in ASCII order is taken.

Scale: letters are made without texts and dealt out by ranges of conversation and turn, so rows of one huge conversation
are ordered and encoded by many tasks; copies of a row fold into one with a count before any shuffle; duplicates are
found by a grouped minimum, not by a window. Only two things run through one conversation at a time, as streams over sorted
rows that hold nothing but the audits: the way through its signatures (a row for every SEGMENT rows), and the replay, whose
contract asks for one SHA-256 over all repaired rows, which has to read them in order.

Defined results: a null role or text is one space; null conversation ids are one conversation; null turns come first; rows
of one turn go by role, then by the SHA-256 of their text, so copies are adjacent; long texts count whole; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import discard, slices, table, written

#: Rows of a signature at most: the depth of the recursion.
SEGMENT = 200
#: Classes of roles by their initial, and faults; a letter is A plus four times the class plus the fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: What the repaired rows so far are: none, or ending in a system, user or assistant row.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: The state after a row that is inserted or given the role that is due.
DUE = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
#: The state after a row that keeps its role, by state and class.
KEPT = {(START, SYSTEM): AFTER_SYSTEM, (START, USER): AFTER_USER, (AFTER_SYSTEM, USER): AFTER_USER, (AFTER_USER, ASSISTANT): AFTER_ASSISTANT, (AFTER_ASSISTANT, USER): AFTER_USER}
#: What ends a conversation in each state: cost and edits.
LAST = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
WHITE = " \t\n\x0b\x0c\r"


def letter(kind: int, fault: int) -> str:
    return chr(65 + 4 * kind + fault)


def row_of(sign: str) -> tuple[int, int]:
    """Class and fault of a letter."""
    return divmod(ord(sign) - 65, 4)


def solve(signature: str) -> list[list[tuple[int, str] | None]]:
    """For each state before and each state after the rows: the cheapest, then least edits that lead there, if any.

    An insertion belongs to the row it precedes, so an audit ends with the edit of the last row and none is the beginning
    of another. One before a deletion is never least, and two before one row are never cheapest.
    """

    @cache
    def rest(at: int, state: int) -> tuple:
        if at == len(signature):
            return tuple((0, "") if after == state else None for after in range(STATES))
        kind, fault = row_of(signature[at])
        ways = [(DELETE, "D", state)]
        if fault < BLANK:
            mend = MEND if fault == TRUNCATED else 0
            for cost, edits, now in ((0, "", state), (INSERT, "I", DUE[state])):
                ways.append((cost + mend + REROLE, edits + "R", DUE[now]))
                if (now, kind) in KEPT:
                    ways.append((cost + mend + KEEP, edits + "K", KEPT[now, kind]))
        best: list = [None] * STATES
        for cost, edits, now in ways:
            for after, way in enumerate(rest(at + 1, now)):
                if way and (best[after] is None or (cost + way[0], edits + way[1]) < best[after]):
                    best[after] = (cost + way[0], edits + way[1])
        return tuple(best)

    return [list(rest(0, state)) for state in range(STATES)]


def counts_of(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and adjacent roles that don't follow each other."""
    rows = [row_of(x) for x in signature]
    faults = [f for _, f in rows]
    illegal = sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def _turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, digest): rows with what nulls stand for and the key that orders rows of a turn."""
    space = F.lit(" ")
    n = F.coalesce(F.col("n").cast("long"), F.lit(1)) if "n" in df.columns else F.lit(1).cast("long")
    out = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), n.alias("n"))
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _letters(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, kind, fault): a row for each distinct turn, role and text."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    look = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    light = turns.select("conv_id", "turn", "role", "digest", "n", look.alias("look"))
    light = written(light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("look").alias("look")), "turns")
    key = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(key).alias("first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    both = light.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    fault = F.when(F.col("look") == BLANK, BLANK).when(F.col("first") < key, DUPLICATE).otherwise(F.col("look"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    out = both.select("conv_id", "turn", "role", "digest", "n", kind.alias("kind"), fault.alias("fault"))
    out._source = light
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of sorted rows, in order; a conversation without rows has an empty one."""
    names = ["conv_id", "turn", "role", "digest", "seq", "signature", "first_turn", "last_turn", "n_turns"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    out: list[tuple] = []
    conv, key, seq, sig, first, last, turns = None, None, 0, "", None, None, 0

    def close() -> None:
        out.append((conv, *key, seq, sig, first, last, turns))

    for batch in batches:
        for c, turn, role, digest, n, kind, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key is None or c != conv:
                if key is not None:
                    close()
                conv, key, seq, sig, first, last, turns = c, (turn, role, digest), 0, "", None, None, 0
            again = letter(kind, BLANK if fault == BLANK else DUPLICATE)
            rows = n
            while rows > 0:
                if len(sig) == SEGMENT:
                    close()
                    key, seq, sig, first, last, turns = (turn, role, digest), seq + 1, "", None, None, 0
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
                k = min(rows, SEGMENT - len(sig))
                sig += (letter(kind, fault) if rows == n else again) + again * (k - 1)
                rows -= k
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out.clear()
    if key is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of signatures: for each pair of states the cost, null if there is no way, and the edits."""
    for batch in slices(batches, 500):
        signatures = batch.column(0).to_pylist()
        ways = [[way for before in solve(s) for way in before] for s in signatures]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([[w and w[0] for w in x] for x in ways], pa.list_(pa.int64())), pa.array([[w and w[1] for w in x] for x in ways], pa.list_(pa.string())),
                pa.array([list(counts_of(s)) for s in signatures], pa.list_(pa.int64())),
            ],
            names=["signature", "costs", "audits", "counts"],
        )


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest way through the signatures of each conversation, which come in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.int64()] * 7 + [pa.string()]
    out: list[tuple] = []
    conv, known, best, counts, edge = None, False, None, [0] * 4, None
    low = high = None
    distinct = 0

    def close() -> None:
        cost, audit = min((c + LAST[s][0], a + LAST[s][1]) for s, (c, a) in best.items())
        out.append((conv, high - low + 1 - distinct if low is not None else 0, *counts, cost, audit))

    for batch in batches:
        for c, signature, costs, audits, own, first, last, turns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not known or c != conv:
                if known:
                    close()
                conv, known, best, counts, edge, low, high, distinct = c, True, {START: (0, "")}, [0] * 4, None, None, None, 0
            after: dict[int, tuple[int, str]] = {}
            for before, (cost, audit) in best.items():
                for state in range(STATES):
                    if (k := costs[STATES * before + state]) is not None:
                        way = (cost + k, audit + audits[STATES * before + state])
                        after[state] = min(after.get(state, way), way)
            best = after
            counts = [a + b for a, b in zip(counts, own, strict=True)]
            if signature:
                counts[3] += edge is not None and (edge, row_of(signature[0])[0]) not in LEGAL
                edge = row_of(signature[-1])[0]
            if first is not None:
                distinct += turns - (first == high)
                low, high = first if low is None else low, last
        if len(out) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
    if known:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def audits(df: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``df`` (conv_id, turn, role,
    text, and optionally n: how often a row stands there; 0 only names its conversation)."""
    letters = _letters(_turns(df))
    order = ["conv_id", "turn", "role", "digest"]
    light = letters.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "conv_id long, turn long, role string, digest binary, seq long, signature string, first_turn long, last_turn long, n_turns long"
    cut = written(light.select(*order, "n", "kind", "fault").mapInArrow(_signatures, kinds), "signatures")
    discard(letters._source)
    answers = cut.select("signature").distinct().mapInArrow(_solved, "signature string, costs array<long>, audits array<string>, counts array<long>")
    ways = cut.join(answers, "signature").repartition("conv_id").sortWithinPartitions(*order, "seq")
    return ways.select("conv_id", "signature", "costs", "audits", "counts", "first_turn", "last_turn", "n_turns").mapInArrow(
        _audited, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    )


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order; position 0 is the head of a conversation, without role and text."""
    edits, body, at, state, position = "", 0, 0, START, 0
    names = ("", "", "user", "assistant")
    for batch in slices(batches, 500):
        out: list[tuple] = []

        def put(role: str | None, text: str | None) -> None:
            out.append((conv, position, role, text))

        for conv, audit, role, text, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if audit is not None:
                edits, body, at, state, position = audit, len(audit.rstrip("I")), 0, START, 0
                put(None, None)
            for _ in range(n):
                while edits[at] == "I":
                    state, position, at = DUE[state], position + 1, at + 1
                    put(names[state], "")
                edit, at = edits[at], at + 1
                if edit == "D":
                    continue
                position += 1
                if edit == "R":
                    state = DUE[state]
                    put(names[state], text)
                else:
                    state = AFTER_SYSTEM if role[0] == "s" else AFTER_USER if role[0] == "u" else AFTER_ASSISTANT
                    put(role, text)
            # After the last row nothing but insertions is left.
            if at == body:
                while at < len(edits):
                    state, position, at = DUE[state], position + 1, at + 1
                    put(names[state], "")
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "position", "role", "text"])


def _replay(df: DataFrame, audit: DataFrame) -> DataFrame:
    """Repaired rows, each conversation in one partition and in order, after its head."""
    rows = _turns(df).where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "n", F.lit(None).cast("string").alias("audit"))
    null = F.lit(None)
    heads = audit.select("conv_id", F.lit(0).alias("kind"), null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("binary").alias("digest"), null.cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "audit")
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return both.select("conv_id", "audit", "role", "text", "n").mapInArrow(_replayed, "conv_id long, position long, role string, text string")


def repaired(df: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, role, text): the rows that are left of every conversation, from position 1."""
    return _replay(df, audits(df) if audit is None else audit).where("position > 0")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the rows of each conversation, ``role:text`` joined by newlines."""
    conv, known, digest = None, False, None
    for batch in batches:
        out = []
        for c, position, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if position == 0:
                if known:
                    out.append((conv, digest.hexdigest()))
                conv, known, digest = c, True, hashlib.sha256()
            else:
                digest.update(("\n" * (position > 1) + f"{role}:{text}").encode())
        columns = list(zip(*out, strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["conv_id", "repaired_sha256"])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def digests(df: DataFrame, audit: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of every conversation."""
    return _replay(df, audit).mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of conversations, damaged by the checksum of conversation and turn: n is 0 for a row that
    is dropped and 2 for one that is repeated; others lose their text, their ends of sentences or their role."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    return df.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: their faults, the edits, and the digest of what is left."""
    turns = damaged(table(spark, sf_dir, "conversations"))
    audit = written(audits(turns), "audits")
    digest = digests(turns, audit.select("conv_id", "audit")).withColumnRenamed("conv_id", "_conv")
    return audit.join(digest, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
