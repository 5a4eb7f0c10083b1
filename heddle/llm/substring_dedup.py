"""Substring deduplication by hashes of lines and their parts.

Units are lines, cut at the ends of sentences; a sentence of more than LONG words, as in text without punctuation, is cut
again after words whose own hash says so, which shifts with the words. Units are normalised (lower case, single spaces)
and their 128-bit digests grouped over all documents. The first occurrence by (id, place) stays. Runs of consecutive repeated
units of ANCHOR words or more are extended word by word on both sides, against what stands beside the occurrences they
repeat; as the units there are no repeats of each other, an extension ends within their sentences. A run of MIN_WORDS words or more
then goes, so short common sentences stay; spans are offsets into the original text, in code points.

A passage of 50 words holds whole units of ANCHOR words together however its sentences are cut: a sentence of LONG words fits
into it whole wherever it begins, and longer ones are cut at one word in PIECE.

Defined results: a null text is empty and has no units; rows with a null id come last in rank and keep their text; rows
that repeat id and text are one occurrence; a very long text is read whole, its units leave in blocks; other columns keep
their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import bitmap_filter, discard, in_batches, passing, table, without_spans, written

#: Words above which a sentence is cut again, mean words of such a piece, words of a run that is extended, and words a removed
#: run needs.
LONG, PIECE, ANCHOR, MIN_WORDS = 24, 8, 10, 20
#: Bits of the filter for repeated digests: 8 MB.
FILTER_BITS = 1 << 26

SENTENCE = re.compile(r"[^.!?\n]*[.!?]+[\"')\]]*|[^.!?\n]+")
WORD = re.compile(r"\S+")


Unit = tuple[int, int, int, str]


def sentences(text: str) -> Iterator[list[Unit]]:
    """The units (start, end, words, normalised unit) of each sentence of a text, in order."""
    for m in SENTENCE.finditer(text):
        found = m.group().split()
        if not found:
            continue
        if len(found) <= LONG:
            yield [(m.start(), m.end(), len(found), " ".join(found).lower())]
            continue
        out, start, n, base, piece = [], m.start(), 0, m.start(), []
        for w in WORD.finditer(m.group()):
            low = w.group().lower()
            piece.append(low)
            n += 1
            if crc32(low.encode("utf-8", "surrogatepass")) % PIECE == 0:
                out.append((start, base + w.end(), n, " ".join(piece)))
                start, n, piece = base + w.end(), 0, []
        if n:
            out.append((start, m.end(), n, " ".join(piece)))
        yield out


def units(text: str) -> list[Unit]:
    """All units of a text, in order."""
    return [u for own in sentences(text) for u in own]


Context = tuple[list[str], list[int], list[int]]


def contexts(text: str, before: set[int], after: set[int]) -> Iterator[tuple[int, bool, Context]]:
    """For units by number: the lower-case words of its sentence up to its end (``before``), or from its start on, with their
    places; those of the unit, or LONG words where the sentence has as many.

    Of two texts that share a passage one may have its edge in a sentence short enough to be one unit, the other in a longer one
    that is cut; LONG words bridge the two.
    """
    no = 0
    for own in sentences(text):
        for i, (start, end, n, _) in enumerate(own):
            for wanted, back in ((before, True), (after, False)):
                if no + i in wanted:
                    found, k, j = [], 0, i
                    while 0 <= j < len(own) and (j == i or k < LONG):
                        k += own[j][2]
                        j += -1 if back else 1
                    a, b = (own[j + 1][0], end) if back else (start, own[j - 1][1])
                    found = list(WORD.finditer(text, a, b))
                    found = found[-max(LONG, n) :] if back else found[: max(LONG, n)]
                    yield no + i, back, ([w.group().lower() for w in found], [w.start() for w in found], [w.end() for w in found])
        no += len(own)


def unit_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, no, start, end, words, d1, d2) of the units of all rows of ``df``."""
    names = ["id", "hash", "no", "start", "end", "words", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        def batch_of(cols: list[list], digests: list[bytes]) -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=names)

        for batch in batches:
            cols, digests = [[] for _ in range(6)], []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for no, (start, end, n, unit) in enumerate(units(text.as_py() or "")):
                    for c, v in zip(cols, (doc, h, no, start, end, n), strict=True):
                        c.append(v)
                    digests.append(xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
                if len(digests) > 50_000:
                    yield batch_of(cols, digests)
                    cols, digests = [[] for _ in range(6)], []
            if digests:
                yield batch_of(cols, digests)

    t = F.col(f"`{text_col}`")
    rows = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), t.alias("text"))
    return rows.mapInArrow(run, "id long, hash long, no int, start int, end int, words int, d1 long, d2 long")


def unit_words(df: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, no, back, words, starts, ends): the ``contexts`` of the ``wanted`` units (id, hash, no, back). Texts are cut again
    only where a bounded filter lets them through."""
    t = F.col(f"`{text_col}`")
    rows = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), t.alias("text"))
    owners = wanted.select("id", "hash").distinct()
    rows = passing(rows, bitmap_filter(owners, ["id", "hash"], FILTER_BITS), ["id", "hash"], FILTER_BITS)
    # Rows that repeat id and text are cut once. The units that are wanted of a row are at most those it has.
    numbers = lambda back: F.collect_set(F.when(F.col("back") == back, F.col("no")))
    asked = wanted.groupBy("id", "hash").agg(numbers(True).alias("before"), numbers(False).alias("after"))
    rows = rows.dropDuplicates(["id", "hash"]).join(asked, ["id", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out: list[tuple] = []
            for doc, h, text, before, after in zip(*(batch.column(i) for i in range(5)), strict=True):
                for no, back, found in contexts(text.as_py() or "", set(before.as_py()), set(after.as_py())):
                    out.append((doc.as_py(), h.as_py(), no, back, *found))
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    names = ["id", "hash", "no", "back", "words", "starts", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return rows.select("id", "hash", "text", "before", "after").mapInArrow(run, "id long, hash long, no int, back boolean, words array<string>, starts array<int>, ends array<int>")


def alike(a: Column, b: Column, backwards: bool) -> Column:
    """How many words two arrays share from the front, or from the back."""
    a, b = (F.reverse(a), F.reverse(b)) if backwards else (a, b)
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    # The place of the first difference, or all of the shorter one.
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span to remove: id, hash (of its row's text), start, end, words, keep (rank of what its first unit
    repeats).

    Digests fold before they are shuffled; only units that a bounded filter of repeated digests lets through are joined
    with them, and runs are found per document.
    """
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "hash", "no", "start")
    rows = written(unit_rows(df, id_col, text_col), "units")
    often = rows.groupBy("d1", "d2").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("n"))
    often = written(often.where("n > 1").select("d1", "d2", "keep"), "digests")
    some = passing(rows, bitmap_filter(often, ["d1", "d2"], FILTER_BITS), ["d1", "d2"], FILTER_BITS)
    later = some.join(often, ["d1", "d2"]).where(F.col("id").isNotNull() & ~rank.eqNullSafe(F.col("keep")))
    # Rows that repeat id and text give equal units: one of each is enough.
    later = written(later.select("id", "hash", "no", "start", "end", "words", "keep"), "later")
    discard(rows)
    discard(often)
    later = later.dropDuplicates(["id", "hash", "no"])
    island = F.col("no") - F.row_number().over(Window.partitionBy("id", "hash").orderBy("no"))
    runs = later.withColumn("island", island).groupBy("id", "hash", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("no").alias("first"), F.max("no").alias("last"),
        F.min_by("keep", "no").alias("keep"), F.max_by("keep", "no").alias("kept_last"),
    )
    runs = written(runs.where(F.col("words") >= ANCHOR).drop("island"), "runs")
    return extended(df, runs, id_col, text_col).where(F.col("words") >= min_words).select("id", "hash", "start", "end", "words", "keep")


def extended(df: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs with the words beside them that stand beside their kept occurrences as well. Runs of a document that then meet
    share no character: the earlier one has it."""
    unit = lambda i, h, no, back: F.struct(F.col(i).alias("id"), F.col(h).alias("hash"), no.cast("int").alias("no"), F.lit(back).alias("back"))
    sides = {
        "before": (unit("id", "hash", F.col("first") - 1, True), unit("keep.id", "keep.hash", F.col("keep.no") - 1, True)),
        "after": (unit("id", "hash", F.col("last") + 1, False), unit("kept_last.id", "kept_last.hash", F.col("kept_last.no") + 1, False)),
    }
    wanted = runs.select(F.explode(F.array(*[u for pair in sides.values() for u in pair])).alias("u")).select("u.*").where("no >= 0 AND id IS NOT NULL").distinct()
    found = written(unit_words(df, written(wanted, "wanted"), id_col, text_col), "words")
    out = runs
    for side, (own, kept) in sides.items():
        for name, at in (("own", own), ("kept", kept)):
            u = found.select(F.struct("id", "hash", "no", "back").alias("_u"), F.struct("words", "starts", "ends").alias(f"{name}_{side}"))
            out = out.withColumn("_at", at).join(u, F.col("_at") == F.col("_u"), "left").drop("_at", "_u")
    n = {side: F.coalesce(alike(F.col(f"own_{side}.words"), F.col(f"kept_{side}.words"), side == "before"), F.lit(0)) for side in sides}
    out = out.withColumns({"_b": n["before"], "_a": n["after"]})
    start = F.when(F.col("_b") > 0, F.get("own_before.starts", F.size("own_before.starts") - F.col("_b"))).otherwise(F.col("start"))
    end = F.when(F.col("_a") > 0, F.get("own_after.ends", F.col("_a") - 1)).otherwise(F.col("end"))
    out = out.select("id", "hash", start.alias("start"), end.alias("end"), (F.col("words") + F.col("_b") + F.col("_a")).alias("words"), "keep")
    reach = F.max("end").over(Window.partitionBy("id", "hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("start", F.greatest("start", F.coalesce(reach, F.lit(0)))).where("start < end")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` without its repeated spans."""
    return without_spans(df, written(repeated_spans(df, id_col, text_col, min_words), "spans"), id_col, text_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to remove from all documents, with the place of what they repeat."""
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "end", F.col("words").alias("n_words"), F.col("keep.id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"))
