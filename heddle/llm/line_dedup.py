"""Line deduplication by a rolling hash over lines.

The hash rolls over every window of MIN_LINES consecutive lines with words, so each repeated passage of that many lines or
more is seen whole, wherever it stands and whatever surrounds it. (Chunks cut at content-defined boundaries are seen only if
a whole chunk lies inside a passage: with texts of some six lines they miss most passages. The README has figures.) Windows that occur more than once are compared byte by
byte; the first by (id, place) stays. Later windows that follow one another, and repeat windows that follow one another
in one text, join to one span. The first occurrence of a line is never removed: no window that holds it is a later one.

Defined results: a null text is empty and has no windows; blank lines count as bytes of a window but not as lines; of a
line that follows itself several times the first stays; rows with a null id are not changed and come last in rank; rows
that repeat id and text are one occurrence; a very long text is read whole, its windows leave in blocks of bounded size;
other columns keep their values, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import bitmap_filter, filter_bits, in_batches, passing, scratch, slices, table, without_spans, written

#: Lines with words that a removed passage needs.
MIN_LINES = 2


def window_spans(text: str, min_lines: int = MIN_LINES) -> list[tuple[int, int]]:
    """(start, end) of all windows of ``min_lines`` consecutive lines with words, the last newline included, in order."""
    lines, at = [], 0
    for line in text.split("\n"):
        end = at + len(line) + 1
        if line.strip():
            lines.append((at, min(end, len(text))))
        at = end
    return [(lines[i][0], lines[i + min_lines - 1][1]) for i in range(len(lines) - min_lines + 1)]


def windows(df: DataFrame, id_col: str, text_col: str, min_lines: int, texts: bool) -> DataFrame:
    """(id, hash, no, start, end, digest) of the windows of all rows, and their text."""
    schema = "id long, hash long, no int, start int, end int, digest binary" + ", chunk string" * texts
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = ["id", "hash", "no", "start", "end", "digest", "chunk"][: 6 + texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        for batch in slices(batches):
            rows, size = [], 0
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                for no, (start, end) in enumerate(window_spans(text, min_lines)):
                    piece = text[start:end].removesuffix("\n")
                    rows.append((doc, h, no, start, end, xxh3_128_digest(piece.encode("utf-8", "surrogatepass")), piece)[: 6 + texts])
                    size += len(piece) if texts else 100
                    if size > 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    t = F.col(f"`{text_col}`")
    return in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), t.alias("text")).mapInArrow(run, schema)


def rank() -> Column:
    """Places in order: rows with an id before those without, then by id, text and place."""
    return F.struct(F.col("id").isNull().alias("late"), "id", "hash", "no", "start", "end")


def repeated_windows(df: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    """One row per window that an earlier one equals: id, hash (of its row's text), no, start, end, keep (rank of the
    first one).

    Digests are counted with a combine before the shuffle. Texts are shuffled only for windows whose digest repeats, each
    different text once per map task, and a digest that two texts share is settled by the texts.
    """
    found = written(windows(df, id_col, text_col, min_lines, False), "windows")
    often = written(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "digests")
    bits = filter_bits(often.count())
    whole = passing(windows(df, id_col, text_col, min_lines, True), bitmap_filter(often, ["digest"], bits), ["digest"], bits)
    same = written(whole.groupBy("digest", "chunk").agg(F.min(rank()).alias("keep"), F.count(F.lit(1)).alias("n")), "compared")
    by = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep").alias("keep"), F.sum("n").alias("n"))
    by = written(by.where("n > 1").select("digest", "texts", "keep"), "kept")
    sure = found.join(by.where("texts = 1").select("digest", "keep"), "digest")
    shared = by.where("texts > 1").select("digest")
    doubt = whole.join(shared, "digest", "left_semi").join(same.where("n > 1").select("digest", "chunk", "keep"), ["digest", "chunk"]).drop("chunk")
    out = sure.unionByName(doubt.select(*sure.columns))
    return out.where(F.col("id").isNotNull() & ~rank().eqNullSafe(F.col("keep"))).drop("digest")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """One row per span to remove: id, hash (of its row's text), start, end, lines, keep (struct of the id, start and end
    of the bytes that stay). Spans of a row don't overlap: a line in two windows counts with the earlier one.
    """
    # Rows that repeat id and text give equal windows: one of each is enough.
    later = repeated_windows(df, id_col, text_col, min_lines).dropDuplicates(["id", "hash", "no"])
    own = Window.partitionBy("id", "hash").orderBy("no")
    follows = F.struct(F.col("no") - 1, "keep.id", "keep.hash", F.col("keep.no") - 1)
    before = F.lag(F.struct("no", "keep.id", "keep.hash", "keep.no")).over(own)
    cut = later.withColumn("cut", (~before.eqNullSafe(follows)).cast("int")).withColumn("run", F.sum("cut").over(own))
    runs = cut.groupBy("id", "hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("no").alias("no"), F.max("no").alias("last"),
        F.first("keep.id").alias("keep_id"), F.min("keep.start").alias("keep_start"), F.max("keep.end").alias("keep_end"),
    )
    by_run = Window.partitionBy("id", "hash").orderBy("run")
    past, line = F.lag("end").over(by_run), F.lag("last").over(by_run) + min_lines
    runs = runs.withColumn("from", F.greatest("start", past)).withColumn("line", F.greatest("no", line))
    keep = F.struct(F.col("keep_id").alias("id"), (F.col("keep_start") + F.col("from") - F.col("start")).alias("start"), F.col("keep_end").alias("end"))
    return runs.select("id", "hash", F.col("from").alias("start"), "end", (F.col("last") + min_lines - F.col("line")).alias("lines"), keep.alias("keep"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` without its repeated passages. Texts that nothing repeats are as they were; others may end up empty."""
    with scratch() as keep:
        cuts = keep(written(repeated_passages(df, id_col, text_col, min_lines), "cuts"))
    return without_spans(df, cuts, id_col, text_col)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of lines to remove from all documents, with the place of the one that stays."""
    out = repeated_passages(table(spark, sf_dir, "documents"))
    keep = [F.col("keep.id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), F.col("keep.end").alias("keep_end")]
    return out.select(F.col("id").alias("doc_id"), "start", "end", "lines", *keep)
