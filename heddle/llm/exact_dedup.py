"""Exact deduplication by a log-structured merge index of digests (DataFrame functions only).

Each input partition is a memtable: its (digest, id) rows are sorted where they lie and flushed, without a shuffle, as
one run, a Parquet file with a Bloom filter and ranges of its digests. All runs share one filter of slots that more than
one row has: a digest whose slot nobody shares is in no other run and is looked up nowhere. Compaction merges the other
digests tier by tier, FAN_IN runs at a time, and keeps for each the winning identifier and the number of rows. A digest
that more than one row has is a hit; the texts of hits, and of few others, are then compared byte by byte.

Defined results: a null text counts as empty; a null id loses against any other; rows that repeat one id and text are
one document's copies, of which one stays; a very long text is hashed and compared whole; columns other than the id and
the text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import bitmap_filter, filter_bits, flagged, passing, slot_of, table, written

#: Parquet Bloom filter of a run: a lookup of a few digests skips the files that can't hold them.
RUN_FILTER = {"parquet.bloom.filter.enabled#digest": "true"}
#: Runs that one step of compaction merges.
FAN_IN = 64


def sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text, 256)


class DigestIndex:
    """Sorted runs of (digest, id, n). ``keep``: 'smallest' or 'largest' identifier wins a digest."""

    def __init__(self, keep: str = "smallest") -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep: {keep!r} is neither 'smallest' nor 'largest'")
        self.best = F.min if keep == "smallest" else F.max
        self.runs: DataFrame | None = None
        self.count = 0

    def _merged(self, rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key, "digest").agg(self.best("id").alias("id"), F.sum("n").alias("n"))

    def flush(self, rows: DataFrame) -> None:
        """Add (digest, id) rows: every partition is a memtable that becomes one sorted run; nothing is shuffled."""
        first = self.count
        run = rows.select((F.spark_partition_id() + first).alias("run"), "digest", "id", F.lit(1).cast("long").alias("n"))
        run = written(run.sortWithinPartitions("digest"), "run", **RUN_FILTER)
        self.runs = run if self.runs is None else self.runs.unionByName(run)
        self.count = (run.agg(F.max("run")).first()[0] or first) + 1

    def compact(self, rows: DataFrame | None = None) -> DataFrame:
        """(digest, id, n) of all runs, or of ``rows`` of theirs, merged tier by tier into one run."""
        rows, runs = self.runs if rows is None else rows, self.count
        while runs > FAN_IN:
            rows = self._merged(rows.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")), "run")
            rows, runs = written(rows.sortWithinPartitions("digest"), "run", **RUN_FILTER), -(-runs // FAN_IN)
        return written(self._merged(rows).sortWithinPartitions("digest"), "run", **RUN_FILTER)

    def shared(self) -> tuple[DataFrame, int]:
        """Filter of the slots that more than one row of the runs has, and its bits."""
        bits = filter_bits(self.runs.count())
        slots = self.runs.groupBy(slot_of([F.col("digest")], bits).alias("slot")).agg(F.sum("n").alias("n")).where("n > 1")
        return bitmap_filter(slots, [], bits, F.col("slot")), bits

    def hits(self) -> DataFrame:
        """Digests of more than one row. Rows whose slot no other row has are left out before anything is merged."""
        some, bits = self.shared()
        return self.compact(passing(self.runs, some, ["digest"], bits)).where(F.col("n") > 1).select("digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256) -> DataFrame:
    """One row per row of ``df``: id, digest, keep_id, group_size, kept.

    ``digest`` may be any function of the text: rows count as equal only if their bytes are, and a digest that two
    different texts share is resolved by the texts themselves. Texts are folded by digest and bytes within each map task
    before any is shuffled, so a group of copies that holds a third of all rows is a handful of rows here. Rows that a
    filter of bounded size shows to be no hits are never shuffled.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", digest(F.col("text")))
    index = DigestIndex(keep)
    index.flush(docs.select("digest", "id"))
    hits = index.hits()
    bits = filter_bits(hits.count())
    # What the filter lets through in error is a group of one row.
    found = passing(docs, bitmap_filter(hits, ["digest"], bits), ["digest"], bits)
    same = found.groupBy("digest", "text").agg(index.best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = written(same, "verified")
    by = same.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    by = written(by.where("texts > 1 OR group_size > 1"), "groups")
    # Rows outside all groups are their own; the others fold by digest and id before the join and unfold after it: one of
    # them is the copy that stays.
    bits = filter_bits(by.count())
    marked = flagged(docs, bitmap_filter(by, ["digest"], bits), ["digest"], "_group", bits)
    one = F.lit(1).cast("long")
    alone = marked.where("NOT _group").select("id", "digest", F.col("id").alias("keep_id"), one.alias("group_size"), one.alias("copies"))
    rows = marked.where("_group").groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(by, "digest", "left")
    sure = joined.where("texts IS NULL OR texts = 1").select(
        "id", "digest", F.when(F.col("texts").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "copies").alias("group_size"), "copies",
    )
    # Digests that different texts share: the texts decide.
    doubtful = (
        found.join(by.where("texts > 1").select("digest"), "digest", "left_semi")
        .groupBy("digest", "text", "id").agg(F.count(F.lit(1)).alias("copies"))
        .join(same.select("digest", "text", "keep_id", "group_size"), ["digest", "text"])
        .select("id", "digest", "keep_id", "group_size", "copies")
    )
    many = sure.unionByName(doubtful).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return many.unionByName(alone.withColumn("copy", F.lit(1))).select(
        F.col("id").alias(id_col), "digest", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; the largest id stays."""
    out = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
