"""From raw documents to packed sequences: rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, the
last one the pieces of the packed sequences. Stages are tables: each is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import table, written
from heddle.llm.line_dedup import line_dedup
from heddle.llm.mixing import mix
from heddle.llm.near_copies import without_near_copies
from heddle.llm.packing import pack_documents, tokenizer_path
from heddle.llm.quality_rules import apply_policy, ledger

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the default policy rejects."""
    return apply_policy(ledger(docs.select(*COLUMNS))).where("kept").select(*COLUMNS)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier one has; those of which nothing is left go.

    A document that had no words before is not one of which nothing is left.
    """
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")) == ""
    had = docs.select(*COLUMNS).withColumn("_blank", blank)
    out = line_dedup(had).where(~blank | F.col("_blank"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies by SimHash candidates and a Jaccard similarity of 0.8 or more over
    five-word shingles: the one with the smallest id; see ``near_copies`` for null ids, ties and repeated rows."""
    return without_near_copies(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    out = mix(docs.select(*COLUMNS), carry=True).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("near-dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has neither the fingerprints nor the tokenizer: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
