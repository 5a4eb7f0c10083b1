"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; policies are
named, versioned masks over those bits, so a new policy or an ablation never reads a text again.

Defined results: a null text counts as empty; null ids and repeated rows keep their rows; a very long text is measured
whole, with one hash for each of its words; other columns are not touched, those named like a column of the ledger get
``_in`` at the end of their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import WORD_CLASS, table, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``failed``, a SQL condition over the measurements, is true."""

    bit: int
    name: str
    failed: str


#: Order of bits is part of the ledger's format: append, never renumber.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "capitals", "100 * n_upper > 50 * word_chars"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
)

#: Versioned policies: the rules that reject. Version 2 also rejects by repeated lines.
POLICIES = {
    ("default", 1): ("few_words", "repeated_windows", "symbols", "capitals", "word_length"),
    ("default", 2): ("few_words", "repeated_windows", "symbols", "capitals", "word_length", "repeated_lines"),
    ("base", 1): ("few_words", "repeated_windows"),
}


def policy_mask(name: str = "default", version: int = 1) -> int:
    """The mask of a policy; KeyError for one that does not exist."""
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in POLICIES[name, version])


def own_columns(df: DataFrame) -> tuple[list[Column], list[str]]:
    """Columns of ``df`` and their names; those named like a column of the ledger get ``_in`` at the end."""
    taken = {*MEASURES, "fail_bits", "kept"}
    names = [f"{c}_in" if c in taken else c for c in df.columns]
    return [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], names


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements as long columns named ``MEASURES``.

    n_repeat_words counts the words inside some 3-word window that the text holds twice or more, the first included. A row
    holds a 64-bit hash for each window; windows of equal hashes, and no others, are then compared as strings. All stays
    inside the row, so there is no shuffle however long a text is.
    """
    own, names = own_columns(df)
    packed = F.struct(*own).alias("_in")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    one = df.select(packed, t.alias("_t"), words(F.col(f"`{text}`")).alias("_w"), lines.alias("_l"))
    hashes = F.when(
        F.size("_w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))),
    ).otherwise(F.array().cast("array<long>"))
    two = one.select(
        "_in", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("_h"),
    )
    kept = [F.col(c) for c in MEASURES[:-1]]

    def repeated(array: str) -> Column:
        """Entries (k, i) of a sorted array whose k the entry before or after has as well."""

        def same(j: Column, k: Column) -> Column:
            return F.coalesce(F.get(array, j)["k"] == k, F.lit(False))

        return F.filter(array, lambda x, j: same(j + 1, x["k"]) | ((j > 0) & same(F.greatest(j - 1, F.lit(0)), x["k"])))

    # Only texts that repeat a window pay for the sorts.
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    three = two.select("_in", "_w", *kept, F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("k"), i.alias("i"))))).alias("_p"))
    four = three.select("_in", "_w", *kept, repeated("_p").alias("_p"))
    window = F.transform("_p", lambda x: F.struct(F.concat_ws(" ", F.get("_w", x["i"]), F.get("_w", x["i"] + 1), F.get("_w", x["i"] + 2)).alias("k"), x["i"].alias("i")))
    five = four.select("_in", *kept, F.sort_array(window).alias("_p"))
    six = five.select("_in", *kept, F.sort_array(F.transform(repeated("_p"), lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return six.select(*[F.col(f"_in.`{c}`").alias(c) for c in names], *kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failure_bits() -> Column:
    """All rules as one long, a bit for each; over the columns of ``measured``."""
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its measurements and ``fail_bits``. Every rule runs once.

    The row number, never negative, keeps the optimizer from copying the measurements into filters on the bits, where
    each of them would be evaluated once for every rule.
    """
    return measured(df, text).withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, failure_bits()))


def apply_policy(book: DataFrame, name: str = "default", version: int = 1) -> DataFrame:
    """``book`` (a ledger) with ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(name, version)).cast("long")) == 0)


def ablation(book: DataFrame, name: str = "default", version: int = 1) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and those that only it rejects.

    A document is rescued by leaving a rule out exactly when its bit is the only one left under the mask.
    """
    mask = policy_mask(name, version)
    own = [r for r in RULES if mask >> r.bit & 1]
    left = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.sum(F.shiftright("fail_bits", r.bit).bitwiseAND(F.lit(1))).alias(f"f{r.bit}") for r in own]
    sums += [F.sum((left == (1 << r.bit)).cast("long")).alias(f"o{r.bit}") for r in own]
    rows = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.coalesce(f"f{r.bit}", F.lit(0)).alias("failed"), F.coalesce(f"o{r.bit}", F.lit(0)).alias("only")) for r in own]
    )
    return book.agg(*sums).select(F.inline(rows))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger and default policy over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = apply_policy(ledger(docs))
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask("base")).cast("long")) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits",
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
d AS (SELECT *, row_number() OVER () AS r FROM w),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
b AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept, fail_bits
FROM b
"""
