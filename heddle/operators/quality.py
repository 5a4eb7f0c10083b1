"""Table tests: equality, counts, uniqueness, nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_not_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a``, repeats included, that ``b`` does not have; null equals null."""
    names = a.columns
    right = b.select(*names).distinct()
    cond = None
    for c in names:
        one = a[c].eqNullSafe(right[c])
        cond = one if cond is None else cond & one
    return a.join(right, cond, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, both ways."""
    return rows_not_in(a, b).unionByName(rows_not_in(b, a))


def equality_metric(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that differ, plus the difference of their numbers; 0 for equal tables."""
    left = rows_not_in(a, b).agg(F.count(F.lit(1)).alias("l"))
    right = rows_not_in(b, a).agg(F.count(F.lit(1)).alias("r"))
    return left.join(right).select((F.col("l") + F.col("r") + F.abs(F.col("l") - F.col("r"))).alias("metric"))


def row_counts(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(label, row_count, expected_count) of tables."""
    out = None
    for name, (df, n) in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("label"), "row_count", F.lit(n).cast("long").alias("expected_count"))
        out = one if out is None else out.unionByName(one)
    return out


def equal_row_count(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.agg(F.count(F.lit(1)).alias("count_a")), b.agg(F.count(F.lit(1)).alias("count_b"))
    return x.join(y).withColumn("diff_count", F.abs(F.col("count_a") - F.col("count_b")))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def present_tables(wanted: DataFrame, column: str, database: str | None = None) -> DataFrame:
    """``wanted`` with whether the catalogue has a table or view of that name; names are compared in lower case."""
    shown = wanted.sparkSession.sql("SHOW TABLES" + (f" IN `{database}`" if database else ""))
    there = shown.select(F.lower("tableName").alias("_name")).distinct()
    found = wanted.withColumn("_key", F.lower(F.col(column))).join(there, F.col("_key") == F.col("_name"), "left")
    return found.withColumn("present", F.col("_name").isNotNull()).drop("_key", "_name")
