"""Sinks: flattened CSV, JSON lines, lake layouts, file names, documents for vector stores, graph tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date columns that a lake layout adds.
LAYOUTS = {
    "NO PARTITIONING": (), "DATE": ("date",), "YEAR": ("year",), "MONTH": ("month",), "DAY": ("day",),
    "YEAR/MONTH": ("year", "month"), "YEAR/MONTH/DAY": ("year", "month", "day"),
}
CODECS = ("SNAPPY", "GZIP", "ZSTD", "UNCOMPRESSED")


def flattened(df: DataFrame, lead: Sequence[str]) -> DataFrame:
    """Columns for CSV: the leading ones, then the others by name; nested values as JSON, missing ones empty."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        c = F.to_json(c) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else c.cast("string")
        return F.coalesce(c, F.lit("")).alias(f.name)

    names = [*lead, *sorted(c for c in df.columns if c not in lead)]
    return df.select(*[cell(df.schema[n]) for n in names])


def unflattened(df: DataFrame, lead: Sequence[str], name: str = "data") -> DataFrame:
    """The leading columns and one JSON column of all others."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in lead]
    return df.select(*lead, F.to_json(F.struct(*rest)).alias(name))


def write_csv(df: DataFrame, path: str, lead: Sequence[str] = (), flatten: bool = True, compression: str = "none", mode: str = "errorifexists") -> None:
    """CSV with a header; a quote within a value is doubled, as readers expect by default."""
    out = flattened(df, lead) if flatten else unflattened(df, lead)
    out.write.mode(mode).option("header", "true").option("compression", compression).option("emptyValue", "").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", compression).json(path)


def with_layout(df: DataFrame, cursor: str, layout: str) -> tuple[DataFrame, tuple[str, ...]]:
    """``df`` with the date columns of a lake layout, and their names."""
    parts = LAYOUTS[layout]
    date = F.to_date(F.col(cursor))
    made = {"date": date, "year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)}
    for p in parts:
        df = df.withColumn(p, made[p])
    return df, parts


def write_lake(df: DataFrame, path: str, cursor: str, layout: str = "NO PARTITIONING", fmt: str = "parquet", codec: str = "SNAPPY", mode: str = "append") -> None:
    """Parquet or JSON lines in a layout. Rows are dealt by the partition columns first: each task writes few files."""
    out, parts = with_layout(df, cursor, layout)
    out = out.repartition(*parts) if parts else out
    writer = out.write.mode(mode).option("compression", codec.lower().replace("uncompressed", "none"))
    writer = writer.partitionBy(*parts) if parts else writer
    writer.format({"parquet": "parquet", "jsonl": "json"}[fmt]).save(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a table: written beside it, then the old one is moved aside, the new one into its place, and the old one
    deleted last. At no moment is neither there: a table that a crash left aside is moved back first."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    base = path.rstrip("/")
    target, temp, aside = (jvm.org.apache.hadoop.fs.Path(base + end) for end in ("", "_tmp", "_old"))
    fs = target.getFileSystem(conf)

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"cannot move {a} to {b}")

    if fs.exists(aside) and not fs.exists(target):
        move(aside, target)
    df.write.mode("overwrite").parquet(temp.toString())
    fs.delete(aside, True)
    if fs.exists(target):
        move(target, aside)
    move(temp, target)
    fs.delete(aside, True)


def file_name(pattern: str, now: datetime, sync_id: int = 0, part: int = 0, extension: str = "") -> str:
    """A file name from a pattern with {date}, {date:yyyy_MM}, {timestamp}, {timestamp:millis|micros}, {sync_id},
    {part_number} and {format_extension}."""
    codes = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}

    def value(m: re.Match) -> str:
        name, _, arg = m[1].partition(":")
        if name == "date":
            return now.strftime(re.sub("yyyy|MM|dd|HH|mm|ss", lambda c: codes[c[0]], arg or "yyyy_MM_dd"))
        if name == "timestamp":
            return str(int(now.timestamp() * (1_000_000 if arg == "micros" else 1000)))
        return {"sync_id": str(sync_id), "part_number": str(part), "format_extension": extension}.get(name, m[0])

    return re.sub(r"\{([^}]+)\}", value, pattern)


def split_documents(df: DataFrame, keep: Sequence[str], text: str, size: int, overlap: int = 0) -> DataFrame:
    """Chunks of ``size`` characters, each beginning ``size - overlap`` after the one before: keep..., chunk_no, chunk.

    A text is cut into steps once, and a chunk is joined from the few steps it covers: its length counts once. Texts by their
    own separators: ``documents.split_text``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size")
    t = F.coalesce(F.col(text), F.lit(""))
    step = size - overlap
    last = F.greatest(F.ceil((F.length(t) - overlap) / step) - 1, F.lit(0)).cast("int")
    steps = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    covers = 1 + -(-overlap // step)
    chunk = lambda n: F.substring(F.array_join(F.slice("_s", n + 1, covers), ""), 1, size)
    rows = df.select(*keep, steps.alias("_s"), last.alias("_last"))
    rows = rows.select(*keep, F.transform(F.sequence(F.lit(0), F.col("_last")), lambda n: F.struct(n.cast("long").alias("chunk_no"), chunk(n).alias("chunk"))).alias("_c"))
    return rows.select(*keep, F.explode("_c").alias("_c")).select(*keep, "_c.chunk_no", "_c.chunk")


def replaced_documents(index: DataFrame, chunks: DataFrame, record: str) -> DataFrame:
    """An index table after a load: chunks of loaded records go, the new ones come."""
    return index.join(chunks.select(record).distinct(), record, "left_anti").unionByName(chunks, allowMissingColumns=True)
