"""File scans: formats, CSV options, JSON lines, listings, source texts."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CsvFormat:
    """Options of a CSV scan. ``header``: 'file', 'auto' (f0, f1, ...) or the names. Values are text unless ``infer``."""

    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    encoding: str = "UTF-8"
    double_quote: bool = True
    null_values: tuple[str, ...] = ("",)
    skip_before_header: int = 0
    skip_after_header: int = 0
    header: str | tuple[str, ...] = "file"
    true_values: tuple[str, ...] = ()
    false_values: tuple[str, ...] = ()
    infer: bool = False
    ignore_bad_rows: bool = False


def read_csv(spark: SparkSession, path: str, fmt: CsvFormat | None = None) -> DataFrame:
    """A CSV scan. Rows to skip are dropped by their line number in each file, so such files are read whole and their
    values stay text."""
    fmt = fmt or CsvFormat()
    options = {"sep": fmt.delimiter, "quote": fmt.quote, "encoding": fmt.encoding, "mode": "DROPMALFORMED" if fmt.ignore_bad_rows else "PERMISSIVE", "inferSchema": str(fmt.infer)}
    options["escape"] = fmt.escape or ('"' if fmt.double_quote else "\\")
    if fmt.skip_before_header or fmt.skip_after_header:
        # Lines are numbered within each file; the first line that is left of any file tells the columns.
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("_n", "value")).where("value <> ''")
        at, from_file = fmt.skip_before_header, fmt.header == "file"
        head = lines.where(F.col("_n") >= at).select("value").first()
        found = next(csv.reader([head[0]], delimiter=fmt.delimiter, quotechar=fmt.quote)) if head else []
        names = found if from_file else [f"f{i}" for i in range(len(found))]
        ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        body = lines.where(F.col("_n") >= at + from_file + fmt.skip_after_header)
        parse = {"sep": fmt.delimiter, "quote": fmt.quote, "escape": options["escape"], "mode": "PERMISSIVE"}
        df = body.select(F.from_csv("value", ddl, parse).alias("r")).select("r.*")
    else:
        df = spark.read.options(**options).option("header", str(fmt.header == "file")).csv(path)
    if fmt.header == "auto":
        df = df.toDF(*[f"f{i}" for i in range(len(df.columns))])
    elif not isinstance(fmt.header, str):
        df = df.toDF(*fmt.header)
    for c in df.columns:
        if isinstance(df.schema[c].dataType, T.StringType):
            v = F.col(f"`{c}`")
            v = F.when(v.isin(*fmt.null_values), None).otherwise(v) if fmt.null_values else v
            if fmt.true_values or fmt.false_values:
                v = F.when(v.isin(*fmt.true_values), "true").when(v.isin(*fmt.false_values), "false").otherwise(v)
            df = df.withColumn(c, v)
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False, sampling: float = 1.0) -> DataFrame:
    """JSON lines; ``multi_line`` for objects over several lines. The schema is given, or inferred and merged over files."""
    reader = spark.read.option("multiLine", str(multi_line)).option("samplingRatio", str(sampling))
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str, decimal_as_float: bool = False) -> DataFrame:
    """Parquet with its decimals as doubles, or as text."""
    df = spark.read.parquet(path)
    kind = "double" if decimal_as_float else "string"
    return df.select(*[F.col(f"`{f.name}`").cast(kind).alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_avro(spark: SparkSession, path: str, double_as_string: bool = False) -> DataFrame:
    """Avro, where the session has the Avro package."""
    df = spark.read.format("avro").load(path)
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if double_as_string and isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


#: Readers by the name of the format.
READERS = {"csv": read_csv, "jsonl": read_jsonl, "parquet": read_parquet, "avro": read_avro}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no such format: {kind}")
    return READERS[kind](spark, path, **options)


def listing(spark: SparkSession, root: str, glob: str = "*", most: int = 50_000, depth: int = 10) -> DataFrame:
    """(uri, last_modified, length) of files below a folder whose name matches, at most ``depth`` folders down and
    ``most`` of them, first by name: the operator's own bounds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "modificationTime", "length")
    base = root.rstrip("/").split("://")[-1].count("/")
    deep = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) - 1 - base
    return files.where(deep <= depth).orderBy("path").limit(most).select(F.col("path").alias("uri"), F.col("modificationTime").alias("last_modified"), "length")


# Languages by extension.
LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".jsx": "JavaScript", ".go": "Go",
    ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++", ".c": "C",
    ".swift": "Swift", ".scala": "Scala", ".ex": "Elixir", ".exs": "Elixir",
}
SKIPPED = ("node_modules", ".git", "dist", "build", "venv", "__pycache__", "target")


def language(path) -> F:
    """Language of a path by its extension, null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.nullif(ext, F.lit("")))


def source_texts(spark: SparkSession, root: str, skip: Sequence[str] = SKIPPED, skip_tests: bool = True) -> DataFrame:
    """(path, language, text) of the source files below a folder, without skipped folders and test files."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    out = texts.withColumn("language", language(F.col("path"))).where("language IS NOT NULL")
    out = out.where(~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in skip) + ")/"))
    return out.where(~F.col("path").rlike(r"(/tests?/|/test_[^/]*$|[._]test\.[^/]*$|\.spec\.[^/]*$)")) if skip_tests else out


def shortlog(df: DataFrame, line: str = "value") -> DataFrame:
    """(commits, name, email) of the lines of a git shortlog."""
    pattern = r"^\s*(\d+)\s+(.*?)\s*<([^>]*)>\s*$"
    rows = df.where(F.col(line).rlike(pattern))
    return rows.select(F.regexp_extract(line, pattern, 1).cast("long").alias("commits"), F.regexp_extract(line, pattern, 2).alias("name"), F.regexp_extract(line, pattern, 3).alias("email"))
