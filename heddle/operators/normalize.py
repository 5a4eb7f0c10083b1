"""Raw JSON records to typed tables: extract, cast, hash, unnest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.schemas import spark_type
from heddle.functions.values import empty_string_to_null, safe_cast, surrogate_key


def extracted(df: DataFrame, column: str, properties: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One text column per property of the JSON in ``column``; keys may hold any character. One parse for all."""
    fields = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    parsed = df.select(*[F.col(f"`{k}`") for k in keep], F.from_json(F.col(f"`{column}`"), fields).alias("_j"))
    quote = lambda p: p.replace("`", "``")
    return parsed.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"_j.`{quote(p)}`").alias(p) for p in properties])


def typed(df: DataFrame, schema: dict, strict: bool = False) -> DataFrame:
    """Columns of the properties of a JSON schema cast to their types; empty dates and times are null. Other columns
    stay. Values that cannot be cast are null, or an error with ``strict``."""
    kinds = {n: spark_type(s) for n, s in schema.get("properties", {}).items()}
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        kind = kinds.get(name)
        if kind is None or isinstance(kind, T.StringType):
            out.append(c)
        elif isinstance(kind, T.StructType | T.ArrayType):
            out.append(F.from_json(c, kind).alias(name))
        else:
            c = empty_string_to_null(c) if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else c
            out.append(safe_cast(c, kind.simpleString(), strict).alias(name))
    return df.select(*out)


def with_row_hash(df: DataFrame, cols: Sequence[str], name: str = "_hashid") -> DataFrame:
    return df.withColumn(name, surrogate_key([F.col(f"`{c}`") for c in cols]))


def unnested(df: DataFrame, column: str, element: T.DataType, keep: Sequence[str], name: str = "item") -> DataFrame:
    """One row per element of a JSON array, with its place; nulls and what is no array give no rows."""
    parsed = F.from_json(F.col(f"`{column}`"), T.ArrayType(element))
    return df.select(*[F.col(f"`{k}`") for k in keep], F.posexplode(parsed).alias("_place", name))


def star_intersect(left: DataFrame, right: DataFrame, on: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Columns of ``left``; values from ``right`` where it has the column and a matching row, else from ``left``."""
    a, b = left.alias("a"), right.alias("b")
    out = []
    for c in left.columns:
        if c in exclude:
            continue
        out.append(F.col(f"b.`{c}`").alias(c) if c in right.columns and c not in on else F.col(f"a.`{c}`"))
    joined = a.join(b, [F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in on], "left")
    return joined.select(*out)


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def migrated_raw(v1: DataFrame, prefix: str) -> DataFrame:
    """Raw table of the first layout (ab_id, emitted_at, data) in the second one; ``prefix`` leads all column names."""
    new = {
        "raw_id": F.col(f"{prefix}ab_id"), "extracted_at": F.col(f"{prefix}emitted_at"), "loaded_at": F.lit(None).cast("timestamp"),
        "data": F.col(f"{prefix}data"), "meta": F.lit(None).cast("string"), "generation_id": F.lit(0).cast("long"),
    }
    return v1.select(*[c.alias(prefix + name) for name, c in new.items()])
