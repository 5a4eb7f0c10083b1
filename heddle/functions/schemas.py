"""JSON schemas to Spark types, the choice among unions, and inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.values import parse_datetime
from heddle.session import cut

#: Scalar types in the order in which a union prefers them; arrays and structs come before all.
PRECEDENCE = (
    "STRING", "DATE", "TIME_WITHOUT_TIMEZONE", "TIME_WITH_TIMEZONE", "TIMESTAMP_WITHOUT_TIMEZONE",
    "TIMESTAMP_WITH_TIMEZONE", "NUMBER", "INTEGER", "BOOLEAN", "UNKNOWN",
)

SPARK_TYPES = {
    "STRING": T.StringType(), "DATE": T.DateType(), "TIME_WITHOUT_TIMEZONE": T.StringType(), "TIME_WITH_TIMEZONE": T.StringType(),
    "TIMESTAMP_WITHOUT_TIMEZONE": T.TimestampNTZType(), "TIMESTAMP_WITH_TIMEZONE": T.TimestampType(), "NUMBER": T.DoubleType(),
    "INTEGER": T.LongType(), "BOOLEAN": T.BooleanType(), "UNKNOWN": T.StringType(),
}


def own_type(schema: dict) -> str | None:
    """What a catalog adds to a JSON type, under a key of its own that ends in _type."""
    return next((v for k, v in schema.items() if k.endswith("_type")), None)


def logical_type(schema: dict) -> str:
    """Name of the type of a property: ARRAY, STRUCT, UNSUPPORTED_ONE_OF or one of ``PRECEDENCE``."""
    if "oneOf" in schema:
        return "UNSUPPORTED_ONE_OF"
    kind = schema.get("type")
    if isinstance(kind, list):
        options = list(dict.fromkeys(k for k in kind if k != "null"))
        if not options:
            return "UNKNOWN"
        return chosen([logical_type(schema | {"type": k}) for k in options])
    if kind == "object" or kind is None and "properties" in schema:
        return "STRUCT"
    if kind == "array":
        return "ARRAY"
    form, own = schema.get("format"), own_type(schema)
    if kind == "boolean":
        return "BOOLEAN"
    if kind == "integer" or kind == "number" and own in ("integer", "big_integer"):
        return "INTEGER"
    if kind == "number":
        return "NUMBER"
    if kind == "string":
        if form == "date":
            return "DATE"
        if form == "time":
            return "TIME_WITHOUT_TIMEZONE" if own == "time_without_timezone" else "TIME_WITH_TIMEZONE"
        if form == "date-time":
            return "TIMESTAMP_WITHOUT_TIMEZONE" if own == "timestamp_without_timezone" else "TIMESTAMP_WITH_TIMEZONE"
        return "STRING"
    return "UNKNOWN"


def chosen(options: list[str]) -> str:
    """The type of a union: ARRAY, then STRUCT, then by precedence."""
    order = {"ARRAY": -2, "STRUCT": -1} | {name: i for i, name in enumerate(PRECEDENCE)}
    return min(options, key=lambda o: order.get(o, len(order)))


def spark_type(schema: dict) -> T.DataType:
    """Spark type of a JSON schema; property order is kept, what has no type of its own stays JSON text."""
    if own_type(schema) == "big_integer":
        return T.DecimalType(38, 0)
    kind = logical_type(schema)
    if kind == "STRUCT":
        fields = schema.get("properties") or {}
        return T.StructType([T.StructField(n, spark_type(s)) for n, s in fields.items()]) if fields else T.StringType()
    if kind == "ARRAY":
        items = schema.get("items")
        return T.ArrayType(spark_type(items) if isinstance(items, dict) else T.StringType())
    return SPARK_TYPES.get(kind, T.StringType())


# --- the schema of JSON texts, folded as a mergeable aggregate ---------------------------------------------------------

#: Bits of the JSON types that a path has been seen with; bits of any rows merge by ``bit_or``.
JSON_TYPES = {"null": 1, "boolean": 2, "number": 4, "string": 8, "array": 16, "object": 32}
#: Step of a path into the elements of an array.
ELEMENTS = "[]"


def type_bits(df: DataFrame, column: str) -> DataFrame:
    """(path array<string>, bits int): the JSON types of each path of the texts of a column, over all rows.

    Texts are parsed once into variants and opened level by level; on each level the types of a path fold to one number by
    ``bit_or``, combined before the shuffle, so what is shuffled is a row for each path and task. Only objects and arrays go
    on to the next level, as a table of their own. The steps run in the JVM. Texts that are no JSON, and nulls, count
    nowhere; paths beyond those that the data have are not made up, so an empty table has none.
    """
    root = F.array().cast("array<string>").alias("path")
    level = df.select(root, F.try_parse_json(F.col(f"`{column}`")).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        bit = F.when(kind == "OBJECT", 32).when(kind == "ARRAY", 16).when(kind == "STRING", 8).when(kind == "BOOLEAN", 2).when(kind == "VOID", 1).otherwise(4)
        typed = level.select("path", "v", bit.alias("bit"))
        folded = cut(typed.groupBy("path").agg(F.bit_or("bit").cast("int").alias("bits")))
        out = folded if out is None else out.unionByName(folded)
        if folded.where("bits >= 16").isEmpty():
            return out
        inner = typed.where("bit >= 16").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("bit") == 16, F.lit(ELEMENTS)).otherwise(F.col("key"))
        level = cut(inner.select(F.concat("path", F.array(step)).alias("path"), F.col("value").alias("v")))


def types_of(bits: Column) -> Column:
    """Names of the types of a number, in the order of ``JSON_TYPES``."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(t)) for t, b in JSON_TYPES.items()]), lambda t: t.isNotNull())


def json_schema(paths: DataFrame) -> dict:
    """JSON schema of the paths of ``type_bits``, which are as many as the schema has nodes: everything but the root may be
    null, what was only ever null is left out, and several types with structure of their own are alternatives."""
    nodes: dict[tuple, int] = {tuple(r.path): r.bits for r in paths.collect()}
    below: dict[tuple, list[tuple]] = {}
    for path in sorted(nodes):
        if path:
            below.setdefault(path[:-1], []).append(path)

    def one(path: tuple, kind: str) -> dict:
        inner = below.get(path, ())
        if kind == "object":
            return {"type": kind, "properties": {p[-1]: node(p) for p in inner if p[-1] != ELEMENTS and nodes[p] != 1}}
        if kind == "array":
            items = [p for p in inner if p[-1] == ELEMENTS and nodes[p] != 1]
            return {"type": kind} | ({"items": node(items[0])} if items else {})
        return {"type": kind}

    def node(path: tuple) -> dict:
        kinds = [t for t, b in JSON_TYPES.items() if nodes[path] & b and t != "null"]
        if len(kinds) == 1:
            only = one(path, kinds[0])
            return only | {"type": [only["type"], "null"]}
        if not {"array", "object"} & set(kinds):
            return {"type": [*kinds, "null"]}
        return {"anyOf": [one(path, k) for k in kinds] + [{"type": "null"}]}

    if () not in nodes:
        return {"type": "object", "properties": {}}
    return node(()) | {"type": "object"}


def _folded(schema: dict) -> T.DataType:
    """Spark type of a folded schema; alternatives with structure stay JSON text, as do mixed scalars."""
    kinds = [k for k in schema.get("type", ()) if k != "null"] if isinstance(schema.get("type"), list) else [schema.get("type")]
    if "anyOf" in schema or len(kinds) != 1:
        return T.StringType()
    if kinds[0] == "object":
        return T.StructType([T.StructField(n, _folded(s)) for n, s in schema["properties"].items()]) if schema["properties"] else T.StringType()
    if kinds[0] == "array":
        return T.ArrayType(_folded(schema["items"]) if "items" in schema else T.StringType())
    return {"boolean": T.BooleanType(), "number": T.DoubleType()}.get(kinds[0], T.StringType())


def inferred_schema(df: DataFrame, column: str) -> T.StructType:
    """Spark schema of the JSON objects of a column, folded over all rows; numbers are doubles."""
    kind = _folded(json_schema(type_bits(df, column)))
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def head_of_files(spark: SparkSession, path: str, most_bytes: int = 1_000_000) -> DataFrame:
    """(file, value): the lines of each text file that begin within its first ``most_bytes`` bytes, so that no file weighs more.

    A line counts if those before it in its file have fewer bytes. Only lines of a file's first block are summed, in the order
    in which the block was read; the other blocks are read past.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value")
    first = lines.where("_at = 0").withColumn("_i", F.monotonically_increasing_id())
    before = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("file").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most_bytes).select("file", "value")


#: Formats that are tried, in order.
DATETIME_FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%fZ", "%d/%m/%Y", "%m/%d/%Y", "%Y%m%d")


def datetime_formats(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DATETIME_FORMATS) -> DataFrame:
    """One row: for each text column the first format that every value has, null if none has. A value that comes often is
    parsed once: what does not fit a format costs an exception each time."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(columns)])).alias("x"))
    # A plain distinct would be optimised away, as what follows ignores repeats.
    values = values.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    out = []
    for i, c in enumerate(columns):
        fits = [F.coalesce(F.bool_and(F.when(F.col("i") == i, parse_datetime(F.col("v"), f).isNotNull())), F.lit(False)) for f in formats]
        first = F
        for f, ok in zip(formats, fits, strict=True):
            first = first.when(ok, f)
        out.append(first.otherwise(None).alias(c))
    return values.agg(*out)
