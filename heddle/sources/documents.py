"""Documents for stores of chunks: text by recursive splitting, metadata, record ids.

A text is cut by the first separator; pieces that are still too long by the next, and so on, the last resort being pieces of the
full size. A piece keeps the separator at its end, so all pieces in order are the text. Consecutive pieces then form chunks of
at most ``size`` characters; a chunk begins again with the last pieces of the one before, as many as ``overlap`` characters hold.
All of it works on places in the text: a text is walked once for each separator, and every chunk is taken out once.

Defined results: a null text is empty, an empty one has no chunk; repeated rows have repeated chunks; other columns are kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = ("\n\n", "\n", " ")
#: Fixed value: what stands for a key that a record lacks.
NO_KEY = "__not_found__"

CHUNK = "chunk_no long, start long, chunk string"


def pieces(text: str, size: int, separators: Sequence[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Places of the pieces of a text, none longer than ``size``."""
    spans = [(0, len(text))] if text else []
    for sep in separators:
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if b - a <= size:
                out.append((a, b))
                continue
            at = a
            while (found := text.find(sep, at, b)) >= 0:
                out.append((at, found + len(sep)))
                at = found + len(sep)
            if at < b:
                out.append((at, b))
        spans = out
    return [(at, min(at + size, b)) for a, b in spans for at in range(a, b, size)]


def chunks(text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> list[tuple[int, int]]:
    """Places of the chunks of a text."""
    out: list[tuple[int, int]] = []
    held: deque[tuple[int, int]] = deque()
    for a, b in pieces(text, size, separators):
        if held and b - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (a - held[0][0] > overlap or b - held[0][0] > size):
                held.popleft()
        held.append((a, b))
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def split_text(df: DataFrame, text: str, size: int, overlap: int = 0, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """The other columns of ``df`` with chunk_no, start (in characters) and chunk, a row for each chunk of the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size")
    clash = {"chunk_no", "start", "chunk"} & {c for c in df.columns if c != text}
    if clash:
        raise ValueError(f"columns of these names are made: {sorted(clash)}")
    keep = [c for c in df.columns if c != text]
    kind = pa.list_(pa.struct([("chunk_no", pa.int64()), ("start", pa.int64()), ("chunk", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for t in part.column(1):
                    t = t.as_py() or ""
                    rows.append([{"chunk_no": i, "start": a, "chunk": t[a:b]} for i, (a, b) in enumerate(chunks(t, size, overlap, separators))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["_keep", "_chunks"])

    packed = df.select((F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))).alias("_keep"), F.col(f"`{text}`").alias("_text"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["_keep"], T.StructField("_chunks", T.ArrayType(T.StructType().add("chunk_no", "long").add("start", "long").add("chunk", "string")))]))
    return out.select("_keep", F.explode("_chunks").alias("_c")).select(*[F.col(f"_keep.`{c}`").alias(c) for c in keep], "_c.chunk_no", "_c.start", "_c.chunk")


def metadata(df: DataFrame, text_fields: Sequence[str], most: int | None = None) -> Column:
    """Scalar fields of a record that are no text fields, as a map of strings; fields that would take names and values together
    beyond ``most`` characters are left out, later and smaller ones may still come in."""
    none = F.create_map().cast("map<string,string>")
    own = [f.name for f in df.schema.fields if f.name not in text_fields and not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType)]
    if not own:
        return none
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").cast("string").alias("v")) for n in own]), lambda e: e["v"].isNotNull())
    if most is None:
        return F.map_from_entries(entries)
    weight = lambda e: F.length(e["k"]) + F.length(e["v"])
    start = F.struct(F.lit(0).alias("size"), none.alias("map"))

    def add(acc: Column, e: Column) -> Column:
        size = acc["size"] + weight(e)
        return F.when(size <= most, F.struct(size.alias("size"), F.map_concat(acc["map"], F.create_map(e["k"], e["v"])).alias("map"))).otherwise(acc)

    return F.aggregate(entries, start, add, lambda acc: acc["map"])


def record_id(stream: str, keys: Sequence[str], df: DataFrame) -> Column:
    """Id of a record of a stream by its key fields."""
    parts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(NO_KEY)) if k in df.columns else F.lit(NO_KEY) for k in keys]
    return F.concat_ws("_", F.lit(stream), *parts)


def documents(df: DataFrame, stream: str, text_fields: Sequence[str], keys: Sequence[str], size: int, overlap: int = 0, most: int | None = None) -> DataFrame:
    """(record_id, metadata, chunk_no, start, chunk) of records: their text fields as ``name: value`` lines, cut into chunks.
    Records whose text fields are all null have none."""
    lines = [F.when(F.col(f"`{f}`").isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f"`{f}`").cast("string"))) for f in text_fields]
    text = F.when(F.coalesce(*[F.col(f"`{f}`").isNotNull().cast("int") for f in text_fields]) >= 0, F.concat_ws("\n", *lines))
    rows = df.select(record_id(stream, keys, df).alias("record_id"), metadata(df, text_fields, most).alias("metadata"), text.alias("text"))
    return split_text(rows, "text", size, overlap)
