"""What the operators of this package share: input tables, lineage cuts, word rules, bounded bitmap filters."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word is a maximal run of characters outside these six: space, \t, \n, \v, \f, \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes of a row group of an intermediate table: what a task holds while it writes one.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` named. On one machine
    (tests) a temporary folder stands in; on a cluster without either setting there is no such folder, an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and own.isDefined():
        at = own.get()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends there.

    The files outlive lost executors and are removed by ``discard`` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle-{name}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": ROW_GROUP} | options).parquet(path)
    folder, at = _folder(spark, path)
    folder.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _SCRATCH.get([]).append(out)
    return out


#: Tables that go when the innermost ``scratch`` ends.
_SCRATCH: ContextVar[list[DataFrame]] = ContextVar("scratch")


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables of ``written`` made inside are deleted at its end, but for those given to the function it yields: for steps of
    which one table is left."""
    own: list[DataFrame] = []
    stays: list[DataFrame] = []
    before = _SCRATCH.set(own)

    def keep(df: DataFrame) -> DataFrame:
        stays.append(df)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(before)
        kept = {df._written for df in stays}
        for df in own:
            if df._written not in kept:
                discard(df)
        _SCRATCH.get([]).extend(stays)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    folder, at = _folder(df.sparkSession, df._written)
    folder.delete(at, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


# --- bitmap filters -------------------------------------------------------------------------------------------------

#: Bits of one row of a filter: what bitmap_construct_agg returns, 4096 bytes.
BITMAP_BITS = 32768


def slot_of(keys: list[Column], bits: int) -> Column:
    """Place of some keys in a filter of so many bits."""
    return F.pmod(F.xxhash64(*keys, F.lit("bitmap")), F.lit(bits))


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: 16 each, between 1 million and 134 million (16 MB), whatever the input."""
    return min(1 << 27, max(1 << 20, 1 << (16 * max(keys, 1) - 1).bit_length()))


def bitmap_filter(df: DataFrame, keys: list[str], bits: int = 1 << 23, slot: Column | None = None) -> DataFrame:
    """A filter over the keys of ``df``: at most bits / 32768 rows of 4 KB, whatever the number of keys.

    Its size is bounded by ``bits`` (1 MB by default), so it may be broadcast. A key of ``df`` always passes;
    others pass at the rate at which the bitmap is full, and have to be told apart by what follows. ``slot`` takes the place
    of keys where slots are known already.
    """
    slot = slot_of([F.col(k) for k in keys], bits) if slot is None else slot
    return (
        df.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    )


def _packed(df: DataFrame, name: str = "_in") -> Column:
    """All columns of ``df`` in one, so that whatever they are called meets no name used here."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _unpacked(df: DataFrame, name: str = "_in") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in df.columns]


def flagged(df: DataFrame, bitmap: DataFrame, keys: list[str], flag: str, bits: int = 1 << 23) -> DataFrame:
    """``df`` with the boolean ``flag``: the row's keys may be among those of the filter. The filter is broadcast, see
    its bound."""
    slot = df.select(_packed(df), slot_of([F.col(f"`{k}`") for k in keys], bits).alias("_slot"))
    slot = slot.withColumn("_bucket", F.bitmap_bucket_number("_slot")).withColumn("_at", F.bitmap_bit_position("_slot"))
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)).alias(flag)
    return slot.join(F.broadcast(bitmap), "_bucket", "left").select(*_unpacked(df), hit)


def passing(df: DataFrame, bitmap: DataFrame, keys: list[str], bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose keys may be among those of the filter."""
    return flagged(df, bitmap, keys, "_passes", bits).where("_passes").drop("_passes")


@F.arrow_udf(StringType())
def _without(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts without the spans, which are sorted; each piece that stays is taken once."""
    out = []
    for t, a, b in zip(text, starts, ends, strict=True):
        t, a, b = t.as_py(), a.as_py() or [], b.as_py() or []
        out.append("".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)))
    return pa.array(out, pa.string())


def without_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 1 << 23) -> DataFrame:
    """``df`` with the spans (id, hash, start, end) cut out of its texts; spans of a row don't overlap.

    A row is named by its id and the hash of its text. Only rows that a bounded filter lets through are shuffled.
    """
    text = F.col(f"`{text_col}`")
    docs = df.select(_packed(df), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    cuts = spans.groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    marked = flagged(docs, bitmap_filter(spans.select("id", "hash"), ["id", "hash"], bits), ["id", "hash"], "_cut", bits)
    t = F.coalesce(F.col(f"_in.`{text_col}`"), F.lit(""))
    rest = _without(t, F.col("_cuts.start"), F.col("_cuts.end"))
    left = F.when(F.col("_cuts").isNull(), F.col(f"_in.`{text_col}`")).otherwise(rest).alias(text_col)
    some = marked.where("_cut").join(cuts, ["id", "hash"], "left")
    own = [left if c == text_col else x for c, x in zip(df.columns, _unpacked(df), strict=True)]
    return marked.where("NOT _cut").select(*_unpacked(df)).unionByName(some.select(*own))


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that few texts at once become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Memory that a Python worker holds in reserve goes back to the system: it may idle for long beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows of an Arrow batch at most: texts may be long, and both the JVM and the Python worker hold whole batches.
BATCH_ROWS = 1000


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on cuts Arrow batches at BATCH_ROWS rows, or at fewer where it is set so."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    now = int(conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def quiet_threads() -> None:
    """One thread for each library in a Python worker: the executor's cores are Spark's to deal out."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
