"""Database scans, paged sources, partition routers and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from heddle.session import cut


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 8, fetch: int = 1000, predicates: Sequence[str] | None = None, **properties: str) -> DataFrame:
    """A table over JDBC, split by a numeric column, by predicates (physical ranges) or not at all."""
    own = {"fetchsize": str(fetch), **properties}
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=own)
    if partition:
        return spark.read.jdbc(url, table, column=partition, lowerBound=low, upperBound=high, numPartitions=parts, properties=own)
    return spark.read.jdbc(url, table, properties=own)


def keyset_page(df: DataFrame, key: str, after, upto, most: int) -> DataFrame:
    """The next rows in key order after a value and up to another: one chunk of a resumable load."""
    out = df if after is None else df.where(F.col(key) > F.lit(after))
    out = out if upto is None else out.where(F.col(key) <= F.lit(upto))
    return out.orderBy(key).limit(most)


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- partition routers ----------------------------------------------------------------------------------------------


def list_slices(spark: SparkSession, field: str, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"`{field}` string")


def single_slice(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


def slice_product(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Every combination of slices; of a field that several have, the first one's value stays. Routers are lists of
    partitions that a person writes down, so their product is meant."""
    out = first
    for o in others:
        out = out.crossJoin(o.drop(*[c for c in o.columns if c in out.columns]))
    return out


def substream_slices(parent: DataFrame, key: str, field: str) -> DataFrame:
    """One slice per key of a parent stream."""
    return parent.select(F.col(key).alias(field)).distinct()


# --- paged source ---------------------------------------------------------------------------------------------------


class _Slice(InputPartition):
    def __init__(self, value) -> None:
        self.value = value


#: Position after a page at a position, None if that page is the last.
Advance = Callable[[object, list[tuple]], object]


def by_offset(size: int) -> Advance:
    """Positions count rows; a short page is the last."""
    return lambda at, page: at + len(page) if len(page) >= size else None


def by_page(size: int) -> Advance:
    """Positions count pages; a short page is the last."""
    return lambda at, page: at + 1 if len(page) >= size else None


def by_token(token: Callable[[list[tuple]], object], last: Callable[[list[tuple]], bool] | None = None) -> Advance:
    """Positions are tokens read from the page before; a page without one, an empty one and one that ``last`` tells are the
    last."""
    return lambda at, page: None if not page or (last and last(page)) else (token(page) or None)


def paged_source(name: str, schema: str, fetch: Callable[[object, int, int], list[tuple]], slices: Sequence = (None,), size: int = 100, stop: Callable[[tuple], bool] | None = None, advance: Advance | None = None, begin=0) -> type[DataSource]:
    """A Python data source that reads pages: ``fetch(slice, position, size)`` gives the rows of one. ``advance`` tells the
    position after a page, None after the last; it is one of ``by_offset``, ``by_page`` and ``by_token``. A page with a row
    for which ``stop`` holds is the last; that row and those after it are left out."""
    advance = advance or by_offset(size)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Slice(s) for s in slices]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            at = begin
            while True:
                page = fetch(partition.value, at, size)
                for row in page:
                    if stop and stop(row):
                        return
                    yield tuple(row)
                at = advance(at, page)
                if at is None:
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Source


def page_numbers(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``df`` with the page each row is on. One range of rows per task: places come from counts of the parts before."""
    # The ranges are drawn from a sample: a checkpoint keeps the counts and the rows of one and the same draw.
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p").withColumn("page", F.floor((F.col("_i") + F.col("_before")) / size).cast("long")).drop("_p", "_i", "_before")


class _PageRange(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


def paged_stream(name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: Callable[[], int]) -> type[DataSource]:
    """A stream of pages, the state of which is the number of the next one: a load that ended goes on from the checkpoint.
    ``pages()`` tells how many there are by now; pages are fetched on executors, each by a task of its own."""

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"page": 0}

        def latestOffset(self) -> dict:
            return {"page": pages()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [_PageRange(i) for i in range(start["page"], end["page"])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from map(tuple, fetch(partition.page))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader()

    return Source


# --- generators -----------------------------------------------------------------------------------------------------


def users(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    u = spark.range(1, n + 1)
    return u.select("id", F.concat(F.lit("user"), F.col("id"), F.lit("@example.com")).alias("email"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(60)) + 18).alias("age"))


def products(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(1, n + 1).select("id", F.concat(F.lit("product "), F.col("id")).alias("name"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100_000)) / 100).alias("price"))


def purchases(spark: SparkSession, n_users: int, n_products: int, seed: int = 0) -> DataFrame:
    """Purchases of each user: as many as the last digit of the id says, 0 for 0 to 4, then up to 5."""
    u = spark.range(1, n_users + 1).withColumn("n", F.greatest(F.col("id") % 10 - 4, F.lit(0)))
    rows = u.select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"), "n").where("n > 0")
    return rows.select(F.concat_ws("-", "user_id", "k").alias("id"), "user_id", (F.pmod(F.xxhash64("user_id", "k", F.lit(seed)), F.lit(n_products)) + 1).alias("product_id"))


def speed_records(spark: SparkSession, n: int = 24_000_000) -> DataFrame:
    """Records of five text fields."""
    return spark.range(n).select(*[F.concat(F.lit(f"field{i} valuevaluevaluevaluevalue"), F.col("id")).alias(f"field{i}") for i in range(1, 6)])
