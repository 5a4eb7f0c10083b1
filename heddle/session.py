"""A session with the settings these operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "heddle", **conf: str) -> SparkSession:
    """Get or create a session: UTC, adaptive execution, skew joins split. ``conf`` adds settings, dots as ``__``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` named. On one machine a
    temporary folder stands in; on a cluster without either setting there is no such folder, an error."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="heddle-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with its lineage cut by a Parquet table in the folder that executors share, in folders for the values of ``by``; it goes
    when the driver's JVM ends.

    A checkpoint would keep the estimates of the plan before, and the size that is estimated for a join is a product: over
    rounds its digits grow as a power, until planning does nothing but multiply. A table has its true size. Only what Parquet
    cannot store is a checkpoint.
    """
    spark, kinds = df.sparkSession, df.schema.simpleString()
    if "void" in kinds or "interval" in kinds:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return df.checkpoint()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(at.toString())
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(at.toString())
    out._cut = at
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of a ``cut`` that nothing reads any more."""
    at = getattr(df, "_cut", None)
    if at is not None:
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
