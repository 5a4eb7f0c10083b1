"""Change streams into a table, each change once.

The table is cut into buckets by a hash of the key. A micro-batch reads and rewrites only the buckets that its keys fall into,
under a folder of its own, and then puts a manifest that says for each bucket which batch wrote it last. The manifest is the
commit: it comes into being as a whole, it is the ledger of batch ids, and a batch whose id is there changes nothing. A row
carries the place of its change in the log; a change counts only if it is later than what is known of its key, deletions
included, so changes that come again, or too late, in another batch do no harm either.

Bounds: a manifest has one entry for each bucket, and the buckets that a batch touches are collected: both are at most
``buckets``, a fixed number of the table. Deleted keys stay as rows without values until ``vacuum``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.folders import Folder


class ChangeTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], order: Sequence[str], deleted: str, buckets: int = 64) -> None:
        """``deleted``: a boolean column of the changes that says that the key goes."""
        self.spark, self.folder, self.schema = spark, Folder(spark, path), schema
        self.key, self.order, self.deleted, self.buckets = list(key), list(order), deleted, buckets

    def manifest(self) -> tuple[int | None, dict[int, int]]:
        """The last batch that was committed, and the batch that wrote each bucket last."""
        last = max(map(int, self.folder.names("manifests")), default=None)
        return last, {} if last is None else {int(k): v for k, v in json.loads(self.folder.text(f"manifests/{last}")).items()}

    def _rows(self, where: dict[int, int]) -> DataFrame:
        files = [f"{self.folder.path}/data/batch={v}/bucket={b}" for b, v in where.items() if self.folder.there(f"data/batch={v}/bucket={b}")]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """Rows of all keys that are there."""
        return self._rows(self.manifest()[1]).where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted)

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Merge a batch of changes; False if it is there already."""
        last, where = self.manifest()
        if last is not None and batch <= last:
            return False
        names = self.schema.names
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        order = F.struct(*self.order)
        new = changes.select(*names).groupBy(*self.key).agg(F.max_by(F.struct(*names), order).alias("_r")).select("_r.*").withColumn("_b", bucket)
        touched = [r[0] for r in new.select("_b").distinct().collect()]
        known = self._rows({b: where[b] for b in touched if b in where}).withColumn("_b", bucket)
        merged = known.unionByName(new).groupBy(*self.key).agg(F.max_by(F.struct(*names, "_b"), order).alias("_r")).select("_r.*")
        # One folder for each bucket: rows of a bucket are written by one task, and so is a bucket's size the unit of a rewrite.
        merged.withColumnRenamed("_b", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/data/batch={batch}")
        self.folder.put(f"manifests/{batch}", json.dumps(where | dict.fromkeys(touched, batch)))
        return True

    def batch(self, changes: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        self.apply(changes, batch)

    def vacuum(self) -> list[int]:
        """Delete what no bucket's last version needs: older manifests, then batches that the last one doesn't name; numbers of those.
        Readers that began before may still hold the old files, so it is for quiet times."""
        last, where = self.manifest()
        for n in self.folder.names("manifests"):
            if int(n) != last:
                self.folder.delete(f"manifests/{n}")
        old = sorted(b for b in (int(n.split("=")[1]) for n in self.folder.names("data")) if b not in where.values())
        for b in old:
            self.folder.delete(f"data/batch={b}")
        return old
