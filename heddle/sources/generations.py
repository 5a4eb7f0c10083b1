"""Tables by generation: a refresh is written beside the table that is read and takes its place once it is whole.

A generation is a folder of batches; a batch that is written again replaces itself. ``finish`` says that a generation is
whole, ``publish`` points readers to it. The pointer is the newest of a row of numbered files, so publishing is one file that
comes into being, a rollback is a pointer to what was read before, and a snapshot is a pointer's number. ``clean`` deletes
generations that none of the last pointers names; it never touches one that is being written. A crash between any two steps
leaves readers with the generation they had.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from heddle.sources.folders import Folder


class GenerationTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.folder, self.schema = spark, Folder(spark, path), schema

    # --- writing ---

    def write(self, df: DataFrame, generation: int, batch: int) -> None:
        """A batch of a generation; a finished one takes no more."""
        if self.whole(generation):
            raise ValueError(f"generation {generation} is finished")
        df.write.mode("overwrite").parquet(self._at(generation, batch))

    def append(self, df: DataFrame, generation: int) -> int:
        """A batch after the last one of a generation; its number."""
        batch = max(self.batches(generation), default=-1) + 1
        self.write(df, generation, batch)
        return batch

    def transfer(self, source: int, target: int) -> None:
        """Batches of a generation, such as one that an earlier attempt began, become batches of another one: they are moved one
        by one and keep what they hold, so a transfer that was broken off goes on where it stands."""
        if self.whole(source) or self.whole(target):
            raise ValueError("only unfinished generations are transferred")
        if source == target:
            return
        for batch in self.batches(source):
            # The name tells where a batch came from: it is never moved twice nor onto another.
            df = self.spark.read.schema(self.schema).parquet(self._at(source, batch))
            self.write(df, target, batch + 1_000_000 * (source + 1))
            self.folder.delete(f"data/generation={source}/batch={batch}")

    def finish(self, generation: int) -> None:
        self.folder.put(f"whole/{generation}")

    def whole(self, generation: int) -> bool:
        return self.folder.there(f"whole/{generation}")

    def drop(self, generation: int) -> None:
        """Forget a generation that is not read."""
        if generation == self.current():
            raise ValueError(f"generation {generation} is the one that is read")
        self.folder.delete(f"whole/{generation}")
        self.folder.delete(f"data/generation={generation}")

    # --- looking up ---

    def _at(self, generation: int, batch: int) -> str:
        return f"{self.folder.path}/data/generation={generation}/batch={batch}"

    def generations(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.folder.names("data"))

    def batches(self, generation: int) -> list[int]:
        """Batches that were written to their end."""
        at = f"data/generation={generation}"
        return sorted(int(n.split("=")[1]) for n in self.folder.names(at) if self.folder.there(f"{at}/{n}/_SUCCESS"))

    def newest_whole(self) -> int | None:
        return max((int(n) for n in self.folder.names("whole")), default=None)

    def unfinished(self) -> int | None:
        """The newest generation that an attempt has begun and not finished: a refresh of the same number goes on with it."""
        return max((g for g in self.generations() if not self.whole(g)), default=None)

    # --- pointers ---

    def snapshots(self) -> list[tuple[int, int]]:
        """(number, generation) of all pointers, oldest first."""
        return [(int(n), json.loads(self.folder.text(f"pointers/{n}"))["generation"]) for n in sorted(self.folder.names("pointers"), key=int)]

    def current(self) -> int | None:
        """The generation that is read."""
        found = self.snapshots()
        return found[-1][1] if found else None

    def publish(self, generation: int) -> int:
        """Point readers to a whole generation; the number of the snapshot. Publishing what is read already changes nothing."""
        if not self.whole(generation):
            raise ValueError(f"generation {generation} is not whole")
        found = self.snapshots()
        if found and found[-1][1] == generation:
            return found[-1][0]
        number = found[-1][0] + 1 if found else 0
        if not self.folder.put(f"pointers/{number}", json.dumps({"generation": generation})):
            raise OSError(f"snapshot {number} was taken meanwhile")
        return number

    def rollback(self, snapshot: int | None = None) -> int:
        """Read again what a snapshot named, by default the one before the last; the number of the new snapshot."""
        found = dict(self.snapshots())
        at = snapshot if snapshot is not None else sorted(found)[-2] if len(found) > 1 else None
        if at not in found:
            raise ValueError(f"no snapshot {at}")
        return self.publish(found[at])

    def clean(self, keep: int = 2) -> list[int]:
        """Delete generations that are whole and named by none of the last ``keep`` pointers; their numbers."""
        named = {g for _, g in self.snapshots()[-keep:]}
        newest = self.newest_whole()
        old = [g for g in self.generations() if self.whole(g) and g not in named and g != newest]
        for g in old:
            self.drop(g)
        return old

    def read(self, snapshot: int | None = None) -> DataFrame:
        """Rows of the generation that is read, or of a snapshot; none before the first is published."""
        generation = self.current() if snapshot is None else dict(self.snapshots())[snapshot]
        there = [] if generation is None else [self._at(generation, b) for b in self.batches(generation)]
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    # --- final tables of a sync ---

    def refresh(self, frames: list[DataFrame], generation: int) -> int:
        """A whole refresh: batches that an earlier attempt of this generation wrote are replaced, older attempts dropped, and
        the generation is read once all of it is there."""
        if self.whole(generation):
            return self.publish(generation)
        for g in self.generations():
            if g < generation and not self.whole(g):
                self.drop(g)
        for i, df in enumerate(frames):
            self.write(df, generation, i)
        self.finish(generation)
        return self.publish(generation)
