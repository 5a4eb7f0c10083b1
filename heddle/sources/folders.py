"""Files beside tables: small facts that are there or not, written and read by the driver through Spark's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def there(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, hidden files left out; nothing if there is no such folder."""
        if not self.there(name):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self._fs.listStatus(self._at(name))) if not n.startswith((".", "_")))

    def put(self, name: str, text: str = "") -> bool:
        """A file with a text, whole or not at all: written beside its place and moved there. False if there is one already."""
        temp, at = self._at(f"_tmp-{name.replace('/', '-')}"), self._at(name)
        if self._fs.exists(at):
            return False
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(at.getParent())
        if not self._fs.rename(temp, at):
            raise OSError(f"cannot move {temp} to {at}")
        return True

    def text(self, name: str) -> str:
        with_bytes = self._fs.open(self._at(name))
        try:
            return bytes(with_bytes.readAllBytes()).decode()
        finally:
            with_bytes.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
