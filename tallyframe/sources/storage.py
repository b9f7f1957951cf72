"""Small files and folders in any store that Spark reaches, through the session's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder: text files that appear whole or not at all, moves, lists. Driver side, for metadata only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.folder}/{name}" if name else self.folder)
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none where there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Written aside, then moved into place. An existing file is an error."""
        aside = f"{name}.writing"
        stream = self._fs.create(self._path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.move(aside, name)

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target} in {self.folder}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
