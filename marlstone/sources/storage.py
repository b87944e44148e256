"""Small files of the catalog, through Hadoop's file systems, so that a database can lie wherever Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self.path(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole or not at all; the name must be new."""
        stream = self.fs.create(self.path(f"{name}.tmp"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self.path(f"{name}.tmp"), self.path(name)):
            raise OSError(f"{name} exists")
