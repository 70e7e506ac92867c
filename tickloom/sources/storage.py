"""Small files and folders through the Hadoop file system, so that they lie where Spark writes its tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by any path that Spark takes; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def path(self, name: str = "") -> str:
        """As Spark and pyarrow take it."""
        text = self._at(name).toString()
        return text[len("file:") :] if text.startswith("file:/") else text

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root)] if self.fs.exists(self.root) else []

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._at(name))

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def copy_from(self, path: str, name: str) -> None:
        """A file or folder; a path without a scheme is a local one."""
        source = self.jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(self.conf), source, self.fs, self._at(name), False, self.conf)

    def rename(self, name: str, to: str) -> bool:
        return self.fs.rename(self._at(name), self._at(to))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
