"""Small named files that appear whole or not at all."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """The name was published before."""


class Commits:
    """A folder of published texts; a name is given once, by one rename that refuses to replace."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self.path().toUri(), conf)

    def path(self, *names: str):
        return self._hadoop.Path("/".join([self.folder, *names]))

    def names(self) -> list[str]:
        """Published names, sorted; files that are still being written have a suffix."""
        if not self.fs.exists(self.path()):
            return []
        names = [status.getPath().getName() for status in self.fs.listStatus(self.path())]
        return sorted(name for name in names if "." not in name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        unnamed = self.path(f"{name}.{os.urandom(6).hex()}")
        self.fs.mkdirs(self.path())
        out = self.fs.create(unnamed, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._context.rename(unnamed, self.path(name), options)
        except Exception as error:
            self.fs.delete(unnamed, False)
            if self.fs.exists(self.path(name)):
                raise Taken(f"{self.folder}: {name} was published before") from error
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), False)
