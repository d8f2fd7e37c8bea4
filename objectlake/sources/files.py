"""Small files through Hadoop's file systems, so that any path Spark reads will do."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; a temporary folder only for local sessions that set none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="objectlake-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/objectlake-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Appears whole or not at all: a temporary file is renamed over the old one."""
        made = self._path(f"{name}.tmp")
        stream = self.fs.create(made, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if not self.fs.rename(made, self._path(name)):  # some systems don't replace
            self.fs.delete(self._path(name), False)
            if not self.fs.rename(made, self._path(name)):
                raise OSError(f"can't write {name}")

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
