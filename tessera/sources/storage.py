"""Files wherever Spark can reach them: HDFS, object stores and local disks through the session's Hadoop file systems."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    folder: bool
    size: int
    modified: int


class Storage:
    """Small driver-side operations on paths with or without a scheme; data itself goes through readers and writers."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[Entry]:
        """What a folder holds, by name; a missing folder is an error."""
        fs, p = self._at(path)
        found = [Entry(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return sorted(found, key=lambda e: e.name)

    def modified(self, path: str) -> int:
        """Milliseconds since 1970."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole file, in place of one that exists; folders are made."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def create(self, path: str) -> bool:
        """An empty file, unless there is one: whether it was made. Atomic where the file system's exclusive creation is."""
        fs, p = self._at(path)
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, path: str) -> bool:
        """A file, or a folder with all it holds; whether there was one."""
        fs, p = self._at(path)
        return fs.delete(p, True)

    def move(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self._at(to)[1])

    def purge(self, path: str, keep: set[str]) -> list[str]:
        """Removes the folder's entries that aren't named in ``keep``; their names."""
        gone = [e for e in self.list(path) if e.name not in keep] if self.exists(path) else []
        for e in gone:
            self.delete(e.path)
        return [e.name for e in gone]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the session's shared folder (``spark.checkpoint.dir``); a local one only where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
