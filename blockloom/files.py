"""Small files and folders on whatever file system a path names, through Hadoop."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Existence, listing, deletion and whole-file writes that appear at once."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def glob(self, pattern: str) -> list[tuple[str, float]]:
        """(path, seconds since 1970 at which it was changed) of what fits a pattern."""
        fs, p = self._at(pattern)
        return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in fs.globStatus(p) or ()]

    def read(self, path: str) -> bytes:
        """A small file, whole."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> bool:
        """Makes a file that readers see whole or not at all, unless there is one of that name; whether it was made.

        The text is written beside its place. A local disk then links it to the
        name, other file systems rename it without overwriting; both fail if the
        name is taken, so of several writers one succeeds.
        """
        folder = path.rpartition("/")[0]
        fs, beside = self._at(f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, target = self._jvm, self._path(path)
        try:
            if fs.getScheme() == "file":
                nio = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(nio(target), nio(beside))
            else:
                options = self._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(beside, target, options)
            return True
        except Py4JJavaError as failed:
            if "FileAlreadyExists" not in failed.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(beside, False)
