"""Small files on any file system that Spark reaches, through Hadoop's interface."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidemill.errors import ConflictError, StorageError

#: Writing a manifest takes far less.
STALE_SECONDS = 60


class Files:
    """``create`` is exclusive where the file system makes it so (links of local files, HDFS): the base of compare-and-swap."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def qualified(self, path: str) -> str:
        p, fs = self._at(path)
        return fs.makeQualified(p).toString()

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a file that must not exist; ``ConflictError`` if it does."""
        p, fs = self._at(path)
        # The name appears with its content: written aside, then renamed, and renaming never replaces.
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if not (self._linked(fs, aside, p) if p.toUri().getScheme() in (None, "file") else self._claimed(fs, aside, p)):
                raise ConflictError(f"{path} was written by another commit")
        finally:
            if fs.exists(aside):
                fs.delete(aside, False)

    def _linked(self, fs, aside, p) -> bool:
        """A local file gets its name by a hard link, which fails where the name is taken."""
        paths = [self.jvm.java.io.File(x.toUri().getPath()).toPath() for x in (p, aside)]
        try:
            self.jvm.java.nio.file.Files.createLink(*paths)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            return self._claimed(fs, aside, p)  # a file system without links

    def _claimed(self, fs, aside, p) -> bool:
        """Elsewhere a name is claimed first. Who writes must still own the claim, and renaming (on HDFS) doesn't replace."""
        claim, owner = self.jvm.org.apache.hadoop.fs.Path(f"{p.toString()}.claim"), uuid.uuid4().hex
        return not fs.exists(p) and self._claim(fs, claim, owner) and self._owner(fs, claim) == owner and not fs.exists(p) and fs.rename(aside, p)

    def _owner(self, fs, claim) -> str:
        try:
            return self.read(claim.toString())
        except Py4JJavaError:
            return ""

    def _claim(self, fs, claim, owner: str) -> bool:
        """Claim a name. A claim whose writer died before it wrote is taken over when it is old."""

        def make() -> bool:
            try:
                stream = fs.create(claim, False)
                stream.write(bytearray(owner.encode()))
                stream.close()
                return True
            except Py4JJavaError:
                return False

        if make():
            return True
        try:
            old = time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS
        except Py4JJavaError:
            return False
        return old and fs.delete(claim, False) and make()

    def replace(self, path: str, text: str) -> None:
        """Write a file whose name always has the old content or the new one."""
        p, fs = self._at(path)
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(fs.makeQualified(aside), fs.makeQualified(p), options)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def parts(self, path: str) -> list[str]:
        """The Parquet files in a folder that Spark has written."""
        p, fs = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make_folder(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise StorageError(f"can't move {old} to {new}")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)
