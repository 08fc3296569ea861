"""Folders and files that all executors and the driver share, reached through Hadoop's filesystems."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs in this process, as in tests, a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="noteloom-core-")
        place = _OWN[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lineage cut whose columns can be pruned. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noteloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        Files(spark, path).delete()
    except Exception:  # the session may be gone by then
        pass


class Files:
    """Small files and renames on any Hadoop filesystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self):
        return self.path().getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self.fs().exists(self.path(name))

    def read(self, name: str) -> str | None:
        """The text of a small file, None if there is none."""
        if not self.exists(name):
            return None
        stream = self.fs().open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _aside(self, name: str, text: str):
        aside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs().create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return aside

    def _rename(self, source, target, kind: str) -> bool:
        """Rename under an option of Hadoop's file contexts, one step where the store has it so; False if the target is there."""
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), kind)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs().getUri(), self._conf).rename(source, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def write(self, name: str, text: str) -> None:
        """Replace a small file: written aside, then renamed over the old one."""
        self._rename(self._aside(name, text), self.path(name), "OVERWRITE")

    def create(self, name: str, text: str) -> bool:
        """Create a small file as a whole; False, with nothing changed, if there is one of this name."""
        aside = self._aside(name, text)
        if self._rename(aside, self.path(name), "NONE"):
            return True
        self.fs().delete(aside, False)
        return False

    def rename(self, old: str, new: str) -> bool:
        """Rename a file or folder; False if the new name is taken."""
        return self._rename(self.path(old), self.path(new), "NONE")

    def delete(self, name: str = "") -> None:
        self.fs().delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs().listStatus(self.path(name))) if not n.endswith(".tmp"))

    def status(self) -> list:
        """Hadoop's status of the file or of the files in the folder."""
        return list(self.fs().listStatus(self.path()))

    def walk_status(self, suffix: str, skip: str) -> Iterator:
        """Hadoop's status of the files below the root whose names end in ``suffix``, without folders named ``skip``.

        Unlike Spark's listing this sees names that begin with a dot or an underscore.
        """
        if not self.exists():
            return
        todo = [self.path()]
        while todo:
            for s in self.fs().listStatus(todo.pop()):
                if s.isDirectory():
                    if s.getPath().getName() != skip:
                        todo.append(s.getPath())
                elif s.getPath().getName().endswith(suffix):
                    yield s
