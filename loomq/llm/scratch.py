"""Written tables in the folder that all executors share: they cut lineage and survive a lost executor.

They are deleted when the session's JVM ends, or before by :meth:`Scratch.drop`: results are
lazy and read them.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only on one machine, as in tests, where the session names no folder.
DEFAULT_DIR = "/tmp/checkpoints/loomq"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, DEFAULT_DIR on one machine and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = DEFAULT_DIR
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables of one run of one operator, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._kept = False

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back; its shuffle files may go once it is written."""
        path = f"{self.root}/{name}"
        with _freeing_shuffles(self.spark):
            df.write.parquet(path)
        if not self._kept:
            fs, root = self._fs(self.root)
            fs.deleteOnExit(root)
            self._kept = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)


#: Spark's own switch that frees the shuffle files of a finished query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str]] = {}


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """The switch is on while any thread of the session writes, and then as it was."""
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        n, before = _WRITING.get(session, (0, spark.conf.get(CLEANUP, "false")))
        _WRITING[session] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(session)
            if n > 1:
                _WRITING[session] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)
