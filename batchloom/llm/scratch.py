"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WORKING: ContextVar[list | None] = ContextVar("working", default=None)


@contextmanager
def working():
    """What operators leave in the shared folder within this block goes at its end, so their results have to be written by then."""
    outer = _WORKING.set([])
    try:
        yield
    finally:
        for scratch in _WORKING.get():
            scratch.close()
        _WORKING.reset(outer)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="batchloom-"))
    return _LOCAL[0]


class Scratch:
    """Parquet tables of one run, each written once and read back.

    Reading back cuts the lineage: a lost executor costs the tasks that were
    running, not the steps before, and values such as row numbers stay as
    they were written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _WORKING.get() is not None:
            _WORKING.get().append(self)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._batchloom_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Give the space of tables back that no later step reads."""
        for table in tables:
            self._delete(table._batchloom_path)

    def close(self) -> None:
        """Give all of it back."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
