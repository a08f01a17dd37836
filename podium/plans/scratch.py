"""Shared scratch tables: the way this library cuts lineage.

Iterative jobs write their state as Parquet into the folder that the cluster
names in ``spark.checkpoint.dir`` and read it back.  The files outlive any
executor, so a lost executor costs a re-read and nothing else.  Results read
scratch tables lazily, so a run's tables stay until the driver's process ends,
which deletes what it still holds.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only where none is, and only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="podium-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, SparkSession] = {}


@atexit.register
def _delete_all() -> None:
    for root, spark in _roots.items():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, root)


class Scratch:
    """Names, writes and drops scratch tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/podium/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _roots[self.root] = spark

    def table(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", compression).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._podium_path = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            path = getattr(t, "_podium_path", None)
            if path:
                _delete(self.spark, path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps, which it does once their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()
