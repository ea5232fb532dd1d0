"""Tables between the stages of a job, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Workspace"] = []

#: Bytes of a row group of large rows, and of a batch that goes to a Python worker.
ROW_GROUP, BATCH_BYTES = 8 << 20, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset (local tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "faultline")
        spark.conf.set("faultline.shared.folder", folder)
    return folder.rstrip("/")


class Workspace:
    """Parquet tables of one job.  They outlive lost executors; drop() or the end of the session removes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def table(self, name: str, df: DataFrame, large_rows: bool = False) -> DataFrame:
        """Write and reread, so that later stages don't recompute.  large_rows: of up to a megabyte or more, for which writers and readers hold ROW_GROUP bytes and not a hundred rows at least."""
        options = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1} if large_rows else {}
        df.write.mode("overwrite").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished stages now, not when the driver next happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside sends rows to Python workers in batches of about so many bytes, whatever the rows' size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def scope() -> Iterator[None]:
    """Removes the tables of the workspaces that were opened inside, once their results are written."""
    mark = len(_OPEN)
    try:
        yield
    finally:
        for w in _OPEN[mark:]:
            w.drop()
        del _OPEN[mark:]


@atexit.register
def _clean() -> None:
    for w in _OPEN:
        try:
            w.drop()
        except Exception:  # noqa: BLE001, S112  the session may be gone already
            continue


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
