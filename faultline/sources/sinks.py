"""Writers: fixed-header CSV, hour-partitioned Parquet, result tables keyed by case, reuse by context."""

from __future__ import annotations

from collections.abc import Sequence

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors share: below spark.checkpoint.dir, or a temporary one where that is unset in a local session.  It goes at the end of the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "faultline")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, S112  the session may be gone already
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and reread, for plans that use it several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_graph(edges: DataFrame, path: str, case: str) -> None:
    """Edges of all cases as one table, by case; read_graph() gives them back."""
    edges.repartition(case).write.mode("overwrite").partitionBy(case).parquet(path)


def read_graph(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    return spark.read.schema(kinds).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with the given header, also when there are no rows."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_hours(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet by day and hour; rewriting some hours leaves the others."""
    keyed = df.withColumns({"day": F.date_format(ts, "yyyy-MM-dd"), "hour": F.hour(ts)})
    keyed.repartition("day", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(path)


def write_cases(df: DataFrame, path: str, keys: Sequence[str] = ("day", "exp_id")) -> None:
    """One long table; nested columns become JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.withColumns(nested).write.mode("append").partitionBy(keys[0]).parquet(path)


def context_key(**context: object) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(context, sort_keys=True, default=str).encode()).hexdigest()


def reused(spark: SparkSession, root: str, make, **context: object) -> DataFrame:
    """The table saved under the same context, else make()'s rows, saved."""
    path = f"{root.rstrip('/')}/{context_key(**context)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
