"""Planning of collection hours, and methods that run over days."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..sources import sinks


def hour_windows(days: DataFrame, day: str, hours: Sequence[int]) -> DataFrame:
    """One window an hour of each day: day, hour and its start in microseconds."""
    rows = days.select(day, F.explode(F.array(*(F.lit(h) for h in hours))).alias("hour"))
    start = F.unix_micros(F.col(day).cast("timestamp")) + F.col("hour").cast("long") * 3_600_000_000
    return rows.select(F.date_format(day, "yyyy-MM-dd").alias("day"), "hour", start.alias("start_us"))


def by_day(rows: DataFrame, day: str, method: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The method's rows for all days, and (day, status, error) of those that failed.

    The method keeps the day among its keys, so all days are one job.  Only if that job
    fails does each day run alone, and a day's failure leaves the others.
    """
    try:
        return sinks.stored(method(rows), name), []
    except PySparkException:
        pass
    done, failed = None, []
    for r in rows.select(day).distinct().orderBy(day).collect():
        try:
            one = sinks.stored(method(rows.where(F.col(day) == r[0])), name)
            done = one if done is None else done.unionByName(one)
        except PySparkException as e:
            failed.append((str(r[0]), "error", str(e)[:500]))
    return (method(rows.limit(0)) if done is None else done), failed
