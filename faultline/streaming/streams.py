"""Telemetry as streams: windows with late data, sessions, deduplication and online templates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.drain import SIMILARITY, fold, leaf
from ..operators.joins import small

LATE = "10 minutes"


def bucket_stats(rows: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", size: str = "5 seconds", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Count, sum and mean of each key and (sliding) window; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = rows.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean")


def sessions(rows: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    grouped = rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def unique_spans(rows: DataFrame, keys: Sequence[str] = ("trace_id", "span_id"), ts: str = "ts", late: str = LATE) -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def alarms(rows: DataFrame, base: DataFrame, keys: Sequence[str], value: str = "value", limit: float = 3.0) -> DataFrame:
    """Stream rows further than limit deviations from a static baseline."""
    z = F.abs(F.col(value) - F.col("mean")) / F.col("sigma")
    return rows.join(small(base.where("sigma > 1e-8")), list(keys)).withColumn("z", z).where(F.col("z") > limit)


def online_templates(lines: DataFrame, message: str = "message", least: float = SIMILARITY) -> DataFrame:
    """Templates and counts of each leaf so far; update mode."""

    def mine(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = [(t.split(" "), n) for t, n in zip(*state.get)] if state.exists else []
        for pdf in batches:
            known = fold(known + [(m.split(), 1) for m in pdf[message]], least)
        state.update(([" ".join(t) for t, _ in known], [n for _, n in known]))
        yield pd.DataFrame({"leaf": key[0], "template": [" ".join(t) for t, _ in known], "n": [n for _, n in known]})

    keyed = lines.where(F.trim(message) != "").select(leaf(F.col(message)).alias("leaf"), message)
    return keyed.groupBy("leaf").applyInPandasWithState(mine, "leaf string, template string, n long", "templates array<string>, counts array<long>", "update", "NoTimeout")


def into_memory(stream: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    """All available rows, then stop."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
