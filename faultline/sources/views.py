"""Telemetry-shaped views: metrics, runs, spans, logs and call edges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: ts, d, service, pod, metric, value."""
    service = F.concat(F.lit("svc"), (F.col("user_id") % 14).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("d"), service.alias("service"),
        F.concat(service, F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("pod"), F.col("event_type").alias("metric"), "value", "user_id", "props",
    )


def runs(spark: SparkSession) -> DataFrame:
    """One run a day of January 2024: odd days fail, even days pass; closed windows of 5 to 10 hours after midnight."""
    day = F.expr("date_add(date'2024-01-01', cast(id as int))")
    start = day.cast("timestamp_ntz")
    return spark.range(30).select(
        F.date_format(day, "yyyy-MM-dd").alias("run_id"), day.alias("d"), F.when(F.dayofmonth(day) % 2 == 1, "fail").otherwise("pass").alias("label"),
        (start + F.expr("interval 5 hours")).alias("window_start"), (start + F.expr("interval 10 hours")).alias("window_end"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per user and day; each event's parent is the one before it."""
    day = F.date_format("ts", "yyyy-MM-dd")
    in_trace = Window.partitionBy("trace_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("trace_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), day))
    return rows.select(
        "trace_id", F.col("event_id").alias("span_id"), F.lag("event_id").over(in_trace).alias("parent_span_id"), F.col("event_type").alias("service"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), (F.col("value") * 1000).cast("long").alias("duration_us"), day.alias("day"),
    )


def tree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans as branching traces: a span's parent is the one at half its place; each eleventh has a parent that is missing."""
    in_trace = Window.partitionBy("trace_id").orderBy("start_us", "span_id")
    rows = spans(spark, sf_dir).drop("parent_span_id").withColumn("rn", F.row_number().over(in_trace))
    up = rows.select("trace_id", F.col("rn").alias("half"), F.col("span_id").alias("up"))
    joined = rows.withColumn("half", F.floor(F.col("rn") / 2).cast("int")).join(up, ["trace_id", "half"], "left")
    return joined.withColumn("parent_span_id", F.when(F.col("rn") % 11 == 0, -F.col("span_id")).otherwise(F.col("up"))).drop("rn", "half", "up")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as log messages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.col("role").alias("service"), F.col("text").alias("message"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between nations: customer's nation to supplier's nation, with the line's price as weight."""
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey).join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.col("l_extendedprice").alias("weight"), F.col("o_orderdate").alias("ts"))
