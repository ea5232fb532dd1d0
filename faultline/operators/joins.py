"""Range, as-of, wildcard and key joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of a side that may be broadcast; Spark's own estimate decides below it, a shuffle join is used beyond.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate is within the bound."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def in_windows(rows: DataFrame, windows: DataFrame, ts: str = "ts", start: str = "window_start", end: str = "window_end", bucket_hours: int = 1) -> DataFrame:
    """Rows inside closed windows (start <= ts <= end), once for each window; an hour bucket is the join key, so no nested loop."""
    width = bucket_hours * 3600
    hour = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    spread = windows.withColumn("_bucket", F.explode(F.sequence(hour(start), hour(end))))
    joined = rows.withColumn("_bucket", hour(ts)).join(small(spread), "_bucket")
    return joined.where(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points with start <= at <= end and equal keys; numeric times, bucketed by a width that most spans stay under."""
    cell = lambda c: F.floor(F.col(c) / bucket)
    spread = spans.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("_cell", cell(at)).join(spread, [*keys, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """left with the values of the latest right row at or before it, of equal keys (null if none).

    Both sides are sorted together by key and time once; the last value is carried
    forward, so the cost is one shuffle and no key's pairs are made.
    """
    carried = F.struct(F.col(right_ts).alias("_at"), *values)
    both = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_right"), *(F.lit(None).cast(right.schema[t].dataType).alias(f"_t{i}") for i, t in enumerate(tie)))
    other = right.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), carried.alias("_right"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)))
    order = Window.partitionBy(*keys).orderBy("_ts", "_side", *(f"_t{i}" for i in range(len(tie)))).rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other).withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return joined.select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values), F.col("_found._at").alias(f"{right_ts}_asof"))


def wildcard_join(rows: DataFrame, table: DataFrame, key: str, also: Sequence[str], values: Sequence[str], wildcard: str = "*") -> DataFrame:
    """Values of the row's own key, else of the wildcard key."""
    own = table.where(F.col(key) != wildcard).select(key, *also, F.struct(*values).alias("_own"))
    any_ = table.where(F.col(key) == wildcard).select(*also, F.struct(*values).alias("_any"))
    joined = rows.join(own, [key, *also], "left").join(small(any_), list(also), "left").withColumn("_use", F.coalesce("_own", "_any"))
    return joined.select(*rows.columns, *(F.col(f"_use.{v}").alias(v) for v in values))


def nearest_baseline(cases: DataFrame, baselines: DataFrame, case_key: str, case_ts: str, start: str, end: str, baseline_key: str) -> DataFrame:
    """For each case the latest baseline that ended by then, else the one whose middle is nearest; of equal ones the first by name.

    Three as-of joins of a row for each case and baseline: sorted once each, never paired.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    left = cases.withColumns({"_all": F.lit(0), "_at": 2 * micros(case_ts), "_back": -2 * micros(case_ts)})
    ends = baselines.groupBy((2 * micros(end)).alias("_end")).agg(F.min(baseline_key).alias("_ended")).withColumn("_all", F.lit(0))
    middles = baselines.groupBy((micros(start) + micros(end)).alias("_middle")).agg(F.min(baseline_key).alias("_name")).withColumn("_all", F.lit(0))
    found = asof_join(left, ends, ["_all"], "_at", "_end", ["_ended"])
    found = asof_join(found, middles.withColumnRenamed("_name", "_before"), ["_all"], "_at", "_middle", ["_before"]).withColumnRenamed("_middle_asof", "_m0")
    found = asof_join(found, middles.select("_all", F.col("_name").alias("_after"), (-F.col("_middle")).alias("_middle")), ["_all"], "_back", "_middle", ["_after"]).withColumnRenamed("_middle_asof", "_m1")
    gap0, gap1 = F.col("_at") - F.col("_m0"), -F.col("_m1") - F.col("_at")
    near = F.when(gap1.isNull() | (gap0 < gap1), F.col("_before")).when(gap0.isNull() | (gap1 < gap0), F.col("_after")).otherwise(F.least("_before", "_after"))
    return found.select(*cases.columns, F.coalesce("_ended", near).alias(baseline_key)).where(F.col(baseline_key).isNotNull()).join(baselines, baseline_key)


def exact_then_interval(events: DataFrame, spans: DataFrame, exact: Sequence[str], loose: Sequence[str], at: str, start: str, end: str, bucket: int) -> DataFrame:
    """(exact keys, at): events of a span by its exact keys; a span without any takes the events of its loose keys inside its interval."""
    by_key = events.join(spans.select(*exact), list(exact)).select(*exact, at)
    rest = spans.join(events.select(*exact).dropna().distinct(), list(exact), "left_anti")
    points = events.drop(*(c for c in exact if c not in loose))
    return by_key.unionByName(interval_join(points, rest, loose, at, start, end, bucket).select(*exact, at))


def full_scores(left: DataFrame, right: DataFrame, keys: Sequence[str], left_score: str, right_score: str) -> DataFrame:
    """Full outer join of two score tables; a missing score is 0."""
    joined = left.join(right, list(keys), "full_outer")
    return joined.select(*keys, F.coalesce(left_score, F.lit(0.0)).alias(left_score), F.coalesce(right_score, F.lit(0.0)).alias(right_score))


def window_ratio(rows: DataFrame, keys: Sequence[str], label: Column, value: str) -> DataFrame:
    """Means of the normal and the faulty rows of each key that has both, and their ratio (infinite for a zero base, 1 if both are zero)."""
    normal, fault = F.avg(F.when(~label, F.col(value))), F.avg(F.when(label, F.col(value)))
    both = rows.groupBy(*keys).agg(normal.alias("normal_mean"), fault.alias("fault_mean")).where("normal_mean is not null and fault_mean is not null")
    ratio = F.when(F.col("normal_mean") != 0, F.try_divide("fault_mean", "normal_mean")).when(F.col("fault_mean") == 0, 1.0).otherwise(float("inf"))
    return both.withColumns({"ratio": ratio, "delta": F.col("fault_mean") - F.col("normal_mean")})


def correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of pairs by key; 0 where a side does not vary."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return rows.groupBy(*keys).agg(F.coalesce(r, F.lit(0.0)).alias("corr"))
