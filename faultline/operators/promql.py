"""Time-series expressions over long series (labels, ts, value): the vector operators that monitoring queries are made of.

``rate`` and ``increase`` sum the counter's steps inside the window (a step down counts as
a reset to zero) and do not extrapolate to the window's ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import small


def micros_of(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _range(labels: Sequence[str], window_s: float):
    return Window.partitionBy(*labels).orderBy("_t").rangeBetween(-round(window_s * 1_000_000), 0)


def increase(rows: DataFrame, labels: Sequence[str], window_s: float, ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Counter growth over the steps whose later sample is in [t - window, t]."""
    order = Window.partitionBy(*labels).orderBy("_t", tie)
    before = F.lag(value).over(order)
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    timed = rows.withColumn("_t", micros_of(ts)).withColumn("_step", step)
    return timed.withColumn("increase", F.sum("_step").over(_range(labels, window_s))).drop("_t", "_step")


def rate(rows: DataFrame, labels: Sequence[str], window_s: float, ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    return increase(rows, labels, window_s, ts, value, tie).withColumn("rate", F.col("increase") / window_s).drop("increase")


def avg_over_time(rows: DataFrame, labels: Sequence[str], window_s: float, ts: str = "ts", value: str = "value") -> DataFrame:
    timed = rows.withColumn("_t", micros_of(ts))
    return timed.withColumn("avg_over_time", F.avg(value).over(_range(labels, window_s))).drop("_t")


def aggregate_by(rows: DataFrame, by: Sequence[str], value: str = "value", how: str = "sum") -> DataFrame:
    """sum by, max by, min by, avg by and count by."""
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[how]
    return rows.groupBy(*by).agg(agg(value).alias("value"))


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float, le: str = "le", count: str = "value") -> DataFrame:
    """Linear interpolation inside the first bucket that reaches the rank; counts are cumulative, an infinite last bucket gives the bound below it."""
    w = Window.partitionBy(*keys).orderBy(le)
    every = Window.partitionBy(*keys)
    rows = buckets.select(*keys, le, F.col(count).alias("c"), F.lag(le, 1, 0.0).over(w).alias("low"), F.lag(count, 1, 0.0).over(w).alias("below"), (F.lit(q) * F.max(count).over(every)).alias("rank"))
    reached = rows.where((F.col("c") >= F.col("rank")) & (F.col("rank") > 0))
    first = reached.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(le))).where("_n = 1")
    inside = F.col("low") + (F.col(le) - F.col("low")) * F.coalesce(F.try_divide(F.col("rank") - F.col("below"), F.col("c") - F.col("below")), F.lit(0.0))
    return first.select(*keys, F.when(F.col(le) == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def vector_or(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """left, and the rows of right whose label set left does not have."""
    return left.unionByName(right.join(left.select(*labels).distinct(), list(labels), "left_anti"))


def first_candidate(candidates: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of several expressions for the same thing, each key takes the whole result of the first that has any rows for it."""
    tagged = candidates[0].withColumn("prio", F.lit(0))
    for k, more in enumerate(candidates[1:], 1):
        tagged = tagged.unionByName(more.withColumn("prio", F.lit(k)))
    best = F.min("prio").over(Window.partitionBy(*keys))
    return tagged.withColumn("_best", best).where("prio = _best").drop("_best")


def arithmetic(left: DataFrame, right: DataFrame, labels: Sequence[str], op: str, floor: float | None = None) -> DataFrame:
    """left op right on equal labels; floor: least value of the right side (clamp_min).  x / 0 is null."""
    l, r = F.col("l.value"), F.col("r.value")
    r = F.greatest(r, F.lit(floor)) if floor is not None else r
    value = {"/": F.try_divide(l, r), "*": l * r, "+": l + r, "-": l - r}[op]
    condition = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in labels]
    return left.alias("l").join(right.alias("r"), condition).select(*(F.col(f"l.{c}") for c in labels), value.alias("value"))


def group_left(many: DataFrame, one: DataFrame, on: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """many * on(labels) group_left(carry) one."""
    factor = one.select(*on, *carry, F.col("value").alias("_factor"))
    return many.join(factor, list(on)).withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def label_replace(rows: DataFrame, target: str, source: str, pattern: str, replacement: str = "$1") -> DataFrame:
    """Where the whole source label matches, the target label is the replacement; elsewhere it stays (empty if new)."""
    whole = f"^(?:{pattern})$"
    old = F.col(target) if target in rows.columns else F.lit("")
    return rows.withColumn(target, F.when(F.col(source).rlike(whole), F.regexp_replace(source, whole, replacement)).otherwise(old))


def matches(label: Column, op: str, value: str) -> Column:
    """Label matchers; regular expressions match the whole label."""
    return {"=": label == value, "!=": label != value, "=~": label.rlike(f"^(?:{value})$"), "!~": ~label.rlike(f"^(?:{value})$")}[op]


def expanded(catalogue: DataFrame, pods: DataFrame, expr: str = "expr", mark: str = "{pod_regex}") -> DataFrame:
    """Queries of a template catalogue (set, name, expr, for example from a CSV file) for pods (set, pod): the pods of a set, as an anchored alternative of escaped names, take the mark's place."""
    escaped = F.regexp_replace("pod", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    of_set = pods.groupBy("set").agg(F.array_join(F.array_sort(F.collect_set(escaped)), "|").alias("_pods"))
    joined = catalogue.join(small(of_set), "set")
    return joined.select("set", "name", F.replace(F.col(expr), F.lit(mark), F.concat(F.lit("^(?:"), F.col("_pods"), F.lit(")$"))).alias("query"))


def matching(samples: DataFrame, queries: DataFrame, pod: str = "pod", name: str = "metric") -> DataFrame:
    """Samples that a query of the metric's name selects; queries: (set, name, regex of pods)."""
    joined = samples.join(small(queries.withColumnRenamed("name", name)), name)
    return joined.where(F.regexp(F.col(pod), F.col("regex"))).drop("regex")
