"""Buckets, grids, gap filling, baselines and rolling statistics over long series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import small


def bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the bucket, in seconds since 1970."""
    return (F.floor(F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / seconds) * seconds).cast("long")


def grid(bounds: DataFrame, keys: DataFrame, seconds: int, first: str = "first", last: str = "last") -> DataFrame:
    """Every bucket of every key; bounds: (on columns, first, last) in seconds, joined to keys on their shared columns."""
    shared = [c for c in bounds.columns if c in keys.columns]
    return keys.join(small(bounds), shared).withColumn("bucket", F.explode(F.sequence(F.col(first), F.col(last), F.lit(seconds).cast("long")))).drop(first, last)


def bucketed(rows: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int, how: str = "median") -> DataFrame:
    """One value of each key and bucket."""
    agg = {"median": F.median, "mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return rows.groupBy(*keys, bucket(ts, seconds).alias("bucket")).agg(agg(value).alias("value"))


def on_grid(values: DataFrame, full: DataFrame, keys: Sequence[str], fill: float | None = None) -> DataFrame:
    """values on every grid cell; gaps are null or the fill."""
    out = full.join(values, [*keys, "bucket"], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def filled(rows: DataFrame, keys: Sequence[str], order: str = "bucket", value: str = "value") -> DataFrame:
    """Gaps take the value before, leading gaps the value after; keys without any value become 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(before, after, F.lit(0.0)))


def rolling_mean(rows: DataFrame, keys: Sequence[str], size: int = 12, order: str = "bucket", value: str = "value") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return rows.withColumn("rolling", F.avg(value).over(w))


def class_aggregate(rows: DataFrame, keys: Sequence[str], metric: str, value: str, summed: Sequence[str], peaked: Sequence[str]) -> DataFrame:
    """Sum, maximum or mean of a metric by its class, in one pass."""
    m = F.col(metric)
    how = F.when(m.isin(*summed), F.sum(value)).when(m.isin(*peaked), F.max(value)).otherwise(F.avg(value))
    return rows.groupBy(*keys, metric).agg(how.alias("value"))


def baseline(rows: DataFrame, keys: Sequence[str], value: str = "value", floor_share: float = 0.2) -> DataFrame:
    """Mean and sample deviation of each key; the deviation is at least the given quantile of the positive ones."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"))
    least = stats.where("sigma > 0").agg(F.percentile("sigma", F.lit(floor_share)).alias("least"))
    return stats.join(F.broadcast(least)).withColumn("sigma", F.greatest("sigma", "least")).drop("least")


def indicator_stats(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Population deviation, distinct values and whether a series is constant."""
    return rows.groupBy(*keys).agg(F.stddev_pop(value).alias("std"), F.countDistinct(value).alias("nunique")).withColumn("is_constant", F.col("nunique") <= 1)


def two_level_baseline(rows: DataFrame, key: str, metric: str, value: str = "value", wildcard: str = "*") -> DataFrame:
    """Mean and sample deviation by (key, metric) and by metric alone, which gets the wildcard key."""
    out = rows.groupingSets([[F.col(key), F.col(metric)], [F.col(metric)]], F.col(key), F.col(metric)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"), F.grouping(key).alias("_all"))
    return out.withColumn(key, F.when(F.col("_all") == 1, wildcard).otherwise(F.col(key))).drop("_all")


def alarm_scores(faulty: DataFrame, base: DataFrame, keys: Sequence[str], value: str = "value", share: float = 0.95) -> DataFrame:
    """Quantile over time of |z| against the baseline."""
    z = F.abs(F.try_divide(F.col(value) - F.col("mean"), F.col("sigma")))
    return faulty.join(base, list(keys)).groupBy(*keys).agg(F.percentile(z, F.lit(share)).alias("alarm"))


def beyond(rows: DataFrame, base: DataFrame, keys: Sequence[str], value: str = "value", limit: float = 3.0) -> DataFrame:
    """Rows further than limit deviations from the mean; keys whose deviation is null or (nearly) 0 give none."""
    z = F.abs(F.col(value) - F.col("mean")) / F.col("sigma")
    return rows.join(base.where("sigma > 1e-8"), list(keys)).withColumn("z", z).where(F.col("z") > limit)


def rank_average(rows: DataFrame, keys: Sequence[str], score: str, name: str = "rank") -> DataFrame:
    """Descending rank; ties share the mean of their ranks."""
    w, tied = Window.partitionBy(*keys).orderBy(F.desc(score)), Window.partitionBy(*keys, score)
    return rows.withColumn(name, F.rank().over(w) + (F.count("*").over(tied) - 1) / 2.0)


def rank_score(rows: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """1 for the best average rank, 0 for the worst."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rank_average(rows, keys, score, "_rank")
    return ranked.withColumn("rank_score", F.when(n <= 1, 1.0).otherwise(1 - (F.col("_rank") - 1) / (n - 1))).drop("_rank")


def running_total(rows: DataFrame, order: str, value: str, name: str, parts: int = 256) -> DataFrame:
    """rows with the sum of the values up to each row in the order of a number, equal numbers together.

    Quantiles of the order cut the rows into parts of about equal size; totals run inside
    the parts, and the parts' own totals (a row each) are added, so no task sorts all rows.
    """
    cuts = [float(x) for x in rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 4 * parts)).first()[0] or []]
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda x: x < F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_part", below)
    inside = dealt.withColumn(name, F.sum(value).over(Window.partitionBy("_part").orderBy(order)))
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
