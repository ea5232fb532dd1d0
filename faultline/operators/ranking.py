"""Top-k, candidate selection, rank fusion, hit evaluation and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RANKINGS = {
    "count_then_sum": ("candidate_metric_count", "epsilon_sum"), "epsilon_sum": ("epsilon_sum", "candidate_metric_count"),
    "mean_epsilon": ("mean_epsilon", "epsilon_sum"), "max_epsilon": ("max_epsilon", "epsilon_sum"),
}


def ranked(rows: DataFrame, keys: Sequence[str], *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top(rows: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    return ranked(rows, keys, *order).where(F.col("rank") <= k)


def candidate_table(results: DataFrame, keys: Sequence[str], by: str, epsilon: str = "epsilon", p_value: str | None = "p_value", alpha: float = 0.05) -> DataFrame:
    """Count, sum, mean and maximum of epsilon by service or pod, over the significant indicators, or over all where none is."""
    rows = results
    if p_value:
        some = F.max(F.when(F.col(p_value) < alpha, 1).otherwise(0)).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_some", some).where((F.col(p_value) < alpha) | (F.col("_some") == 0))
    return rows.groupBy(*keys, by).agg(F.count("*").alias("candidate_metric_count"), F.sum(epsilon).alias("epsilon_sum"), F.avg(epsilon).alias("mean_epsilon"), F.max(epsilon).alias("max_epsilon"))


def rank_candidates(table: DataFrame, keys: Sequence[str], by: str, mode: str = "max_epsilon") -> DataFrame:
    return ranked(table, keys, *(F.desc(c) for c in RANKINGS[mode]), F.asc(by))


def select_candidates(scores: DataFrame, keys: Sequence[str], by: str, score: str, share: float = 0.8, least: int = 5, forced: Sequence[str] = ()) -> DataFrame:
    """Those at or above the quantile, at least so many, and the forced ones."""
    limit = F.percentile(score, F.lit(share)).over(Window.partitionBy(*keys))
    rows = ranked(scores.withColumn("_limit", limit), keys, F.desc(score), F.asc(by))
    return rows.where((F.col(score) >= F.col("_limit")) | (F.col("rank") <= least) | F.col(by).isin(*forced) if forced else (F.col(score) >= F.col("_limit")) | (F.col("rank") <= least)).drop("_limit")


def fuse(rankings: DataFrame, keys: Sequence[str], by: str, rank: str = "rank", score: str = "score", weight: Column | None = None, k: int = 60) -> DataFrame:
    """Three fusions of several rankings (column source): reciprocal ranks, mean rank (a missing one counts as last + 1) and mean of scores divided by the source's greatest."""
    weight = F.lit(1.0) if weight is None else weight
    source = Window.partitionBy(*keys, "source")
    rows = rankings.withColumns({"_n": F.max(rank).over(source), "_top": F.max(score).over(source), "_w": weight})
    sources = rows.groupBy(*keys).agg(F.countDistinct("source").alias("_sources"))
    absent = rows.select(*keys, "source", "_n").distinct().groupBy(*keys).agg(F.sum(F.col("_n") + 1).alias("_all_last"))
    got = rows.groupBy(*keys, by).agg(F.sum(F.col("_w") / (k + F.col(rank))).alias("rrf"), F.sum(rank).alias("_ranks"), F.sum(F.col("_n") + 1).alias("_lasts"), F.sum(F.coalesce(F.try_divide(score, "_top"), F.lit(0.0))).alias("_scores"))
    joined = got.join(sources.join(absent, list(keys)), list(keys)) if keys else got.join(F.broadcast(sources.join(absent)))
    return joined.select(*keys, by, "rrf", ((F.col("_ranks") + F.col("_all_last") - F.col("_lasts")) / F.col("_sources")).alias("avg_rank"), (F.col("_scores") / F.col("_sources")).alias("avg_score"))


def hits(ranking: DataFrame, truth: DataFrame, keys: Sequence[str], by: str, target: str, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Whether each case's target is within the first k; a case without ranking misses."""
    own = F.col(by) == F.col(target)
    joined = truth.join(ranking, list(keys), "left")
    return joined.groupBy(*keys, target).agg(*(F.max(F.when(own & (F.col("rank") <= k), 1).otherwise(0)).cast("long").alias(f"top{k}") for k in ks))


def accuracy(hit_rows: DataFrame, day: str, status: str | None = None, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Cases and mean hits by day and overall (day null), in one pass."""
    ok = F.count_if(F.col(status) == "ok") if status else F.count("*")
    return hit_rows.rollup(day).agg(F.count("*").alias("n_total"), ok.alias("n_ok"), *(F.avg(F.col(f"top{k}").cast("double")).alias(f"top{k}_accuracy") for k in ks))


def fill_from_paths(rows: DataFrame, ranked_col: str, path: str, k: int = 5) -> DataFrame:
    """Ranked services, then the ancestors on the path from the leaf up, without repeats, up to k."""
    return rows.withColumn("filled", F.slice(F.array_distinct(F.concat(ranked_col, F.reverse(path))), 1, k))


def known_in_order(ranking: DataFrame, known: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Only known services, each once at its best rank."""
    first = ranking.where(F.trim(by) != "").join(known.select(by).distinct(), by, "left_semi")
    return first.groupBy(*keys, by).agg(F.min("rank").alias("rank"))


def best_config(summary: DataFrame, weights: dict[str, float], tie: str) -> DataFrame:
    """The configuration of greatest weighted accuracy; run time has no say, so the choice does not depend on the machine."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return summary.withColumn("selection_score", score).orderBy(F.desc("selection_score"), tie).limit(1)
