"""Two-sample distances, permutation tests, spectrum scores and one-dimensional clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import small

MEASURES = ("tarantula", "jaccard", "ochiai", "ochiai2", "zoltar", "dstar2", "op2", "wong3", "kulczynski2", "failed_only")


def energy_distance(rows: DataFrame, keys: Sequence[str], value: str, fail: str, least: int = 5, flat: float = 1e-6) -> DataFrame:
    """sqrt(2 * integral of (F - G)^2) between the faulty and the normal values of each key.

    Equal values are summed before the sort, keys with few samples on a side or nearly
    constant on both are dropped; one shuffle by key serves all steps.
    """
    f = F.col(fail).cast("long")
    sides = rows.groupBy(*keys).agg(F.sum(f).alias("nf"), F.sum(1 - f).alias("np"), F.stddev_pop(F.when(f == 1, F.col(value))).alias("sf"), F.stddev_pop(F.when(f == 0, F.col(value))).alias("sp"))
    sides = sides.where((F.col("nf") >= least) & (F.col("np") >= least) & ~((F.col("sf") < flat) & (F.col("sp") < flat)))
    steps = rows.groupBy(*keys, value).agg(F.sum(f).alias("cf"), F.sum(1 - f).alias("cp"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(*keys, F.sum("cf").over(upto).alias("f"), F.sum("cp").over(upto).alias("p"), (F.lead(value).over(w) - F.col(value)).alias("gap")).where("gap is not null")
    term = F.pow(F.col("f") / F.col("nf") - F.col("p") / F.col("np"), F.lit(2)) * F.col("gap")
    return steps.join(sides, list(keys)).groupBy(*keys).agg(F.sqrt(2 * F.sum(term)).alias("epsilon"), F.first("nf").alias("n_fault"), F.first("np").alias("n_normal"))


def _energy(x: np.ndarray, y: np.ndarray) -> float:
    both = np.sort(np.concatenate([x, y]))
    gaps = np.diff(both)
    f = np.searchsorted(np.sort(x), both[:-1], "right") / len(x)
    g = np.searchsorted(np.sort(y), both[:-1], "right") / len(y)
    return float(np.sqrt(2 * np.sum((f - g) ** 2 * gaps)))


def permutation_test(rows: DataFrame, keys: Sequence[str], value: str, fail: str, permutations: int = 1000, least: int = 5, seed: int = 42) -> DataFrame:
    """epsilon and p = (1 + as extreme) / (1 + permutations); a key's generator is seeded by the key, so the result does not depend on the partitioning."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        values, side = pdf[value].to_numpy(float), pdf[fail].to_numpy(bool)
        n = int(side.sum())
        if n < least or len(side) - n < least:
            return pd.DataFrame(columns=[*keys, "epsilon", "p_value", "n_fault", "n_normal"])
        order = np.argsort(values, kind="stable")
        ranked, is_fault = values[order], side[order]
        gaps = np.diff(ranked)
        m = len(side) - n

        def distances(sides: np.ndarray) -> np.ndarray:
            f = np.cumsum(sides, 1)[:, :-1] / n
            g = np.cumsum(~sides, 1)[:, :-1] / m
            return np.sqrt(2 * ((f - g) ** 2 @ gaps))

        mine = float(distances(is_fault[None])[0])
        rng = np.random.default_rng([seed, *np.frombuffer("|".join(str(pdf[k].iloc[0]) for k in keys).encode(), np.uint8).tolist()])
        extreme = 0
        for k in range(0, permutations, 100):
            count = min(100, permutations - k)
            extreme += int((distances(rng.permuted(np.tile(is_fault, (count, 1)), axis=1)) >= mine).sum())
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([head | {"epsilon": mine, "p_value": (extreme + 1) / (permutations + 1), "n_fault": n, "n_normal": m}])

    return rows.select(*keys, value, fail).groupBy(*keys).applyInPandas(test, f"{kinds}, epsilon double, p_value double, n_fault long, n_normal long")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def spectrum(coverage: DataFrame, runs: DataFrame, item: str, run: str = "run_id", label: str = "label") -> DataFrame:
    """Counts (ef, ep, nf, np) of each item over failing and passing runs, and ten suspiciousness measures.  coverage: distinct (run, item)."""
    total = runs.agg(F.count_if(F.col(label) == "fail").alias("all_f"), F.count_if(F.col(label) == "pass").alias("all_p"))
    seen = coverage.join(small(runs.select(run, label)), run).groupBy(item).agg(F.count_if(F.col(label) == "fail").alias("ef"), F.count_if(F.col(label) == "pass").alias("ep"))
    counts = seen.join(F.broadcast(total)).withColumns({"nf": F.col("all_f") - F.col("ef"), "np": F.col("all_p") - F.col("ep")})
    ef, ep, nf, np_ = (F.col(c).cast("double") for c in ("ef", "ep", "nf", "np"))
    fails, passes = ef + nf, ep + np_
    rate_f, rate_p = _ratio(ef, fails), _ratio(ep, passes)
    penalty = F.when(ep <= 2, ep).when(ep <= 10, 2 + 0.1 * (ep - 2)).otherwise(2.8 + 0.01 * (ep - 10))
    return counts.select(
        item, "ef", "ep", "nf", "np",
        _ratio(rate_f, rate_f + rate_p).alias("tarantula"), _ratio(ef, ef + ep + nf).alias("jaccard"), _ratio(ef, F.sqrt((ef + ep) * (ef + nf))).alias("ochiai"),
        _ratio(ef * np_, F.sqrt((ef + ep) * (nf + np_) * (ef + np_) * (nf + ep))).alias("ochiai2"),
        F.when(ef == 0, 0.0).otherwise(_ratio(ef, ef + ep + nf + _ratio(10000 * nf * ep, ef))).alias("zoltar"),
        _ratio(ef * ef, ep + nf).alias("dstar2"), (ef - ep / (np_ + 1)).alias("op2"), (ef - penalty).alias("wong3"),
        (0.5 * (_ratio(ef, fails) + _ratio(ef, ef + ep))).alias("kulczynski2"), F.when(ep == 0, ef).otherwise(0.0).alias("failed_only"),
    )


def consensus(scores: DataFrame, item: str, measures: Sequence[str] = MEASURES, digits: int = 9) -> DataFrame:
    """Mean over the measures of the normalized average rank of each item; scores that agree to so many digits are ties.

    Equal scores are counted before they are ranked: a measure has at most as many
    distinct scores as there are pairs of counts of runs, however many items there are.
    """
    long = scores.select(item, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(m, digits).alias("score")) for m in measures))).alias("x")).select(item, "x.*")
    ties = long.groupBy("measure", "score").agg(F.count("*").alias("tied"))
    above = Window.partitionBy("measure").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("tied").over(Window.partitionBy("measure"))
    rank = F.coalesce(F.sum("tied").over(above), F.lit(0)) + (F.col("tied") + 1) / 2.0
    ranks = ties.select("measure", "score", F.when(n <= 1, 1.0).otherwise(1 - (rank - 1) / (n - 1)).alias("r"))
    return long.join(ranks, ["measure", "score"]).groupBy(item).agg(F.avg("r").alias("consensus"))


def gap_clusters(rows: DataFrame, key: str, item: str, score: str, threshold: str) -> DataFrame:
    """Greedy clusters of descending scores: a new one starts when the cluster's greatest score exceeds an item's by more than the threshold.  An ordered fold of each key's items."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("n"), F.col(item).alias("item"))))
    folded = rows.groupBy(key).agg(items.alias("items"), F.first(threshold).alias("limit"))
    kind = f"array<struct<item:{rows.schema[item].dataType.simpleString()},score:double,cluster:int>>"
    zero = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("cluster"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        value = -x["n"]
        new = acc["top"].isNull() | (acc["top"] - value > F.col("limit"))
        cluster = acc["cluster"] + F.when(new, 1).otherwise(0)
        row = F.array(F.struct(x["item"].alias("item"), value.alias("score"), cluster.alias("cluster")))
        return F.struct(F.when(new, value).otherwise(acc["top"]).alias("top"), cluster.alias("cluster"), F.concat(acc["out"], row).alias("out"))

    return folded.select(key, F.explode(F.aggregate("items", zero, step)["out"]).alias("x")).select(key, F.col("x.item").alias(item), F.col("x.score").alias(score), "x.cluster")


def linkage_1d(scores: np.ndarray, cut: float) -> np.ndarray:
    """Complete linkage of points on a line, cut at a diameter; cluster numbers by descending mean.

    On a line the closest pair of clusters is always adjacent, so merging adjacent runs of
    the sorted points by least diameter is the same as the general algorithm.
    """
    order = np.argsort(-scores, kind="stable")
    runs = [[i] for i in order]
    while len(runs) > 1:
        spread = [scores[a[0]] - scores[b[-1]] for a, b in zip(runs, runs[1:])]
        k = int(np.argmin(spread))
        if spread[k] > cut:
            break
        runs[k : k + 2] = [runs[k] + runs[k + 1]]
    out = np.empty(len(scores), np.int64)
    for number, run in enumerate(runs, 1):
        out[run] = number
    return out


def score_clusters(rows: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """Complete-linkage clusters of each key's distinct scores, cut at the population deviation of all its scores; without deviation equal scores cluster."""
    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{item}` {rows.schema[item].dataType.simpleString()}, `{score}` double, cluster long"

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[score].to_numpy(float)
        distinct, back = np.unique(values, return_inverse=True)
        sigma = float(np.std(values))
        number = linkage_1d(distinct, sigma) if sigma > 0 else np.arange(len(distinct), 0, -1)
        return pdf[[key, item, score]].assign(cluster=number[back])

    return rows.select(key, item, F.col(score).cast("double").alias(score)).groupBy(key).applyInPandas(cluster, kinds)
