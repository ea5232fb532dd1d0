"""Spans, call paths, service vectors, event graphs and pattern support."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import small
from .series import running_total


def service_edges(spans: DataFrame, duration: str = "duration_us") -> DataFrame:
    """Calls between different services: each span with its parent's service, once for each (trace, source, destination, start)."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("source"))
    joined = spans.join(parent, ["trace_id", "parent_span_id"]).where(F.col("source") != F.col("service"))
    rows = joined.select("trace_id", "source", F.col("service").alias("destination"), "start_us", (F.col(duration) / 1000).alias("response_time"), "span_id")
    return rows.groupBy("trace_id", "source", "destination", "start_us").agg(F.min_by("response_time", "span_id").alias("response_time"))


def whole_traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole traces from batches sorted by trace (column 0)."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column(0)[-1]
        cut = pc.index(batch.column(0), last).as_py()  # first row of the batch's last trace
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif rest and rest[-1].column(0)[-1].as_py() != last.as_py():
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def parents(trace: np.ndarray, span: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Row of each span's parent in its trace, or -1; of repeated spans the first counts.  A cycle is cut where a walk up from its first row closes."""
    here = pd.MultiIndex.from_arrays([trace, span])
    first = ~here.duplicated()
    rows = np.flatnonzero(first)
    at = here[first].get_indexer(pd.MultiIndex.from_arrays([trace, parent]))
    up = np.where((at >= 0) & ~pd.isna(parent), rows[at], -1)
    far, steps = up.copy(), 1
    while steps <= len(up) and (far >= 0).any():  # after as many steps as rows only spans that lead into a cycle are left
        far = np.where(far >= 0, far[far], -1)
        steps *= 2
    inside = set(far[far >= 0].tolist())  # all on cycles
    while inside:
        start = i = inside.pop()
        cycle = [i]
        while up[i] != start:
            i = up[i]
            cycle.append(int(i))
        inside -= set(cycle)
        first = min(cycle)
        up[next(k for k in cycle if up[k] == first)] = -1
    return up


def along(up: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values from each row up to its root, by pointer doubling."""
    total, far = values.astype(np.int64), up.copy()
    while (far >= 0).any():
        total = total + np.where(far >= 0, total[far], 0)
        far = np.where(far >= 0, far[far], -1)
    return total


def call_paths(spans: DataFrame, more: Sequence[str] = ("duration_us",)) -> DataFrame:
    """Each span with its services from the root down, runs of one service collapsed, and its depth in spans.  A chain ends at a missing parent; a cycle ends where a walk up from its first span closes; spans without a trace are left out."""
    names = ["trace_id", "span_id", "service", *more]
    kinds = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_traces(batches):
            trace, span, parent, service = (table.column(c).to_pandas().to_numpy() for c in ("trace_id", "span_id", "parent_span_id", "service"))
            up = parents(trace, span, parent)
            known, code = np.unique(service.astype(str), return_inverse=True)
            new = (up < 0) | (code != code[up])
            length = along(up, new)
            near = np.where(new, np.arange(len(up)), -1)  # nearest span above, or itself, where the service changes
            far = up.copy()
            while (near < 0).any():
                near = np.where(near < 0, near[far], near)
                far = np.where(far >= 0, far[far], -1)
            ends = np.cumsum(length)
            out = np.empty(int(ends[-1]), np.int64)
            rows, at = np.arange(len(up)), near.copy()
            place = ends - 1
            while len(rows):
                out[place] = code[at]
                above = up[at]
                rows, place, at = rows[above >= 0], place[above >= 0] - 1, near[above[above >= 0]]
            path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(known.tolist(), pa.string()).take(pa.array(out)))
            depth = along(up, np.ones(len(up), np.int64))
            yield from pa.table({**{c: table.column(c) for c in names}, "path": path, "depth": pa.array(depth)}).to_batches()

    rows = spans.select("trace_id", "span_id", "parent_span_id", "service", *more).where("trace_id is not null").repartition("trace_id").sortWithinPartitions("trace_id", "span_id")
    return rows.mapInArrow(walk, f"{kinds}, path array<string>, depth long")


def ancestors(spans: DataFrame) -> DataFrame:
    """Number of spans from the root to each span, of any depth."""
    return call_paths(spans, ()).select("trace_id", "span_id", "depth")


def path_vocabulary(paths: DataFrame) -> DataFrame:
    """Distinct (service, path) with a number in order of the path's text."""
    distinct = paths.select("service", F.array_join("path", ">").alias("path_key")).distinct()
    sizes = distinct.groupBy("service").agg(F.count("*").alias("n"))  # one row a service, so a window over all of them is small
    before = F.coalesce(F.sum("n").over(Window.orderBy("service").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("service").orderBy("path_key")))
    joined = numbered.join(small(sizes.select("service", before.alias("_before"))), "service")
    return joined.select("service", "path_key", (F.col("_before") + F.col("_n") - 1).cast("long").alias("dim"))


def trace_vectors(paths: DataFrame, vocabulary: DataFrame, duration: str = "duration_us") -> DataFrame:
    """Sparse vectors: greatest duration of each (trace, dimension); dim is null for unseen paths."""
    keyed = paths.withColumn("path_key", F.array_join("path", ">"))
    joined = keyed.join(vocabulary, ["service", "path_key"], "left")
    return joined.groupBy("trace_id", "service", "path_key", "dim").agg(F.max(duration).alias("duration"))


def mask_keys(vectors: DataFrame) -> DataFrame:
    """Traces with equal sets of dimensions share a key."""
    dims = F.array_sort(F.collect_set("dim"))
    return vectors.where("dim is not null").groupBy("trace_id").agg(dims.alias("dims")).withColumn("mask", F.sha2(F.array_join(F.col("dims").cast("array<string>"), ","), 256))


def dimension_stats(vectors: DataFrame, least: float = 1e-5) -> DataFrame:
    """Mean and population deviation (one at least) of the present values of each dimension."""
    v = F.when(F.col("duration") > least, F.col("duration").cast("double"))
    return vectors.where("dim is not null").groupBy("dim").agg(F.avg(v).alias("mean"), F.greatest(F.lit(1.0), F.coalesce(F.stddev_pop(v), F.lit(0.0))).alias("sigma"))


def trace_scores(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean log-likelihood under independent normal dimensions, and the number of unseen paths."""
    z = (F.col("duration") - F.col("mean")) / F.col("sigma")
    like = -0.5 * (z * z + F.log(2 * F.pi() * F.col("sigma") * F.col("sigma")))
    return vectors.join(small(stats), "dim", "left").groupBy("trace_id").agg(F.avg(like).alias("score"), F.count_if(F.col("dim").isNull()).alias("unseen_path_count"), F.count("dim").alias("known_dim_count"))


def flag_traces(scores: DataFrame, reference: DataFrame, quantile: float = 0.0) -> DataFrame:
    """Anomalous if a path is unseen or the score is below the reference's quantile (default its minimum)."""
    limit = reference.agg(F.percentile("score", F.lit(quantile)).alias("_limit"))
    flagged = scores.join(F.broadcast(limit))
    return flagged.withColumn("is_anomalous", (F.col("unseen_path_count") > 0) | (F.col("score") < F.col("_limit"))).drop("_limit")


def left_tail(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of reference scores at or below each score, by a running count over both."""
    both = scores.select("trace_id", "score", F.lit(0).alias("ref")).unionByName(reference.select("trace_id", "score", F.lit(1).alias("ref")))
    steps = running_total(both.groupBy("score").agg(F.sum("ref").alias("n")), "score", "n", "_upto")
    total = reference.agg(F.count("*").alias("_all"))
    shares = steps.join(F.broadcast(total)).select("score", (F.col("_upto") / F.col("_all")).alias("p_value"))
    return scores.join(shares, "score")


def three_sigma(vectors: DataFrame, reference: DataFrame, limit: float = 3.0) -> DataFrame:
    """The most suspicious dimension of each trace: outside mean +- limit * sigma, the longest path first, then the greatest |z|."""
    sigma = F.when(F.col("sigma") <= 1e-8, 1.0).otherwise(F.col("sigma"))
    z = F.abs(F.col("duration") - F.col("mean")) / sigma
    out = vectors.join(small(reference), "dim").withColumn("z", z).where(F.col("z") > limit)
    order = Window.partitionBy("trace_id").orderBy(F.desc(F.size(F.split("path_key", ">"))), F.desc("z"), "service", "path_key")
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prefixes(rows: DataFrame, path: str) -> DataFrame:
    """Each row with every prefix of its path and the prefix's length."""
    parts = F.split(path, ">")
    return rows.withColumn("prefix", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("_head", F.array_join(F.slice(parts, F.lit(1), F.col("prefix")), ">"))


def longest_common_path(unseen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For each unseen path the known path that shares its longest prefix (of several the first by name), if one has its root.

    Prefixes meet in an equi-join, so no two paths are compared: each distinct prefix
    keeps its first known path, and each distinct unseen path its longest known prefix.
    """
    first = prefixes(vocabulary.select(F.col("path_key").alias("known_path")), "known_path").groupBy("_head").agg(F.min("known_path").alias("known_path"))
    own = prefixes(unseen.select("path_key").distinct(), "path_key").join(first, "_head")
    best = own.groupBy("path_key").agg(F.max("prefix").cast("long").alias("prefix"), F.max_by("known_path", "prefix").alias("known_path"))
    return unseen.join(best, "path_key")


def event_pairs(events: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Consecutive events of a span."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumns({"next_label": F.lead("label").over(w), "next_weight": F.lead("weight").over(w)}).where("next_label is not null")


def pattern_support(pairs: DataFrame) -> DataFrame:
    """Sum over edges of the lesser weight."""
    return pairs.groupBy("label", "next_label").agg(F.sum(F.least("weight", "next_weight")).alias("support"))


def parent_event(children: DataFrame, events: DataFrame) -> DataFrame:
    """For a child span of the same pod the parent's last event at or before its start, if the parent has a later one, else the parent's first event."""
    joined = children.join(events, ["trace_id", "parent_span_id"])
    before, after = F.col("event_us") <= F.col("start_us"), F.max("event_us") > F.max("start_us")
    last = F.max_by(F.when(before, F.col("label")), F.when(before, F.col("pos")))
    return joined.groupBy("trace_id", "span_id").agg(F.when(after, F.coalesce(last, F.min_by("label", "pos"))).otherwise(F.min_by("label", "pos")).alias("parent_label"))


def pattern_scores(normal: DataFrame, faulty: DataFrame) -> DataFrame:
    """Supports of both sides (0 where missing) with the abnormal and the expected share."""
    keys = ["label", "next_label"]
    both = normal.withColumnRenamed("support", "n").join(faulty.withColumnRenamed("support", "a"), keys, "full_outer").select(*keys, F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("a", F.lit(0.0)).alias("a"))
    return both.withColumns({"abnormal": F.coalesce(F.try_divide(F.col("a"), F.col("a") + F.col("n")), F.lit(0.0)), "expected": F.coalesce(F.try_divide(F.col("n"), F.col("a") + F.col("n")), F.lit(0.0))})


def without_children(patterns: DataFrame, score: str) -> DataFrame:
    """Patterns whose first label is not the last label of another pattern with at least their score."""
    other = patterns.select(F.col("next_label").alias("label"), F.col(score).alias("_score"), F.struct("label", "next_label").alias("_key"))
    better = patterns.join(other, "label").where((F.col(score) <= F.col("_score")) & (F.struct("label", "next_label") != F.col("_key"))).select("label", "next_label").distinct()
    return patterns.join(better, ["label", "next_label"], "left_anti")


def service_credit(patterns: DataFrame, score: str) -> DataFrame:
    """A pattern's score, shared evenly by its services; the service of a label is its first word."""
    services = F.array_distinct(F.transform(F.array("label", "next_label"), lambda x: F.split_part(x, F.lit(" "), F.lit(1))))
    rows = patterns.withColumn("_s", services).select(F.explode("_s").alias("service"), (F.col(score) / F.size("_s")).alias("part"))
    return rows.groupBy("service").agg(F.sum("part").alias("score"), F.count("*").alias("pattern_count"))
