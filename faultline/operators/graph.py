"""Service graphs: PageRank, causal skeleton, random walk, BIRCH test.  A case has a few dozen services, so one grouped call per case."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _kind(df: DataFrame, c: str) -> str:
    return f"`{c}` {df.schema[c].dataType.simpleString()}"


def call_graph(edges: DataFrame, case: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Distinct edges between (allowed) different services."""
    rows = edges.where("src <> dst")
    rows = rows.where(F.col("src").isin(*allowed) & F.col("dst").isin(*allowed)) if allowed else rows
    return rows.select(case, "src", "dst").distinct()


def edge_weights(edges: DataFrame, anomalous: str, corr: str, alpha: float = 0.55) -> DataFrame:
    """alpha on anomalous edges, else the positive part of the correlation; three decimals."""
    return edges.withColumn("weight", F.round(F.when(F.col(anomalous), F.lit(alpha)).otherwise(F.greatest(F.lit(0.0), F.col(corr))), 3))


def personalization(edges: DataFrame, corr: DataFrame, case: str, least: float = 0.01) -> DataFrame:
    """Mean weight of a service's edges times its greatest |correlation| with a resource, by its degree."""
    ends = edges.select(case, F.explode(F.array("src", "dst")).alias("node"), "weight")
    stats = ends.groupBy(case, "node").agg(F.avg("weight").alias("mean_weight"), F.count("*").alias("degree"))
    best = corr.groupBy(case, "node").agg(F.max(F.abs("corr")).alias("best"))
    joined = stats.join(best, [case, "node"], "left")
    return joined.select(case, "node", (F.col("mean_weight") * F.greatest(F.lit(least), F.coalesce("best", F.lit(0.0))) / F.col("degree")).alias("personal"))


def page_rank(matrix: np.ndarray, restart: np.ndarray, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-12) -> np.ndarray:
    """Personalized PageRank by power iteration; a node without outgoing weight sends its rank to the restart vector."""
    n = len(restart)
    restart = restart / restart.sum() if restart.sum() > 0 else np.full(n, 1 / n)
    out = matrix.sum(1)
    step = np.divide(matrix, out[:, None], out=np.zeros_like(matrix), where=out[:, None] > 0)
    rank = restart.copy()
    for _ in range(rounds):
        new = damping * (rank @ step + rank[out <= 0].sum() * restart) + (1 - damping) * restart
        if np.abs(new - rank).sum() < tolerance:
            return new
        rank = new
    return rank


def pagerank(edges: DataFrame, personal: DataFrame, case: str, damping: float = 0.85, reverse: bool = True) -> DataFrame:
    """(case, node, score): each case's ranks, from callee to caller if reverse."""

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*left["src"], *left["dst"]})
        if not nodes:
            return pd.DataFrame(columns=[case, "node", "score"])
        at = {v: i for i, v in enumerate(nodes)}
        m = np.zeros((len(nodes), len(nodes)))
        for s, d, w in zip(left["src"], left["dst"], left["weight"]):
            m[(at[d], at[s]) if reverse else (at[s], at[d])] += w
        start = np.zeros(len(nodes))
        for v, p in zip(right["node"], right["personal"]):
            if v in at:
                start[at[v]] = p
        return pd.DataFrame({case: left[case].iloc[0], "node": nodes, "score": page_rank(m, start, damping)})

    personal = personal.select(*(F.col(c).alias(c) for c in personal.columns))  # columns of its own, also where both sides come from one table
    return edges.groupBy(case).cogroup(personal.groupBy(case)).applyInPandas(rank, f"{_kind(edges, case)}, node {edges.schema['src'].dataType.simpleString()}, score double")


def localize(edges: DataFrame, nodes: DataFrame, corr: DataFrame, case: str, alpha: float = 0.55, quiet: float = 0.1, damping: float = 0.85) -> DataFrame:
    """Services ranked on a case's subgraph without a trained edge model.

    edges: (case, src, dst); nodes: (case, node, kind, anomalous); corr: (case, node,
    resource, corr) of an anomalous service's response time with its own resources and,
    as resource, with hosts.  An edge from an anomalous service weighs alpha if it leads to
    a service and the greatest correlation if it leads to a host; other edges weigh
    little.  Restarts go to anomalous services by mean incoming weight times greatest
    correlation, or evenly if that is 0 everywhere.
    """
    best = corr.groupBy(case, F.col("node").alias("src"), F.col("resource").alias("dst")).agg(F.max("corr").alias("host_corr"))
    of = lambda side: nodes.select(case, F.col("node").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("anomalous").alias(f"{side}_odd"))
    rows = edges.join(of("src"), [case, "src"]).join(of("dst"), [case, "dst"]).join(best, [case, "src", "dst"], "left")
    to_service, to_host = F.col("dst_kind") == "service", F.col("dst_kind") == "host"
    weight = F.when(~F.col("src_odd"), F.lit(quiet)).when(to_service & (F.col("src_kind") == "service"), F.lit(alpha)).when(to_host, F.coalesce("host_corr", F.lit(0.0))).otherwise(F.lit(1.0))
    weighted = rows.select(case, "src", "dst", weight.alias("weight"))
    own = corr.join(nodes.select(case, F.col("node").alias("resource"), "kind"), [case, "resource"], "left").where("kind is null").groupBy(case, "node").agg(F.max("corr").alias("best"))
    incoming = weighted.groupBy(case, F.col("dst").alias("node")).agg(F.avg("weight").alias("mean"))
    score = F.when((F.col("kind") == "service") & F.col("anomalous"), F.coalesce("mean", F.lit(0.0)) * F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))).otherwise(0.0)
    personal = nodes.join(incoming, [case, "node"], "left").join(own, [case, "node"], "left").select(case, "node", score.alias("personal"))
    ranks = pagerank(weighted, personal, case, damping)
    return ranks.join(nodes.where("kind = 'service'").select(case, "node"), [case, "node"])


def latency_like(case: Column, tokens: Sequence[str] = ("delay", "latency", "slow")) -> Column:
    """Whether a case's name has a token of a latency fault."""
    return F.lower(case).rlike(rf"(?:^|[^a-z])(?:{'|'.join(tokens)})(?:$|[^a-z])")


def birch_threshold(case: Column, base: float = 0.045, latency: float | None = None) -> Column:
    """The threshold of a case: one for all, unless another is given for cases whose name tells a latency fault (which uses the label)."""
    return F.lit(base) if latency is None else F.when(latency_like(case), F.lit(latency)).otherwise(F.lit(base))


def impact_edges(skeleton: DataFrame, case: str) -> DataFrame:
    """(case, effect, cause) of a partly directed graph (case, a, b, directed: a -> b): directed edges are reversed, undirected ones go both ways; nodes without an edge have no row."""
    both = F.when(F.col("directed"), F.array(F.struct(F.col("b").alias("effect"), F.col("a").alias("cause")))).otherwise(F.array(F.struct(F.col("a").alias("effect"), F.col("b").alias("cause")), F.struct(F.col("b").alias("effect"), F.col("a").alias("cause"))))
    return skeleton.where("a <> b").select(case, F.explode(both).alias("e")).select(case, "e.*").distinct()


def without_lone(nodes: DataFrame, edges: DataFrame, case: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nodes (case, node) that an edge touches, and those to keep."""
    touched = edges.select(case, F.explode(F.array("effect", "cause")).alias("node")).distinct()
    linked = nodes.join(touched, [case, "node"], "left_semi")
    return linked.unionByName(nodes.where(F.col("node").isin(*keep)).join(touched, [case, "node"], "left_anti")) if keep else linked


def _independent(corr: np.ndarray, n: int, i: int, j: int, given: tuple[int, ...], alpha: float) -> bool:
    """Fisher's z test of the partial correlation."""
    index = [i, j, *given]
    precision = np.linalg.pinv(corr[np.ix_(index, index)])
    r = -precision[0, 1] / math.sqrt(max(1e-12, precision[0, 0] * precision[1, 1]))
    r = min(0.9999999, max(-0.9999999, r))
    z = math.sqrt(max(1, n - len(given) - 3)) * abs(0.5 * math.log((1 + r) / (1 - r)))
    return math.erfc(z / math.sqrt(2)) > alpha


def pc_graph(values: np.ndarray, alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Order-independent PC algorithm: (directed i -> j, undirected) as boolean matrices."""
    n, k = values.shape
    corr = np.corrcoef(values, rowvar=False)
    linked = ~np.eye(k, dtype=bool)
    parted: dict[tuple[int, int], set[int]] = {}
    size = 0
    while any(linked[i].sum() - 1 >= size for i in range(k)):
        neighbours = [np.flatnonzero(linked[i]) for i in range(k)]
        for i in range(k):
            for j in neighbours[i]:
                if not linked[i, j]:
                    continue
                for given in combinations([x for x in neighbours[i] if x != j], size):
                    if _independent(corr, n, i, int(j), given, alpha):
                        linked[i, j] = linked[j, i] = False
                        parted[min(i, j), max(i, j)] = set(given)
                        break
        size += 1
    arrow = np.zeros((k, k), bool)
    for b in range(k):
        for a, c in combinations(np.flatnonzero(linked[b]), 2):
            if not linked[a, c] and b not in parted.get((min(a, c), max(a, c)), set()):
                arrow[a, b] = arrow[c, b] = True
    arrow &= ~arrow.T
    open_ = linked & ~arrow & ~arrow.T
    changed = True
    while changed:  # Meek's first three rules
        changed = False
        for a, b in zip(*np.nonzero(open_)):
            if not open_[a, b]:
                continue
            into = np.flatnonzero(arrow[:, a] & ~linked[:, b])
            chain = (arrow[a] & arrow[:, b]).any()
            pair = [x for x in np.flatnonzero(open_[a] & arrow[:, b])]
            kite = any(not linked[x, y] for x, y in combinations(pair, 2))
            if any(x != b for x in into) or chain or kite:
                arrow[a, b], open_[a, b], open_[b, a] = True, False, False
                changed = True
    return arrow, open_


def prune_columns(values: np.ndarray, names: list[str], keep: Sequence[str] = (), variance: float = 1e-10) -> tuple[np.ndarray, list[str]]:
    """Without (nearly) constant and repeated columns; then, while the correlations are singular, without the column most correlated to another."""
    use: list[int] = []
    for i, name in enumerate(names):
        if (values[:, i].var() > variance or name in keep) and not any(np.array_equal(values[:, i], values[:, j]) for j in use):
            use.append(i)
    while len(use) > 1:
        part = values[:, use]
        varies = part.std(0) > 0
        corr = np.eye(len(use))
        corr[np.ix_(varies, varies)] = np.corrcoef(part[:, varies], rowvar=False) if varies.sum() > 1 else 1.0
        if np.linalg.matrix_rank(corr) == len(use):
            break
        strongest = np.abs(corr - np.eye(len(use))).max(0)
        free = [i for i in range(len(use)) if names[use[i]] not in keep] or list(range(len(use)))
        use.pop(min(free, key=lambda i: (-round(strongest[i], 12), part[:, i].var(), names[use[i]])))
    return values[:, use], [names[i] for i in use]


def impact_graph(rows: DataFrame, case: str, alpha: float = 0.1, frontend: str | None = None) -> DataFrame:
    """(case, effect, cause) edges learned from long rows (case, bucket, service, value); undirected edges go both ways, lone nodes have none."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="bucket", columns="service", values="value", aggfunc="mean").sort_index().ffill().bfill().fillna(0.0)
        values, names = prune_columns(wide.to_numpy(float), list(wide.columns), [frontend] if frontend else [])
        if len(names) < 2 or len(values) < 5:
            return pd.DataFrame(columns=[case, "effect", "cause"])
        arrow, open_ = pc_graph(values, alpha)
        edges = [(names[j], names[i]) for i, j in zip(*np.nonzero(arrow))] + [(names[i], names[j]) for i, j in zip(*np.nonzero(open_))]
        return pd.DataFrame([(pdf[case].iloc[0], *e) for e in sorted(edges)], columns=[case, "effect", "cause"])

    return rows.select(case, "bucket", "service", "value").groupBy(case).applyInPandas(learn, f"{_kind(rows, case)}, effect string, cause string")


def walk_shares(adjacency: np.ndarray, corr: np.ndarray, start: int, beta: float = 0.5, rho: float = 0.5, steps: int = 20_000, seed: int = 20260320) -> np.ndarray:
    """Visit shares of a second-order random walk from effects to causes, with steps back and stays."""
    k = len(corr)
    pull = adjacency * corr[None, :]
    first = np.divide(pull, pull.sum(1, keepdims=True), out=np.zeros_like(pull), where=pull.sum(1, keepdims=True) > 0)
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = rng.random(steps)
    cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    visits = np.zeros(k)
    before, now = -1, start
    for u in draws:
        if (before, now) not in cache:
            q = first[before, now] if before >= 0 and before != now and first[before, now] > 0 else corr[now]
            ahead = np.where(adjacency[now] > 0, (1 - beta) * q + beta * first[now], 0.0)
            back = np.where((adjacency[:, now] > 0) & (adjacency[now] == 0), rho * ((1 - beta) * q + beta * corr), 0.0)
            weight = ahead + back
            weight[now] = max(0.0, (1 - beta) * q + beta * corr[now] - weight.max(initial=0.0))
            total = weight.sum()
            weight = weight / total if total > 0 else np.eye(k)[now]
            cache[before, now] = (np.flatnonzero(weight > 0), np.cumsum(weight[weight > 0]))
        choices, upto = cache[before, now]
        before, now = now, int(choices[min(len(choices) - 1, int(np.searchsorted(upto, u, "right")))])
        visits[now] += 1
    return visits / max(1, steps)


def random_walk(edges: DataFrame, corr: DataFrame, case: str, frontend: str, steps: int = 20_000, seed: int = 20260320) -> DataFrame:
    """(case, service, score) by visit share; corr: (case, service, corr) with the front end."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*left["effect"], *left["cause"]})
        if not nodes:
            return pd.DataFrame(columns=[case, "service", "score"])
        at = {v: i for i, v in enumerate(nodes)}
        adjacency = np.zeros((len(nodes), len(nodes)))
        adjacency[left["effect"].map(at), left["cause"].map(at)] = 1
        r = np.zeros(len(nodes))
        for s, c in zip(right["service"], right["corr"]):
            if s in at:
                r[at[s]] = abs(c)
        start = at.get(frontend, int(np.argmax(r)))
        return pd.DataFrame({case: left[case].iloc[0], "service": nodes, "score": walk_shares(adjacency, r, start, steps=steps, seed=seed)})

    return edges.groupBy(case).cogroup(corr.groupBy(case)).applyInPandas(walk, f"{_kind(edges, case)}, service string, score double")


def birch_count(values: np.ndarray, threshold: float, branching: int = 50) -> int:
    """Leaf subclusters of a one-dimensional BIRCH pass: a point joins the nearest subcluster if its radius stays within the threshold.

    On a line the nearest centroid is found in a sorted list, so no tree is needed.
    """
    clusters: list[list[float]] = []  # n, sum, sum of squares
    for v in values:
        best = min(range(len(clusters)), key=lambda i: abs(clusters[i][1] / clusters[i][0] - v), default=None)
        if best is not None:
            n, s, q = clusters[best][0] + 1, clusters[best][1] + v, clusters[best][2] + v * v
            if math.sqrt(max(0.0, q / n - (s / n) ** 2)) <= threshold:
                clusters[best] = [n, s, q]
                continue
        clusters.append([1, v, v * v])
    return len(clusters)


def birch_test(rows: DataFrame, keys: Sequence[str], order: str, value: str, threshold: float = 0.045, window: int = 12) -> DataFrame:
    """Whether each series' smoothed, unit-length values form more than one subcluster."""
    kinds = ", ".join(_kind(rows, k) for k in keys)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        smooth = pdf.sort_values(order)[value].rolling(window, min_periods=1).mean().to_numpy(float)
        norm = np.linalg.norm(smooth)
        count = 1 if np.ptp(smooth) == 0 or norm == 0 else birch_count(smooth / norm, threshold)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | {"subclusters": count, "is_anomalous": count > 1}])

    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(test, f"{kinds}, subclusters long, is_anomalous boolean")
