"""Log template mining in the manner of Drain: lines of equal length and equal first tokens share a leaf, and clusters never leave their leaf."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Depth of the prefix tree (two levels hold the root and the length), least similarity, wildcard.
DEPTH, SIMILARITY, WILDCARD = 4, 0.5, "<*>"


def similarity(template: list[str], tokens: list[str]) -> tuple[float, int]:
    """Share of equal tokens, and number of wildcards."""
    same = sum(a == b for a, b in zip(template, tokens) if a != WILDCARD)
    return same / len(tokens) if tokens else 1.0, sum(a == WILDCARD for a in template)


def fold(lines: list[tuple[list[str], int]], least: float = SIMILARITY, clusters: list[tuple[list[str], int]] | None = None) -> list[tuple[list[str], int]]:
    """Templates of the lines of one leaf, with their counts, in the order of first lines; clusters: those of earlier lines, which are added to."""
    clusters = [] if clusters is None else clusters
    for tokens, count in lines:
        best = max(range(len(clusters)), key=lambda i: (*similarity(clusters[i][0], tokens), -i), default=None)
        if best is not None and similarity(clusters[best][0], tokens)[0] >= least:
            template, n = clusters[best]
            clusters[best] = ([a if a == b else WILDCARD for a, b in zip(template, tokens)], n + count)
        else:
            clusters.append((list(tokens), count))
    return clusters


def leaf(message, depth: int = DEPTH):
    """Leaf of a line: number of tokens and its first tokens, those with a digit as wildcards."""
    tokens = F.split(F.trim(message), r"\s+")
    first = F.transform(F.slice(tokens, 1, depth - 2), lambda t: F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t))
    return F.concat_ws("\u0001", F.size(tokens).cast("string"), F.array_join(first, "\u0001"))


def templates(lines: DataFrame, message: str = "message", least: float = SIMILARITY, depth: int = DEPTH) -> DataFrame:
    """(leaf, template, n): equal lines are counted before the shuffle; a leaf's distinct lines are folded in order of their text, so the result does not depend on the partitioning.

    A task reads its leaves' lines as a sorted stream and holds the templates of one leaf,
    however many lines that leaf has.
    """
    counted = lines.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("line")).agg(F.count("*").alias("n")).withColumn("leaf", leaf(F.col("line"), depth))

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = None, []
        for pdf in batches:
            for name, rows in pdf.groupby("leaf", sort=False):
                if name != now:
                    yield found(now, known)
                    now, known = name, []
                fold([(re.split(r"\s+", line.strip()), n) for line, n in zip(rows["line"], rows["n"])], least, known)
        yield found(now, known)

    def found(name: str | None, known: list[tuple[list[str], int]]) -> pd.DataFrame:
        return pd.DataFrame([(name, " ".join(t), n) for t, n in known], columns=["leaf", "template", "n"])

    return counted.select("leaf", "line", "n").repartition("leaf").sortWithinPartitions("leaf", "line").mapInPandas(mine, "leaf string, template string, n long")
