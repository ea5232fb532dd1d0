"""Best-fit packing of documents into sequences of several permitted lengths.

Items of equal length are alike, so the plan is made on the histogram of lengths,
whose size is bounded by the longest permitted length and not by the corpus: best-fit
decreasing with multiplicities, where a new bin gets the size of least cost per token
it is expected to hold, and each bin finally shrinks to the smallest size that holds
its contents.  Documents then find their bin by their rank among the items of their
length; hot lengths are ranked in salted parts, as many as their items need.

Length is in tokens of a vocabulary file and one end mark, or any column that the caller
names.  A document longer than the largest size is cut into full pieces and a rest;
nothing is dropped.

Edge cases: a null or empty text is one item of one token (its end mark); texts of any length are encoded whole; a null or
negative length column counts as 0 and such an item, taking no room, goes to the
first bin of the plan; ties are broken by id and piece; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import token_counts
from .workspace import Workspace

#: Permitted sequence lengths, and the cost of a sequence of each besides its tokens.
SIZES, OVERHEAD = (2048, 4096, 8192, 16384), 64
#: Items of a length that are ranked together, about; items looked at to price a new bin.
RANKED, LOOK_AHEAD = 512, 12

PACKED = "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_size long, bin_offset long"


@dataclass
class Group:
    """Bins of equal contents."""

    bins: int
    size: int
    items: list[tuple[int, int]] = field(default_factory=list)  # (length, how many in each bin)

    def used(self) -> int:
        return sum(n * k for n, k in self.items)


def default_cost(size: int) -> float:
    return size + OVERHEAD


def plan(histogram: dict[int, int], sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = default_cost) -> list[Group]:
    """Groups of bins that hold all items of the histogram (length: number), each length at most the largest size."""
    sizes = sorted(sizes)
    left = {n: c for n, c in histogram.items() if c > 0 and n > 0}
    lengths = sorted(left)
    room: list[int] = []  # distinct free room, ascending
    open_bins: dict[int, list[Group]] = {}
    done: list[Group] = []

    def put(group: Group) -> None:
        free = group.size - group.used()
        if free < lengths_min:
            done.append(group)
            return
        if free not in open_bins:
            insort(room, free)
            open_bins[free] = []
        open_bins[free].append(group)

    def expected(size: int, length: int, count: int) -> int:
        """Tokens a new bin would get: this length first, then the longest items that still fit."""
        free = size - length * min(count, size // length)
        at = bisect_left(lengths, length)
        for _ in range(LOOK_AHEAD):
            at = min(at, bisect_right(lengths, free))
            if at == 0 or free <= 0:
                break
            at -= 1
            free -= lengths[at] * min(left[lengths[at]], free // lengths[at])
        return size - free

    lengths_min = lengths[0] if lengths else 1
    while lengths:
        length = lengths.pop()
        count = left.pop(length)
        while count:
            at = bisect_left(room, length)
            if at < len(room):
                free = room[at]
                group = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                    room.pop(at)
            else:
                size = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / expected(s, length, count), s))
                free, group = size, Group(-(-count // (size // length)), size)
            each = free // length
            full = min(group.bins, count // each)
            rest = count - full * each if full < group.bins else 0
            if full:
                put(Group(full, group.size, [*group.items, (length, each)]))
            if rest and rest < each:
                put(Group(1, group.size, [*group.items, (length, rest)]))
                full += 1
                count = 0
            else:
                count -= full * each
            if full < group.bins and group.items:
                put(Group(group.bins - full, group.size, group.items))
    done += [g for groups in open_bins.values() for g in groups]
    for g in done:
        g.size = next(s for s in sizes if s >= g.used())
    return done


def intervals(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that go to each group, sorted by (length, first rank)."""
    rows, base, taken = [], 0, {}
    for g in sorted(groups, key=lambda g: (-g.size, g.items)):
        offset = 0
        for length, each in g.items:
            first = taken.get(length, 0)
            rows.append((length, first, each, base, offset, g.size))
            taken[length] = first + each * g.bins
            offset += length * each
        base += g.bins
    rows.sort()
    names = ("length", "first", "each", "base", "offset", "size")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pieces(docs: DataFrame, largest: int, doc_id: str = "doc_id", length: str = "n_tokens") -> DataFrame:
    """(doc_id, piece, start, n_tokens), long documents cut."""
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.lit(0), F.coalesce(F.col(length), F.lit(0))).cast("long").alias("total"))
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / largest) - 1).cast("long")
    cut = whole.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).cast("long").alias("n_tokens"))


def token_lengths(docs: DataFrame, vocabulary: str, doc_id: str, text: str) -> DataFrame:
    """doc_id and n_tokens: tokens of the text and an end mark."""
    counted = token_counts.with_counts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), vocabulary)
    return counted.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"))


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, cost: Callable[[int], float] = default_cost, doc_id: str = "doc_id", text: str = "text", length: str | None = None, vocabulary: str = token_counts.VOCABULARY) -> DataFrame:
    """One row per piece: its bin, the bin's final size and its place in the bin (see PACKED)."""
    spark = docs.sparkSession
    place = Workspace(spark, "packing")
    cut = pieces(docs, max(sizes), doc_id, length) if length else pieces(token_lengths(docs, vocabulary, doc_id, text), max(sizes))
    items = place.table("items", cut)
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # a row for each length up to the largest size
    hot = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items() if n > RANKED], "n_tokens long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce("salts", F.lit(1)))
    items = items.join(F.broadcast(hot), "n_tokens", "left").withColumn("salt", salt).drop("salts")
    counts = place.table("counts", items.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")))
    shared = spark.sparkContext.broadcast(intervals(plan(histogram, sizes, cost)))
    least = min(sizes)
    by_length = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("n_tokens", "salt", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(in_part).cast("long")).join(before, ["n_tokens", "salt"]).select("doc_id", "piece", "start", "n_tokens", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def place_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = np.unique(table["length"], return_index=True)
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("n_tokens", "rank"))
            out = {k: np.zeros(len(size), np.int64) for k in ("bin_id", "bin_size", "bin_offset")}
            out["bin_size"][:] = table["size"][0] if len(table["size"]) else least
            order = np.lexsort((rank, size))
            bounds = np.flatnonzero(np.diff(size[order], prepend=-1))
            for lo, hi in zip(bounds, [*bounds[1:], len(order)]):
                rows = order[lo:hi]
                at = np.searchsorted(starts[0], size[rows[0]])
                if size[rows[0]] < 1:
                    continue
                a, b = starts[1][at], starts[1][at + 1] if at + 1 < len(starts[1]) else len(table["length"])
                k = a + np.searchsorted(table["first"][a:b], rank[rows], "right") - 1
                within = rank[rows] - table["first"][k]
                out["bin_id"][rows] = table["base"][k] + within // table["each"][k]
                out["bin_size"][rows] = table["size"][k]
                out["bin_offset"][rows] = table["offset"][k] + within % table["each"][k] * size[rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "n_tokens")), *(pa.array(v) for v in out.values())], names=["doc_id", "piece", "start", "n_tokens", *out])

    return ranked.mapInArrow(place_items, PACKED)
